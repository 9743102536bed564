"""One query for each operator over the driver's tables, and the same in SQL.

The tables have no NULL, so inputs with NULL, validity, edges and sparse vectors are derived alike in both.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import scalars, words
from .functions import vectors as V
from .functions.vectorisers import HashVectoriser
from .language import nodes as n
from .operators import graph, inference, placement, searching
from .sources import changelog
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = 1_706_745_600_000  # 2024-02-01T00:00:00Z


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> str:
    return f"cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) * 1000 as bigint)"


# FETCH

ORDERS = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_totalprice AS price, o_orderpriority AS priority,
    epoch_ms(date_trunc('second', o_orderdate)) AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN epoch_ms(date_trunc('second', o_orderdate)) + 2592000000 END AS valid_to, o_orderkey AS tx_time FROM orders)"""


def orders(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, separator="_", clock=lambda: NOW)
    df = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id", "o_orderkey", "o_custkey", "nullif(o_orderstatus, 'P') as status", "o_totalprice as price", "o_orderpriority as priority",
        f"{millis('o_orderdate')} as valid_from", f"case when o_orderkey % 3 = 0 then {millis('o_orderdate')} + 2592000000 end as valid_to", "cast(o_orderkey as bigint) as tx_time",
    )
    e.register("orders", df, indexes=(n.IndexDecl("by_status", ("status",)),))
    return e


def fetch(name: str, statement: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return orders(spark, sf_dir).execute(statement).frame

    run.__name__ = name
    run.__doc__ = statement
    query(f"WITH {ORDERS} {sql}")(run)


ALL = "SELECT id, o_orderkey, o_custkey, status, price, priority, valid_from, valid_to, tx_time FROM o"
SOME = "SELECT id, status, price FROM o"
fetch("fetch_all", "FETCH * FROM orders;", ALL)
fetch("fetch_projection", "FETCH price, status, price FROM orders;", SOME)
fetch("fetch_missing_field_null", "FETCH price, nothing FROM orders;", "SELECT id, price, CAST(NULL AS VARCHAR) AS nothing FROM o")
fetch("fetch_eq", "FETCH status, price FROM orders WHERE status = 'F';", f"{SOME} WHERE status = 'F'")
fetch("fetch_neq_null_true", "FETCH status, price FROM orders WHERE status != 'F';", f"{SOME} WHERE status IS DISTINCT FROM 'F'")
fetch("fetch_gt", "FETCH status, price FROM orders WHERE price > 200000;", f"{SOME} WHERE price > 200000")
fetch("fetch_gte", "FETCH status, price FROM orders WHERE o_custkey >= 700;", f"{SOME} WHERE o_custkey >= 700")
fetch("fetch_lt", "FETCH status, price FROM orders WHERE price < 50000.5;", f"{SOME} WHERE price < 50000.5")
fetch("fetch_lte", "FETCH status, price FROM orders WHERE o_custkey <= 300;", f"{SOME} WHERE o_custkey <= 300")
fetch("fetch_range_and", "FETCH status, price FROM orders WHERE price > 100000 AND price < 200000;", f"{SOME} WHERE price > 100000 AND price < 200000")
fetch("fetch_or", "FETCH status, price FROM orders WHERE status = 'O' OR price > 300000;", f"{SOME} WHERE status = 'O' OR price > 300000")
fetch("fetch_and_or_leftassoc", "FETCH status, price FROM orders WHERE status = 'O' OR status = 'F' AND price > 250000;", f"{SOME} WHERE (status = 'O' OR status = 'F') AND price > 250000")
fetch("fetch_not", "FETCH status, price FROM orders WHERE NOT status = 'F' AND NOT price > 100000;", f"{SOME} WHERE NOT coalesce(status = 'F', false) AND NOT coalesce(price > 100000, false)")
fetch("fetch_in", "FETCH status, priority FROM orders WHERE priority IN ('1-URGENT', '2-HIGH');", "SELECT id, status, priority FROM o WHERE priority IN ('1-URGENT', '2-HIGH')")
fetch("fetch_in_null", "FETCH status, price FROM orders WHERE status IN ('O', NULL);", f"{SOME} WHERE status = 'O' OR status IS NULL")
fetch("fetch_like", "FETCH priority, price FROM orders WHERE priority LIKE '_-%I%';", "SELECT id, priority, price FROM o WHERE priority LIKE '_-%I%'")
fetch("fetch_is_null", "FETCH status, price FROM orders WHERE status IS NULL;", f"{SOME} WHERE status IS NULL")
fetch("fetch_is_not_null", "FETCH status, price FROM orders WHERE status IS NOT NULL;", f"{SOME} WHERE status IS NOT NULL")
fetch("fetch_order_asc", "FETCH status, price FROM orders ORDER BY status, price LIMIT 100;", f"{SOME} ORDER BY status ASC NULLS LAST, price ASC NULLS LAST, id LIMIT 100")
fetch("fetch_order_desc_multi", "FETCH status, price FROM orders ORDER BY status DESC, price ASC LIMIT 100;", f"{SOME} ORDER BY status DESC NULLS FIRST, price ASC NULLS LAST, id LIMIT 100")
fetch("fetch_limit_topk", "FETCH status, price FROM orders WHERE status = 'F' ORDER BY price DESC LIMIT 20;", f"{SOME} WHERE status = 'F' ORDER BY price DESC, id LIMIT 20")
fetch("fetch_point_get", "FETCH status, price FROM orders WHERE id = '7';", f"{SOME} WHERE id = '7'")
fetch("fetch_as_of", "FETCH status, price FROM orders AS OF '1996-01-01';", f"{SOME} WHERE (valid_from <= epoch_ms(TIMESTAMP '1996-01-01')) AND (valid_to IS NULL OR valid_to > epoch_ms(TIMESTAMP '1996-01-01'))")
fetch("fetch_valid_during", "FETCH status, price FROM orders VALID DURING '1995-01-01'..'1995-02-01';", f"{SOME} WHERE valid_from < epoch_ms(TIMESTAMP '1995-02-01') AND (valid_to IS NULL OR valid_to > epoch_ms(TIMESTAMP '1995-01-01'))")
fetch("fetch_as_of_tx", "FETCH status, price FROM orders AS OF TRANSACTION 500;", f"{SOME} WHERE tx_time <= 500")

# JOIN

PEOPLE = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance, CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation_id, c_mktsegment AS segment FROM customer),
    na AS (SELECT CAST(n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 5 = 1 THEN 'x' ELSE '' END AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region_id FROM nation),
    re AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region)"""


def people(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, separator="_", clock=lambda: NOW)
    e.register("customers", table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as id", "c_name as name", "c_acctbal as balance", "case when c_nationkey % 5 <> 0 then cast(c_nationkey as string) end as nation_id", "c_mktsegment as segment"))
    e.register("nations", table(spark, sf_dir, "nation").selectExpr("concat(cast(n_nationkey as string), case when n_nationkey % 5 = 1 then 'x' else '' end) as id", "n_name as name", "cast(n_regionkey as string) as region_id"))
    e.register("regions", table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as string) as id", "r_name as name"))
    return e


def join(name: str, statement: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return people(spark, sf_dir).execute(statement).frame

    run.__name__ = name
    run.__doc__ = statement
    query(f"WITH {PEOPLE}{sql}" if sql.startswith(",") else f"WITH {PEOPLE} {sql}")(run)


PAIR = "SELECT c.id AS c_id, c.name AS c_name, n.id AS n_id, n.name AS n_name FROM c"
ON = "JOIN na AS n ON c.nation_id = n.id"
for how in ("INNER", "LEFT", "RIGHT", "FULL"):
    join(f"join_{how.lower()}", f"FETCH c.id, c.name, n.id, n.name FROM customers AS c {how} JOIN nations AS n ON c.nation_id = n.id;", f"{PAIR} {how} {ON}")
join(
    "join_first_match_only",
    "FETCH n.id, n.name, c.id, c.balance FROM nations AS n LEFT JOIN customers AS c ON n.id = c.nation_id;",
    "SELECT n.id AS n_id, n.name AS n_name, f.id AS c_id, f.balance AS c_balance FROM na AS n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY nation_id ORDER BY id) AS k FROM c) AS f ON n.id = f.nation_id AND f.k = 1",
)
join(
    "join_multi",
    "FETCH c.id, n.name, r.name FROM customers AS c INNER JOIN nations AS n ON c.nation_id = n.id LEFT JOIN regions AS r ON n.region_id = r.id;",
    f"SELECT c.id AS c_id, n.name AS n_name, r.name AS r_name FROM c {ON} LEFT JOIN re AS r ON n.region_id = r.id",
)
join("join_where", "FETCH c.id, n.name FROM customers AS c LEFT JOIN nations AS n ON c.nation_id = n.id WHERE n.name IS NULL AND c.balance > 0;", f"SELECT c.id AS c_id, n.name AS n_name FROM c LEFT {ON} WHERE n.name IS NULL AND c.balance > 0")
join("join_order_limit", "FETCH c.id, c.balance, n.name FROM customers AS c JOIN nations AS n ON c.nation_id = n.id ORDER BY c.balance DESC LIMIT 25;", f"SELECT c.id AS c_id, c.balance AS c_balance, n.name AS n_name FROM c {ON} ORDER BY c.balance DESC, c.id LIMIT 25")

KEYED = "k AS (SELECT *, row_number() OVER (PARTITION BY nation_id ORDER BY id) AS k FROM c)"
for how in ("RIGHT", "FULL"):
    join(
        f"join_{how.lower()}_field",
        f"FETCH n.id, c.id FROM nations AS n {how} JOIN customers AS c ON n.id = c.nation_id;",
        f", {KEYED} SELECT n.id AS n_id, k.id AS c_id FROM na AS n {how} JOIN k ON n.id = k.nation_id AND k.k = 1",
    )

PLACED = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer), o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price FROM orders),
    e AS (SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(o_orderkey AS VARCHAR) AS dst, round(1 - (o_orderkey % 97) / 100.0, 6) AS confidence FROM orders),
    b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS k FROM e WHERE confidence >= {})"""


def placed(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, separator="_", clock=lambda: NOW)
    rows = table(spark, sf_dir, "orders")
    e.register("customers", table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as id", "c_name as name"))
    e.register("orders", rows.selectExpr("cast(o_orderkey as string) as id", "o_totalprice as price"))
    e.register_edges("placed", "customers", "orders", rows.selectExpr("cast(o_custkey as string) as src", "cast(o_orderkey as string) as dst", "round(1 - (o_orderkey % 97) / 100.0D, 6) as confidence"))
    return e


def _confidence(how: str, at_least: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return placed(spark, sf_dir).execute(f"FETCH c.id, c.name, o.id, o.price FROM customers AS c {how} JOIN orders AS o ON c.id = o.id CONFIDENCE > {at_least};").frame.withColumnRenamed("_edge_confidence", "edge_confidence")

    run.__name__ = "join_confidence" + ("_left" if how == "LEFT" else "")
    query(f"WITH {PLACED.format(at_least)} SELECT c.id AS c_id, c.name AS c_name, o.id AS o_id, o.price AS o_price, x.confidence AS edge_confidence FROM c {how} JOIN (SELECT b.src, b.dst, CAST(b.confidence AS DOUBLE) AS confidence FROM b WHERE b.k = 1) x ON c.id = x.src {how} JOIN o ON x.dst = o.id")(run)


_confidence("INNER", 0.5)
_confidence("LEFT", 0.97)

# SEARCH

VECTORS = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    q AS (SELECT i, x FROM e WHERE vec_id = 0),
    s AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, any_value(e.label) AS label, sum(e.x * q.x) / sqrt(sum(e.x * e.x)) / sqrt(sum(q.x * q.x)) AS score FROM e JOIN q USING (i) GROUP BY e.vec_id)"""
DENSE = n.RepresentationDecl("embedding", dimensions=64)


def embeddings(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """The engine, and the vector of vec_id 0 as the language has it."""
    e = Engine(spark, separator="_", clock=lambda: NOW)
    df = table(spark, sf_dir, "embeddings")
    first = df.filter("vec_id = 0").select("embedding").first()[0]
    e.register("items", df, id="vec_id", representations=(DENSE,), indexes=(n.IndexDecl("by_label", ("label",)),))
    return e, "[" + ", ".join(f"{x:.9f}" for x in first) + "]"


def scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", *columns, F.round("_score", 5).alias("score"))


def search(name: str, statement: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, vector = embeddings(spark, sf_dir)
        return scored(e.execute(statement.format(vector)).frame, "label")

    run.__name__ = name
    run.__doc__ = statement
    query(f"WITH {VECTORS} {sql}")(run)


HITS = "SELECT id, label, round(score, 5) AS score FROM s"
search("search_dense", "SEARCH items NEAR VECTOR {} LIMIT 20;", f"{HITS} ORDER BY s.score DESC, id LIMIT 20")
search("search_dense_threshold", "SEARCH items NEAR VECTOR {} CONFIDENCE > 0.2 LIMIT 1000000;", f"{HITS} WHERE s.score >= 0.2")
search("search_prefilter", "SEARCH items WHERE label = 3 NEAR VECTOR {} LIMIT 10;", f"{HITS} WHERE label = 3 ORDER BY s.score DESC, id LIMIT 10")

WORDS = """t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS dim FROM documents), p AS (SELECT doc_id, dim, ln(1 + count(*)) AS w FROM t WHERE dim <> '' GROUP BY doc_id, dim),
    s AS (SELECT CAST(doc_id AS VARCHAR) AS id, sum(w * CASE dim WHEN 'the' THEN 1.0 WHEN 'of' THEN 0.5 ELSE 2.0 END) AS score FROM p WHERE dim IN ('the', 'of', 'with') GROUP BY doc_id)"""


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and words, the sparse vector of each document by its own words."""
    return words.word_vectors(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), "text")


@query(f"WITH {WORDS} SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 20")
def search_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("docs", word_vectors(spark, sf_dir), representations=(n.RepresentationDecl("words", sparse=True),))
    return scored(e.execute("SEARCH docs NEAR SPARSE ['the':1.0, 'of':0.5, 'with':2.0] LIMIT 20;").frame)


@query(
    f"WITH {VECTORS}, {WORDS.replace(' s AS', ' w AS')}, d AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 10)),"
    " k AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM (SELECT w.* FROM w JOIN s ON s.id = w.id ORDER BY w.score DESC, w.id LIMIT 10)),"
    " f AS (SELECT id, sum(part) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM k) GROUP BY id) SELECT id, round(score, 5) AS score FROM f ORDER BY f.score DESC, id LIMIT 10"
)
def search_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, vector = embeddings(spark, sf_dir)
    both = e.catalog.collection("items").frame.join(word_vectors(spark, sf_dir), "id", "left")
    e.register("both", both, representations=(DENSE, n.RepresentationDecl("words", sparse=True)))
    return scored(e.execute(f"SEARCH both NEAR VECTOR {vector} NEAR SPARSE ['the':1.0, 'of':0.5, 'with':2.0] LIMIT 10;").frame)


HASHED = " + ".join(f"(('0x' || substr(h, {2 * i + 1}, 2))::INT / 128.0 - 1.0) * (('0x' || substr(g, {2 * i + 1}, 2))::INT / 128.0 - 1.0)" for i in range(8))
OWN, ASKED = (" + ".join(f"pow(('0x' || substr({c}, {2 * i + 1}, 2))::INT / 128.0 - 1.0, 2)" for i in range(8)) for c in "hg")


@query(f"WITH t AS (SELECT CAST(item_id AS VARCHAR) AS id, sha256('text=' || text) AS h, sha256('what is near') AS g FROM benchmark), s AS (SELECT id, ({HASHED}) / sqrt({OWN}) / sqrt({ASKED}) AS score FROM t) SELECT id, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = Engine(spark), HashVectoriser(8)
    df = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), v.column(["text"]).alias("meaning"))
    e.register("passages", df, representations=(n.RepresentationDecl("meaning", dimensions=8, fields=("text",)),))
    e.vectorisers["passages", "meaning"] = v
    return e.execute("SEARCH passages NEAR 'what is near' USING meaning LIMIT 10;").frame.select("id", F.round("_score", 4).alias("score"))


LINKS = """l AS (SELECT CAST(vec_id AS VARCHAR) AS src, CAST((vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS VARCHAR) AS dst FROM embeddings
    UNION SELECT CAST(vec_id AS VARCHAR), CAST((vec_id * 11 + 5) % (SELECT count(*) FROM embeddings) AS VARCHAR) FROM embeddings)"""


def linked(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    e, vector = embeddings(spark, sf_dir)
    df = table(spark, sf_dir, "embeddings")
    total = df.count()
    pairs = df.select(F.col("vec_id").cast("string").alias("src"), F.explode(F.array(((F.col("vec_id") * 7 + 3) % total).cast("string"), ((F.col("vec_id") * 11 + 5) % total).cast("string"))).alias("dst")).distinct()
    e.register_edges("near", "items", "items", pairs)
    return e, vector


def _within(name: str, where: str, sql_where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, vector = linked(spark, sf_dir)
        return scored(e.execute(f"SEARCH items {where} NEAR VECTOR {vector} USING embedding WITHIN (TRAVERSE FROM '0' MATCH (a)-[r:near]->(b) DEPTH 1..4) LIMIT 10;").frame, "label")

    run.__name__ = name
    query(
        f"WITH RECURSIVE {VECTORS}, {LINKS}, r(id, d) AS (SELECT '0', 0 UNION SELECT l.dst, r.d + 1 FROM r JOIN l ON l.src = r.id WHERE r.d < 4),"
        f" k AS (SELECT id FROM r GROUP BY id HAVING min(d) >= 1) {HITS} WHERE id IN (SELECT id FROM k) {sql_where} ORDER BY s.score DESC, id LIMIT 10"
    )(run)


_within("search_within", "", "")
_within("search_within_where", "WHERE label < 5", "AND label < 5")


@query(f"WITH {VECTORS} {HITS} WHERE CAST(id AS BIGINT) % 4 <> 1 ORDER BY s.score DESC, id LIMIT 10")
def search_exclude_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, vector = embeddings(spark, sf_dir)
    dirty = F.when(F.col("id").cast("long") % 4 == 1, F.array(F.lit("embedding")))
    e.register("some", e.catalog.collection("items").frame.withColumn("_dirty", dirty), representations=(DENSE,))
    return scored(e.execute(f"SEARCH some NEAR VECTOR {vector} LIMIT 10;").frame, "label")


@query(f"WITH {VECTORS} {HITS} ORDER BY s.score DESC, id LIMIT 50")
def search_two_pass_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = embeddings(spark, sf_dir)
    items = e.catalog.collection("items").frame
    first = items.filter("id = '0'").first()["embedding"]
    return scored(searching.search_two_pass(items, "embedding", first, 50, factor=6), "label")


# Graph

USERS = "u AS (SELECT user_id, count(*) AS n_events, epoch_ms(date_trunc('second', max(ts))) AS last, epoch_ms(date_trunc('second', min(ts))) AS first FROM events GROUP BY user_id)"
FOLLOW = f"""{USERS}, m AS (SELECT max(user_id) + 1 AS m FROM u),
    e AS (SELECT DISTINCT 'u' || user_id AS src, 'u' || ((user_id * k + 7) % m.m) AS dst, round(1 - (user_id % 50) / 100.0, 6)::DOUBLE AS confidence, last AS created_at, first AS valid_from FROM u, m, (VALUES (13), (31)) AS v(k)),
    ids AS (SELECT 'u' || user_id AS id, n_events FROM u)"""
EXP, LIN, STEP = n.DecayDecl("exponential", 0.0000005, 0.05, 0.3), n.DecayDecl("linear", 0.0000002, 0.1), n.DecayDecl("step", 200000.0, 0.2)


def follow(spark: SparkSession, sf_dir: str, decay: n.DecayDecl | None = None) -> Engine:
    e = Engine(spark, separator="_", clock=lambda: NOW)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    m = u.agg(F.max("user_id") + 1).first()[0]
    target = F.explode(F.array(*[(F.col("user_id") * k + 7) % m for k in (13, 31)]))
    edges = u.select(
        F.concat(F.lit("u"), "user_id").alias("src"), target.alias("t"), F.round(1 - (F.col("user_id") % 50) / 100.0, 6).alias("confidence"), F.expr(millis("last")).alias("created_at"), F.expr(millis("first")).alias("valid_from")
    ).withColumn("dst", F.concat(F.lit("u"), "t"))
    e.register("users", u.select(F.concat(F.lit("u"), "user_id").alias("id"), "n_events"))
    e.register_edges("follows", "users", "users", edges.drop("t").distinct(), decay)
    return e


def bfs(edges: str, hops: int, low: int = 1, columns: str = "ids.id, ids.n_events, b.d AS depth, x.confidence AS edge_confidence", tail: str = "") -> str:
    """Depth and strongest edge of each node by a recursive query over ``edges`` (src, dst, confidence)."""
    return f"""WITH RECURSIVE {FOLLOW}, g AS ({edges}),
        r(id, d) AS (SELECT 'u1', 0 UNION SELECT g.dst, r.d + 1 FROM r JOIN g ON g.src = r.id WHERE r.d < {hops}),
        b AS (SELECT id, min(d)::INT AS d FROM r GROUP BY id),
        x AS (SELECT g.dst AS id, round(max(g.confidence), 6) AS confidence FROM g JOIN b f ON f.id = g.src JOIN b t ON t.id = g.dst AND t.d = f.d + 1 GROUP BY g.dst)
        SELECT {columns} FROM b JOIN ids ON ids.id = b.id LEFT JOIN x ON x.id = b.id WHERE b.d >= {low} AND b.id <> 'u1' {tail}"""


PLAIN = "SELECT src, dst, confidence FROM e"
SECONDS = f"(({NOW} - created_at) / 1000.0)"
DECAYED = {
    "exponential": f"greatest(least(confidence * exp(-0.0000005 * {SECONDS}), 1.0), 0.05)",
    "linear": f"greatest(least(confidence * (1.0 - 0.0000002 * {SECONDS}), 1.0), 0.1)",
    "step": f"greatest(least(CASE WHEN {SECONDS} > 200000.0 THEN 0.2 ELSE confidence END, 1.0), 0.2)",
}


def walk(name: str, statement: str, sql: str, decay: n.DecayDecl | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = follow(spark, sf_dir, decay).execute(statement).frame
        for old, new in (("_depth", "depth"), ("_edge_confidence", "edge_confidence"), ("_edge_type", "edge_type")):
            df = df.withColumnRenamed(old, new)
        return df.withColumn("edge_confidence", F.round("edge_confidence", 6)) if "edge_confidence" in df.columns else df

    run.__name__ = name
    run.__doc__ = statement
    query(sql)(run)


NODES = "ids.id, ids.n_events"
FULL = "ids.id, ids.n_events, b.d AS depth, x.confidence AS edge_confidence, 'follows' AS edge_type"
walk("traverse_1hop", "TRAVERSE follows FROM 'u1';", bfs(PLAIN, 1, columns=NODES))
walk("traverse_multi_hop", "TRAVERSE follows FROM 'u1' DEPTH 4;", bfs(PLAIN, 4, columns=NODES))
walk("traverse_cycle", "TRAVERSE follows FROM 'u1' DEPTH 10;", bfs(PLAIN, 10, columns=NODES))
walk("traverse_prune_decay", "TRAVERSE follows FROM 'u1' DEPTH 4;", bfs(f"SELECT src, dst, {DECAYED['exponential']} AS confidence FROM e WHERE {DECAYED['exponential']} >= 0.3", 4, columns=NODES), EXP)
walk("match_forward", "TRAVERSE FROM 'u1' MATCH (a)-[f:follows]->(b) DEPTH 1..3;", bfs(PLAIN, 3, columns=FULL))
walk("match_backward", "TRAVERSE FROM 'u1' MATCH (a)<-[f:follows]-(b) DEPTH 1..3;", bfs("SELECT dst AS src, src AS dst, confidence FROM e", 3, columns=FULL))
walk("match_undirected", "TRAVERSE FROM 'u1' MATCH (a)-[f:follows]-(b) DEPTH 1..2;", bfs(f"{PLAIN} UNION ALL SELECT dst, src, confidence FROM e", 2, columns=FULL))
walk("match_untyped", "TRAVERSE FROM 'u1' MATCH (a)-[f]->(b) DEPTH 1..2;", bfs(PLAIN, 2))
walk("match_min_depth", "TRAVERSE FROM 'u1' MATCH (a)-[f:follows]->(b) DEPTH 3..4;", bfs(PLAIN, 4, 3, FULL))
walk("match_confidence", "TRAVERSE FROM 'u1' MATCH (a)-[f:follows]->(b) DEPTH 1..4 CONFIDENCE > 0.7;", bfs(f"{PLAIN} WHERE confidence >= 0.7", 4, columns=FULL))
walk("match_temporal", "TRAVERSE FROM 'u1' MATCH (a)-[f:follows]->(b) DEPTH 1..3 AS OF '2024-01-02';", bfs(f"{PLAIN} WHERE valid_from <= epoch_ms(TIMESTAMP '2024-01-02')", 3, columns=FULL))
walk("match_limit", "TRAVERSE FROM 'u1' MATCH (a)-[f:follows]->(b) DEPTH 1..3 LIMIT 5;", bfs(PLAIN, 3, columns=FULL, tail="ORDER BY b.d, b.id LIMIT 5"))


def _decay(decay: n.DecayDecl) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = graph.effective(follow(spark, sf_dir).catalog.edge("follows").frame, decay, NOW)
        return edges.select("src", "dst", F.round("confidence", 6).alias("confidence"))

    run.__name__ = f"decay_{decay.function}"
    query(f"WITH {FOLLOW} SELECT src, dst, round({DECAYED[decay.function]}, 6) AS confidence FROM e")(run)


for _d in (EXP, LIN, STEP):
    _decay(_d)

# Inference

PROPOSED = f"WITH {VECTORS}, p AS (SELECT '0' AS from_id, id AS to_id, 'near' AS edge_type, score FROM s WHERE id <> '0')"
SHOWN = "SELECT from_id, to_id, edge_type, round(score, 5) AS confidence FROM p"


def inferring(spark: SparkSession, sf_dir: str) -> Engine:
    e, _ = embeddings(spark, sf_dir)
    some = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0 and vec_id > 0").select(F.lit("0").alias("src"), F.col("vec_id").cast("string").alias("dst"))
    e.register_edges("near", "items", "items", spark.createDataFrame([], "src string, dst string"))
    e.register_edges("seen", "items", "items", some)
    return e


def infer(name: str, statement: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inferring(spark, sf_dir).execute(statement).frame.withColumn("confidence", F.round("confidence", 5))

    run.__name__ = name
    run.__doc__ = statement
    query(sql)(run)


infer("infer_topk", "INFER EDGES FROM '0' VIA near RETURNING TOP 15;", f"{PROPOSED} {SHOWN} ORDER BY p.score DESC, to_id LIMIT 15")
infer("infer_floor", "INFER EDGES FROM '0' VIA near RETURNING TOP 1000 CONFIDENCE > 0.3;", f"{PROPOSED} {SHOWN} WHERE p.score >= 0.3 ORDER BY p.score DESC, to_id LIMIT 1000")
infer("infer_excludes_existing", "INFER EDGES FROM '0' VIA seen RETURNING TOP 15;", f"{PROPOSED.replace(chr(39) + 'near' + chr(39), chr(39) + 'seen' + chr(39))} {SHOWN} WHERE CAST(to_id AS BIGINT) % 3 <> 0 AND p.score >= 0 ORDER BY p.score DESC, to_id LIMIT 15")
infer("infer_all_types", "INFER EDGES FROM '0' RETURNING ALL;", f"{PROPOSED}, a AS (SELECT * FROM p UNION ALL SELECT from_id, to_id, 'seen', score FROM p WHERE CAST(to_id AS BIGINT) % 3 <> 0) {SHOWN.replace('FROM p', 'FROM a')} ORDER BY a.score DESC, to_id, edge_type LIMIT 10")


@query(
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), k AS (SELECT vec_id, sqrt(sum(x * x)) AS k FROM e GROUP BY vec_id),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, sum(a.x * b.x) AS d FROM e a JOIN e b USING (i) WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
    c AS (SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, d / x.k / y.k AS confidence FROM s JOIN k x ON x.vec_id = a JOIN k y ON y.vec_id = b),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS n FROM c WHERE confidence >= 0.15) SELECT src, dst, round(confidence, 5) AS confidence FROM r WHERE n <= 3"""
)
def auto_infer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all embeddings, in batches."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    near = inference.sweep(items, items, "embedding", spark.createDataFrame([], "src string, dst string"), 3, 0.15)
    return near.withColumn("confidence", F.round("confidence", 5))


@query(f"WITH {FOLLOW}, k AS (SELECT *, CASE WHEN length(src) % 2 = 0 THEN 'Inferred' ELSE 'Confirmed' END AS source FROM e) SELECT src, dst, source FROM k WHERE NOT (source = 'Inferred' AND {DECAYED['exponential']} < 0.3)")
def decay_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = follow(spark, sf_dir).catalog.edge("follows").frame.withColumn("source", F.when(F.length("src") % 2 == 0, "Inferred").otherwise("Confirmed"))
    return inference.decay_sweep(edges, EXP, NOW).select("src", "dst", "source")


@query(f"WITH {VECTORS} SELECT '0' AS src, id AS dst, 'Inferred' AS source, round(score, 5) AS confidence FROM s WHERE id <> '0' AND s.score >= 0.1 ORDER BY s.score DESC, id LIMIT 7")
def infer_queued_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written entity waits in the queue; the sweep proposes its edges and writes them."""
    e, _ = embeddings(spark, sf_dir)
    e.register_edges("near", "items", "items", spark.createDataFrame([], "src string, dst string"), inference=n.InferenceDecl(True, 0.1, 7))
    e.execute("UPDATE '0' IN items SET label = 5;")
    e.infer_queued()
    return e.catalog.edge("near").frame.select("src", "dst", "source", F.round("confidence", 5).alias("confidence"))


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.2 END::DOUBLE AS confidence FROM nation")
def decay_without_creation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without a creation time keep their confidence; old ones are at the floor."""
    created = F.when(F.col("n_nationkey") % 2 == 0, 0).otherwise(1)
    edges = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), created.alias("created_at"))
    e = Engine(spark, clock=lambda: NOW)
    e.register_edges("lies_in", "nations", "regions", edges, n.DecayDecl("exponential", 0.001, 0.2))
    return graph.effective(e.catalog.edge("lies_in").frame, e.catalog.edge("lies_in").decay, NOW).select("src", "dst", "confidence")


def managed(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations with a vector that is made of their names; the third was renamed since."""
    e = Engine(spark, clock=lambda: NOW)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array(F.lit(0.5).cast("float")).alias("v"))
    e.register("nations", rows, representations=(n.RepresentationDecl("v", dimensions=8, fields=("name",)),))
    e.vectorisers["nations", "v"] = HashVectoriser(8)
    e.execute("UPDATE '3' IN nations SET name = 'renamed';")
    return e


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey = 3 AS due FROM nation")
def update_marks_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return managed(spark, sf_dir).catalog.collection("nations").frame.select("id", F.coalesce(F.array_contains("_dirty", "v"), F.lit(False)).alias("due"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, false AS due, CASE WHEN n_nationkey = 3 THEN 8 ELSE 1 END::INT AS dimensions FROM nation")
def recompute_dirty_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the row that was due is encoded anew."""
    e = managed(spark, sf_dir)
    e.recompute_dirty("nations")
    return e.catalog.collection("nations").frame.select("id", (F.size(F.coalesce("_dirty", F.array().cast("array<string>"))) > 0).alias("due"), F.size("v").alias("dimensions"))


@query("SELECT '0' AS src, '3' AS dst, 0.9::DOUBLE AS confidence, 'Confirmed' AS source UNION ALL SELECT '0', '5', 0.4::DOUBLE, 'Confirmed'")
def confirm_edge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = embeddings(spark, sf_dir)
    e.register_edges("near", "items", "items", spark.createDataFrame([("0", "3", 0.5, "Inferred")], "src string, dst string, confidence double, source string"))
    for text in ("CONFIRM EDGE FROM '0' TO '3' TYPE near CONFIDENCE 0.9;", "CONFIRM EDGE FROM '0' TO '5' TYPE near CONFIDENCE 0.2;", "CONFIRM EDGE FROM '0' TO '5' TYPE near CONFIDENCE 0.4;"):
        e.execute(text)
    return e.catalog.edge("near").frame.select("src", "dst", "confidence", "source")


@query(f"SELECT '0' AS id, 'all' AS edge_type, 'Explicit' AS trigger, {NOW}::BIGINT AS at, 3::INT AS max_rows UNION ALL SELECT '0', 'all', 'Explicit', {NOW}::BIGINT, 2::INT")
def infer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inferring(spark, sf_dir)
    for k in (1, 2, 3):
        e.execute(f"INFER EDGES FROM '0' VIA near RETURNING TOP {k};")
    return e.execute("EXPLAIN HISTORY '0' LIMIT 2;").frame


# Writes

LOG = "l AS (SELECT event_id AS lsn, event_id // 10 AS tx_id, 'users' AS collection, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'EntityDelete' ELSE 'EntityWrite' END AS record, CAST(event_id AS VARCHAR) AS payload FROM events)"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: ten a transaction, every third transaction without its commit."""
    ev = table(spark, sf_dir, "events")
    first = ev.agg(F.min("event_type")).first()[0]
    rows = ev.select(
        F.col("event_id").alias("lsn"), F.floor(F.col("event_id") / 10).cast("long").alias("tx_id"), F.lit(0).cast("long").alias("ts"), F.when(F.col("event_type") == first, "EntityDelete").otherwise("EntityWrite").alias("record"),
        F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("payload"),
    )
    commits = rows.filter("tx_id % 3 <> 0").select(F.lit(-1).cast("long").alias("lsn"), "tx_id", "ts", F.lit("TxCommit").alias("record"), F.lit("").alias("collection"), F.lit("").alias("key"), F.lit(None).cast("string").alias("payload")).distinct()
    return rows.unionByName(commits)


LAST = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM l {})"


@query(f"WITH {LOG}, {LAST.format('')} SELECT collection, key, lsn, record FROM r WHERE n = 1")
def upsert_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).filter("record <> 'TxCommit'")
    return changelog.latest(rows.select("collection", "key", "lsn", "record"))


@query(f"WITH {LOG}, {LAST.format('WHERE tx_id % 3 <> 0')} SELECT collection, key, lsn, payload FROM r WHERE n = 1 AND record = 'EntityWrite'")
def wal_replay_committed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return changelog.state(log.unionByName(log))  # twice: the same


def written(name: str, sql: str, *texts: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = people(spark, sf_dir)
        for t in texts:
            out = e.execute(t)
        return out.frame

    run.__name__ = name
    query(f"WITH {PEOPLE} {sql}")(run)


written("update_entity", "SELECT id, CASE WHEN id = '7' THEN 'changed' ELSE name END AS name, CASE WHEN id = '7' THEN 1.5 ELSE balance END AS balance FROM c", "UPDATE '7' IN customers SET name = 'changed', balance = 1.5;", "FETCH name, balance FROM customers;")
written("insert_or_update", "SELECT id, name, balance FROM c WHERE id <> '7' UNION ALL SELECT '7', 'new', CAST(NULL AS DOUBLE) UNION ALL SELECT 'x', 'more', 2.5", "INSERT OR UPDATE INTO customers (id, name) VALUES ('7', 'new');", "INSERT INTO customers (id, name, balance) VALUES ('x', 'more', 2.5);", "FETCH name, balance FROM customers;")
written("alter_rename", "SELECT id, balance AS money FROM c", "ALTER COLLECTION customers RENAME FIELD balance TO money;", "FETCH money FROM customers;")
written("alter_drop", "SELECT id, name, nation_id, segment FROM c", "ALTER COLLECTION customers DROP FIELD balance;", "FETCH * FROM customers;")


written("alter_add_representation", "SELECT id, name FROM c", "ALTER COLLECTION customers ADD REPRESENTATION r DIMENSIONS 4 METRIC COSINE;", "FETCH name FROM customers;")
written("checkpoint_keeps_rows", "SELECT id, CASE WHEN id = '7' THEN 'changed' ELSE name END AS name FROM c", "UPDATE '7' IN customers SET name = 'changed';", "CHECKPOINT;", "FETCH name FROM customers;")
written("full_scan_hint", "SELECT id, name FROM c WHERE segment = 'BUILDING'", "FETCH /*+ FORCE_FULL_SCAN */ name FROM customers WHERE segment = 'BUILDING';")
written("fetch_like_prefix", "SELECT id, name FROM c WHERE name LIKE 'Customer#00000001%'", "FETCH name FROM customers WHERE name LIKE 'Customer#00000001%';")


def recovering(name: str, sql: str, *texts: str) -> None:
    """Statements in one engine, then definitions and rows in another over the same folder, from the log alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{_scratch(spark)}/engine"
        table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) as id", "n_name as name", "n_regionkey as region").write.json(f"{folder}-in")
        first = Engine(spark, folder)
        for t in ("CREATE COLLECTION nations (FIELD name TEXT, FIELD region INT);", f"IMPORT INTO nations FROM '{folder}-in';", "INSERT INTO nations (id, name, region) VALUES ('x', 'more', 9);", *texts):
            first.execute(t)
        again = Engine(spark, folder)
        again.recover()
        named = [f for f in again.catalog.collection("nations").table.schema.names if f in ("title", "name")][0]
        return again.execute(f"FETCH {named}, region FROM nations;").frame.withColumnRenamed(named, "name")

    run.__name__ = name
    query(sql)(run)


NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation"
recovering("recover_after_import", f"{NATIONS} UNION ALL SELECT 'x', 'more', 9")
recovering("recover_after_rename", f"{NATIONS} UNION ALL SELECT 'x', 'more', 9", "ALTER COLLECTION nations RENAME FIELD name TO title;")
MORE = f"SELECT id, CASE WHEN id = '3' THEN 'changed' ELSE name END AS name, region FROM ({NATIONS} UNION ALL SELECT 'x', 'more', 9) WHERE id <> '5'"
recovering("recover_from_checkpoint", MORE, "CHECKPOINT;", "UPDATE '3' IN nations SET name = 'changed';", "DELETE '5' FROM nations;")
recovering("recover_redefined_since_checkpoint", MORE, "CHECKPOINT;", "ALTER COLLECTION nations RENAME FIELD name TO title;", "UPDATE '3' IN nations SET title = 'changed';", "DELETE '5' FROM nations;")
recovering("recover_after_drop", "SELECT 'y' AS id, 'only' AS name, 1::BIGINT AS region", "DROP COLLECTION nations;", "CREATE COLLECTION nations (FIELD name TEXT, FIELD region INT);", "INSERT INTO nations (id, name, region) VALUES ('y', 'only', 1);")


@query("SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1.0::DOUBLE AS confidence, 'Structural' AS source FROM nation")
def recover_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge type and its edges come back from the log; a dropped one doesn't."""
    folder = f"{_scratch(spark)}/engine"
    first, rows = Engine(spark, folder), table(spark, sf_dir, "nation").collect()  # 25 rows
    first.execute("CREATE COLLECTION places (FIELD name TEXT);")
    for key in sorted({f"r{r.n_regionkey}" for r in rows} | {f"n{r.n_nationkey}" for r in rows}):
        first.execute(f"INSERT INTO places (id, name) VALUES ('{key}', 'place');")
    for kind in ("holds", "other"):
        first.execute(f"CREATE EDGE {kind} FROM places TO places DECAY EXPONENTIAL RATE 0.1 FLOOR 0.2;")
        for r in rows:
            first.execute(f"INSERT EDGE {kind} FROM 'r{r.n_regionkey}' TO 'n{r.n_nationkey}';")
    first.execute("DROP EDGE TYPE 'other';")
    again = Engine(spark, folder)
    again.recover()
    return reduce(DataFrame.unionByName, [e.frame for e in again.catalog.edges.values()]).select("src", "dst", "confidence", "source")


@query("SELECT CAST(o_custkey AS VARCHAR) AS src, count(*) AS n FROM orders WHERE o_custkey <> 7 GROUP BY o_custkey")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = placed(spark, sf_dir)
    e.execute("DELETE '7' FROM customers;")
    return e.catalog.edge("placed").frame.groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def import_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/nations"
    table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) as id", "n_name as name", "n_regionkey as region").write.json(path)
    e = Engine(spark)
    e.execute("CREATE COLLECTION nations (FIELD name TEXT, FIELD region INT);")
    e.execute(f"IMPORT INTO nations FROM '{path}';")
    return e.execute("FETCH name, region FROM nations;").frame


@query("SELECT CAST(o_custkey AS VARCHAR) AS src, count(*) AS n, max(CASE WHEN o_orderkey = 3 AND o_custkey = 1 THEN 1 ELSE 0 END)::BIGINT AS made FROM (SELECT DISTINCT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey FROM orders UNION ALL SELECT 1, 3)) GROUP BY o_custkey")
def insert_edge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = placed(spark, sf_dir)
    e.execute("INSERT EDGE placed FROM '1' TO '3' WITH (note = 'made') VALID FROM '2024-01-01';")
    made = F.max(F.when((F.col("src") == "1") & (F.col("dst") == "3"), 1).otherwise(0)).cast("long")
    return e.catalog.edge("placed").frame.groupBy("src").agg(F.count("*").alias("n"), made.alias("made"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS src, count(*) AS n FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders) GROUP BY o_custkey")
def delete_edge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = placed(spark, sf_dir)
    first = e.catalog.edge("placed").frame.orderBy(F.col("dst").cast("long")).first()
    for _ in range(2):  # deleting again is no error
        e.execute(f"DELETE EDGE placed FROM '{first.src}' TO '{first.dst}';")
    return e.catalog.edge("placed").frame.groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def backup_and_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = _scratch(spark), Engine(spark)
    e.register("nations", table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) as id", "n_name as name"))
    e.execute("CREATE COLLECTION again (FIELD name TEXT);")
    e.execute(f"BACKUP TO '{path}';")
    e.execute(f"IMPORT INTO again FROM '{path}/nations';")
    return e.execute("FETCH name FROM again;").frame


@query(f"WITH {VECTORS} {HITS} WHERE id NOT IN ('3', '5') ORDER BY s.score DESC, id LIMIT 10")
def demote_leaves_hot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, vector = embeddings(spark, sf_dir)
    e.execute("DEMOTE '3' FROM items TO ARCHIVE;")
    e.execute("DEMOTE '5' FROM items TO WARM;")
    e.execute("PROMOTE '5' FROM items;")  # comes back within half a step of 255
    return scored(e.execute(f"SEARCH items WHERE id != '5' NEAR VECTOR {vector} LIMIT 10;").frame, "label")


@query("SELECT * FROM (VALUES ('verb', 'TRAVERSE MATCH'), ('depth', '1..6'), ('estimated_acu', '18.0'), ('rules_applied', 'TraverseHopReorder')) AS t(property, value)")
def explain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = embeddings(spark, sf_dir)
    e.register_edges("near", "items", "items", spark.createDataFrame([], "src string, dst string"))
    df = e.execute("EXPLAIN TRAVERSE FROM '0' MATCH (a)-[r:near]->(b) DEPTH 1..6;").frame
    return df.filter(F.col("property").isin("verb", "depth", "estimated_acu", "rules_applied"))


def _scratch(spark: SparkSession) -> str:
    """A new folder under the one that executors share; a temporary one where there is none."""
    return f"{(spark.sparkContext.getConf().get('spark.checkpoint.dir') or tempfile.gettempdir()).rstrip('/')}/strandbase-{uuid.uuid4().hex}"


# Operations


@query("SELECT t.tier, count(d.doc_id) AS n FROM (VALUES ('Hot'), ('Warm'), ('Archive')) AS t(tier) LEFT JOIN documents d ON t.tier = CASE WHEN d.lang = 'en' THEN 'Hot' WHEN d.lang = 'fr' THEN 'Warm' END GROUP BY t.tier")
def explain_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    docs = table(spark, sf_dir, "documents").filter("lang in ('en', 'fr')")
    e.register("docs", docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "hot").otherwise("warm").alias("_tier")))
    return e.execute("EXPLAIN TIERS docs;").frame


@query("SELECT * FROM (VALUES ('estimated_acu', '165.0'), ('strategy', 'DenseSearch'), ('k', '100')) AS t(property, value)")
def explain_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, vector = embeddings(spark, sf_dir)
    return e.execute(f"EXPLAIN SEARCH items NEAR VECTOR {vector} LIMIT 100;").frame.filter(F.col("property").isin("estimated_acu", "strategy", "k"))


@query(
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM e GROUP BY vec_id)
    SELECT vec_id, i::INT AS i, round(lo + round((x - lo) / (hi - lo) * 255) / 255.0 * (hi - lo), 6) AS x FROM e JOIN b USING (vec_id)"""
)
def quantise_int8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = V.dequantise_int8(V.quantise_int8(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(back).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("SELECT vec_id, string_agg(CASE WHEN x >= 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id")
def quantise_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.quantise_binary(F.col("embedding")).alias("bits"))


@query("SELECT n_nationkey, sha256('recipe:v1:' || n_name || ':' || 'a,b,c') AS recipe FROM nation")
def recipe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(F.lit("b"), F.lit("c"), F.lit("a"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.recipe_hash(F.col("n_name"), fields).alias("recipe"))


TOGETHER = "p AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS x FROM lineitem), k AS (SELECT o, count(*) AS n FROM p GROUP BY o), s AS (SELECT a.x AS a, b.x AS b, sum(1.0 / (k.n - 1)) AS score FROM p a JOIN p b ON a.o = b.o AND a.x < b.x JOIN k ON k.o = a.o GROUP BY a.x, b.x)"


def together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order, a few line items."""
    rows = table(spark, sf_dir, "lineitem")
    parts = placement.parts_for(rows)
    return placement.cooccurrence(placement.sets_by(rows, "l_orderkey", "l_partkey", parts), "members", parts)


@query(f"WITH {TOGETHER} SELECT a, b, round(score, 6) AS score FROM s")
def cooccurrence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {TOGETHER} SELECT a, b, round(score * 0.95, 6) AS score, score * 0.95 >= 0.7 AS promoted FROM s WHERE score * 0.95 >= 0.01")
def affinity_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.promote_and_decay(together(spark, sf_dir)).withColumn("score", F.round("score", 6))


MEMBERS = "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implicit' ELSE 'none' END AS membership, c_custkey * 37 % 101 AS last_access FROM customer"


@query(f"WITH m AS ({MEMBERS}) SELECT id, membership, last_access, CASE membership WHEN 'explicit' THEN 2 WHEN 'implicit' THEN 1 ELSE 0 END AS priority FROM m ORDER BY priority, last_access, id LIMIT 50")
def eviction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as id", "case c_custkey % 3 when 0 then 'explicit' when 1 then 'implicit' else 'none' end as membership", "c_custkey * 37 % 101 as last_access")
    return placement.eviction_order(rows).limit(50)


IDLE = f"SELECT id, membership, {NOW} - last_access * 10000000 AS last_access, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'hot' ELSE 'warm' END AS tier, CASE membership WHEN 'explicit' THEN 2 WHEN 'implicit' THEN 1 ELSE 0 END AS priority FROM m"


@query(
    f"""WITH m AS ({MEMBERS}), i AS ({IDLE}), h AS (SELECT * FROM i WHERE tier = 'hot' AND {NOW} - last_access > 86400000 ORDER BY priority, last_access, id LIMIT 100),
    w AS (SELECT * FROM i WHERE tier = 'warm' AND {NOW} - last_access > 604800000 ORDER BY last_access, id LIMIT 100)
    SELECT id, 'hot' AS from_tier, 'warm' AS to_tier FROM h UNION ALL SELECT id, 'warm', 'archive' FROM w"""
)
def tier_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    membership = F.when(k % 3 == 0, "explicit").when(k % 3 == 1, "implicit").otherwise("none")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), membership.alias("membership"), (F.lit(NOW) - k * 37 % 101 * 10_000_000).alias("last_access"), F.when(k % 2 == 0, "hot").otherwise("warm").alias("_tier"))
    return placement.tier_cycle(rows, NOW)


@query("SELECT tier, n::BIGINT AS n FROM (SELECT 'Warm' AS tier, least(100, count_if(vec_id % 5 = 0)) AS n FROM embeddings UNION ALL SELECT 'Hot', count(*) - least(100, count_if(vec_id % 5 = 0)) FROM embeddings UNION ALL SELECT 'Archive', 0)")
def tier_cycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round moves a batch of the fifth of the rows that was idle."""
    e = Engine(spark, clock=lambda: NOW)
    rows = table(spark, sf_dir, "embeddings")
    e.register("items", rows, id="vec_id", representations=(DENSE,))
    idle = F.when(F.col("vec_id") % 5 == 0, 2 * placement.DAY_MS).otherwise(0)
    e.migrate_idle("items", rows.select(F.col("vec_id").cast("string").alias("id"), F.lit("none").alias("membership"), (F.lit(NOW) - idle).alias("last_access")))
    return e.execute("EXPLAIN TIERS items;").frame


SHARES = "s_suppkey, (s_suppkey % 10) / 10.0 AS ram, (s_suppkey % 7) / 7.0 AS queue, (s_suppkey % 5) / 5.0 AS cpu, (s_suppkey % 3) / 3.0 AS hnsw, (s_suppkey % 2) / 2.0 AS lag"
LOAD = "0.35 * ram + 0.30 * queue + 0.20 * cpu + 0.10 * hnsw + 0.05 * lag"


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = lambda k: ((F.col("s_suppkey") % k) / float(k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", mod(10).alias("ram"), mod(7).alias("queue"), mod(5).alias("cpu"), mod(3).alias("hnsw"), mod(2).alias("lag"))


@query(f"WITH s AS (SELECT {SHARES} FROM supplier) SELECT s_suppkey, round(({LOAD})::DOUBLE, 6) AS load FROM s")
def load_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir).select("s_suppkey", F.round(scalars.load_score(), 6).alias("load"))


@query(f"WITH s AS (SELECT {SHARES} FROM supplier) SELECT s_suppkey, round((0.40 * (1.0 - ({LOAD})) + 0.30 * cpu + 0.30 * lag)::DOUBLE, 6) AS score FROM s")
def routing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shares(spark, sf_dir).withColumn("load", scalars.load_score()).withColumnsRenamed({"cpu": "verb_fit", "lag": "locality"})
    return rows.select("s_suppkey", F.round(scalars.routing_score(), 6).alias("score"))


@query(f"WITH s AS (SELECT {SHARES}, s_suppkey * 100 % 900 AS silent FROM supplier) SELECT s_suppkey AS node, round((0.40 * (1.0 - ({LOAD})) + 0.30 * cpu + 0.30 * lag)::DOUBLE, 6) AS score FROM s WHERE s_suppkey % 7 <> 0 AND silent <= 600 AND {LOAD} < 0.6")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    nodes = shares(spark, sf_dir).withColumn("load", scalars.load_score()).withColumnsRenamed({"cpu": "verb_fit", "lag": "locality"})
    nodes = nodes.withColumn("silent_ms", k * 100 % 900).withColumn("status", F.when(k % 7 == 0, "faulted").otherwise("healthy")).withColumnRenamed("s_suppkey", "node")
    return placement.route(nodes, shed_at=0.6).select("node", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT {SHARES}, s_suppkey * 11 % 700 AS q, s_suppkey % 30 AS p, s_suppkey * 100 % 6000 AS silent FROM supplier) SELECT s_suppkey, CASE WHEN silent > 5000 THEN 'faulted' WHEN {LOAD} >= 0.85 THEN 'overloaded' WHEN cpu >= 0.75 OR ram >= 0.85 OR q >= 500 OR p >= 20 THEN 'degraded' ELSE 'healthy' END AS status FROM s")
def node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return shares(spark, sf_dir).select(k, scalars.node_status(scalars.load_score(), F.col("cpu"), F.col("ram"), k * 11 % 700, k % 30, k * 100 % 6000).alias("status"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'CleanupSource' WHEN s_suppkey % 2 = 0 THEN 'ReExecute' WHEN s_suppkey % 3 = 0 THEN 'AlreadyComplete' ELSE 'NoAction' END AS action FROM supplier")
def migration_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("s"), (F.col("s_suppkey") % 3 == 0).alias("t"))
    return rows.select("s_suppkey", placement.migration_action("s", "t").alias("action"))


# Streams


@query(f"WITH {LOG}, {LAST.format('WHERE tx_id % 3 <> 0')} SELECT collection, key, lsn, payload FROM r WHERE n = 1 AND record = 'EntityWrite'")
def stream_change_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed part of the log in files, followed as a stream in several batches."""
    folder = _scratch(spark)
    rows = changelog.committed(event_log(spark, sf_dir)).repartition(4)
    rows.select("lsn", "tx_id", "ts", "record", "collection", "key", "payload").write.json(f"{folder}/log")
    streams.follow_state(streams.read_log(spark, f"{folder}/log", 2), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return streams.followed_state(spark, f"{folder}/state")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS window_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_to_table(streams.tumbling(ev, "ts", "1 hour", "1 hour", "event_type"), f"tumbling_{uuid.uuid4().hex}", "complete")
    zone = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(window_start as timestamp_ntz)) * 1000"
    return out.select(F.expr(zone).cast("long").alias("window_ms"), "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph, vectors and top-k in one plan."""
    return QUERIES["search_within"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]

import pytest

from strandbase import errors as E
from strandbase.engine import Engine
from strandbase.functions.temporal import millis

DAY = 86_400_000


@pytest.fixture
def engine(spark):
    return Engine(spark, clock=lambda: 1_700_000_000_000)


def ids(result):
    return [r["id"] for r in result.rows()]


def run(engine, *texts):
    for t in texts:
        out = engine.execute(t)
    return out


#: id, name, kind, grams; the last has a name only.
TOOLS = [("t1", "claw hammer", "hand", 560), ("t2", "drill", "power", 1800), ("t3", "club hammer", "hand", 1130), ("t4", "file", "hand", 240), ("t5", "jigsaw", "power", 2400)]


@pytest.fixture
def tools(engine):
    run(engine, "CREATE COLLECTION tools (FIELD name TEXT, FIELD kind TEXT, FIELD grams INT, FIELD price FLOAT, INDEX by_kind ON (kind));")
    for key, name, kind, grams in TOOLS:
        run(engine, f"INSERT INTO tools (id, name, kind, grams) VALUES ('{key}', '{name}', '{kind}', {grams});")
    run(engine, "INSERT INTO tools (id, name) VALUES ('t6', 'unsorted');")
    return engine


@pytest.mark.parametrize(
    "where, expected",
    [
        ("kind = 'power'", "t2 t5"),
        ("kind != 'power'", "t1 t3 t4 t6"),
        ("NOT kind = 'power'", "t1 t3 t4 t6"),
        ("NOT kind != 'power'", "t2 t5"),
        ("grams > 1130", "t2 t5"),
        ("grams >= 1130", "t2 t3 t5"),
        ("grams < 560", "t4"),
        ("grams <= 560.0", "t1 t4"),
        ("NOT grams > 1130", "t1 t3 t4 t6"),
        ("kind IN ('hand', 'power')", "t1 t2 t3 t4 t5"),
        ("kind IN ('power', NULL)", "t2 t5 t6"),
        ("NOT kind IN ('hand')", "t2 t5 t6"),
        ("name LIKE '%hammer'", "t1 t3"),
        ("name LIKE 'cl__ h%'", "t1 t3"),
        ("name LIKE '_i%'", "t4 t5"),
        ("grams IS NULL", "t6"),
        ("grams IS NOT NULL AND kind = 'hand'", "t1 t3 t4"),
        ("kind = 'hand' OR kind = 'power' AND grams > 1500", "t2 t5"),
        ("colour = 1", ""),
        ("colour != 1", "t1 t2 t3 t4 t5 t6"),
        ("colour IS NULL", "t1 t2 t3 t4 t5 t6"),
        ("kind = NULL", "t6"),
        ("kind > 'i'", "t2 t5"),
        ("kind > 5", ""),
        ("id = 't4'", "t4"),
        ("id > 't4'", ""),
    ],
)
def test_conditions(tools, where, expected):
    assert sorted(ids(run(tools, f"FETCH * FROM tools WHERE {where};"))) == expected.split()


def test_strict_types(spark, tools):
    tools.strict = True
    assert ids(run(tools, "FETCH * FROM tools WHERE grams = 560.0;")) == []
    assert ids(run(tools, "FETCH * FROM tools WHERE grams >= 2400.0;")) == []
    assert ids(run(tools, "FETCH * FROM tools WHERE grams > 1800.5;")) == ["t5"]


def test_projection_sort_and_limit(tools):
    out = run(tools, "FETCH name, colour, name FROM tools ORDER BY grams DESC LIMIT 2;")
    assert out.frame.columns == ["id", "name", "colour"]
    assert ids(out) == ["t6", "t5"]  # NULL first when descending
    assert ids(run(tools, "FETCH * FROM tools ORDER BY grams ASC;"))[-1] == "t6"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as string) id", "id as v").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.register("t", spark.read.parquet(str(tmp_path / "t")))
    plan = e.execute("FETCH v FROM t WHERE v = 5 AND v > 2;").frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,5)" in plan


def test_undeclared_fields_and_replacement(engine):
    run(engine, "CREATE COLLECTION c (FIELD a INT);", "INSERT INTO c (id, a, extra) VALUES ('x', 1, 'new');", "INSERT INTO c (id, a) VALUES ('x', 2);", "INSERT INTO c (id, a) VALUES ('y', 1.5);")
    rows = {r["id"]: r for r in run(engine, "FETCH a, extra FROM c;").rows()}
    assert rows["x"]["a"] == 2 and rows["x"]["extra"] is None and rows["y"]["a"] == 1.5
    out = run(engine, "INSERT INTO c (a) VALUES (3);").rows()[0]["id"]
    assert len(out) == 36


def test_temporal(engine):
    run(engine, "CREATE COLLECTION h (FIELD name TEXT);")
    run(engine, "INSERT INTO h (id, name) VALUES ('p', 'Past') VALID FROM '2024-01-01' TO '2024-07-01';", "INSERT INTO h (id, name) VALUES ('n', 'Now') VALID FROM '2024-06-01';")
    assert ids(run(engine, "FETCH * FROM h AS OF '2024-08-01';")) == ["n"]
    assert sorted(ids(run(engine, "FETCH * FROM h AS OF '2024-06-15T00:00:00Z';"))) == ["n", "p"]
    assert ids(run(engine, "FETCH * FROM h AS OF '2024-07-01';")) == ["n"]
    assert ids(run(engine, "FETCH * FROM h VALID DURING '2024-01-01'..'2024-06-01';")) == ["p"]
    tx = {r["id"]: r["tx_time"] for r in run(engine, "FETCH * FROM h;").rows()}
    assert ids(run(engine, f"FETCH * FROM h AS OF TRANSACTION {tx['p']};")) == ["p"]
    with pytest.raises(E.InvalidQuery):
        run(engine, "FETCH * FROM h AS OF 'yesterday';")
    assert millis("1970-01-02") == DAY


@pytest.fixture
def people(engine):
    run(engine, "CREATE COLLECTION people (FIELD name TEXT, FIELD venue_id TEXT);", "CREATE COLLECTION venues (FIELD address TEXT, FIELD area TEXT);", "CREATE EDGE likes FROM people TO venues;")
    run(engine, "INSERT INTO people (id, name, venue_id) VALUES ('p1', 'Alice', 'v1');", "INSERT INTO people (id, name, venue_id) VALUES ('p2', 'Bob', 'none');")
    run(engine, "INSERT INTO venues (id, address, area) VALUES ('v1', 'Main St', 'x');", "INSERT INTO venues (id, address, area) VALUES ('v2', 'High St', 'x');")
    return engine


def test_joins(people):
    get = lambda how: sorted((r["p.id"] or "-", r["v.id"] or "-") for r in run(people, f"FETCH * FROM people AS p {how} JOIN venues AS v ON p.venue_id = v.id;").rows())
    assert get("INNER") == [("p1", "v1")]
    assert get("LEFT") == [("p1", "v1"), ("p2", "-")]
    assert get("RIGHT") == [("-", "v2"), ("p1", "v1")]
    assert get("FULL") == [("-", "v2"), ("p1", "v1"), ("p2", "-")]
    out = run(people, "FETCH p.name, v.address FROM people AS p JOIN venues AS v ON p.venue_id = v.id WHERE v.address = 'Main St';")
    assert out.rows() == [{"p.name": "Alice", "v.address": "Main St"}]


def test_join_takes_the_first_match_only(people):
    run(people, "INSERT INTO people (id, name, venue_id) VALUES ('p3', 'Carol', 'x');")
    out = run(people, "FETCH p.id, v.id FROM people AS p JOIN venues AS v ON p.venue_id = v.area;").rows()
    assert out == [{"p.id": "p3", "v.id": "v1"}]


def test_confidence_join(people):
    run(people, "CONFIRM EDGE FROM 'p1' TO 'v1' TYPE likes CONFIDENCE 0.6;", "CONFIRM EDGE FROM 'p1' TO 'v2' TYPE likes CONFIDENCE 0.9;")
    text = "FETCH p.id, v.id FROM people AS p {} JOIN venues AS v ON p.id = v.id CONFIDENCE > {};"
    assert [(r["v.id"], r["_edge.confidence"]) for r in run(people, text.format("INNER", 0.5)).rows()] == [("v2", 0.9)]
    assert [r["v.id"] for r in run(people, text.format("LEFT", 0.95) ).rows()] == [None, None]


@pytest.fixture
def items(engine):
    run(engine, "CREATE COLLECTION items (REPRESENTATION dense DIMENSIONS 3 METRIC COSINE, REPRESENTATION words SPARSE true, FIELD name TEXT, FIELD city TEXT, INDEX by_city ON (city));", "CREATE EDGE link FROM items TO items;")
    for i, v, city in (("a", "1,0,0", "L"), ("b", "0.9,0.1,0", "P"), ("c", "0.8,0.2,0", "L"), ("d", "0,0,1", "L"), ("e", "0,1,0", "P")):
        words = {"a": "[1:0.9]", "b": "[1:0.1, 2:0.5]"}.get(i, "[3:0.5]")
        run(engine, f"INSERT INTO items (id, name, city) VALUES ('{i}', 'n{i}', '{city}') REPRESENTATION dense VECTOR [{v}] REPRESENTATION words SPARSE {words};")
    run(engine, "INSERT EDGE link FROM 'a' TO 'b';", "INSERT EDGE link FROM 'b' TO 'c';", "INSERT EDGE link FROM 'c' TO 'a';")
    return engine


def test_search(items):
    out = run(items, "SEARCH items NEAR VECTOR [1, 0, 0] LIMIT 3;")
    assert ids(out) == ["a", "b", "c"] and out.mode == "Probabilistic" and out.rows()[0]["_score"] == pytest.approx(1.0)
    assert ids(run(items, "SEARCH items NEAR VECTOR [1, 0, 0] CONFIDENCE > 0.98;")) == ["a", "b"]
    assert ids(run(items, "SEARCH items WHERE city = 'L' NEAR VECTOR [1, 0, 0] LIMIT 2;")) == ["a", "c"]
    assert ids(run(items, "SEARCH items NEAR SPARSE [1:1.0];")) == ["a", "b"]
    hybrid = run(items, "SEARCH items NEAR VECTOR [1, 0, 0] NEAR SPARSE [1:1.0] LIMIT 2;").rows()
    assert [r["id"] for r in hybrid] == ["a", "b"] and hybrid[0]["_score"] == pytest.approx(2 / 61)
    with pytest.raises(E.DimensionMismatch):
        run(items, "SEARCH items NEAR VECTOR [1, 0];")
    with pytest.raises(E.InvalidQuery):
        run(items, "SEARCH items NEAR VECTOR [0, 0, 0];")


def test_search_plan_keeps_a_top_k(items):
    plan = run(items, "SEARCH items NEAR VECTOR [1, 0, 0] LIMIT 3;").frame._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_search_within_a_neighbourhood(items):
    assert ids(run(items, "SEARCH items NEAR VECTOR [1, 0, 0] WITHIN (TRAVERSE FROM 'a' MATCH (x)-[l:link]->(y) DEPTH 1..2);")) == ["b", "c"]


def test_traversal(items):
    assert ids(run(items, "TRAVERSE link FROM 'a' DEPTH 5;")) == ["b", "c"]  # the cycle ends
    assert ids(run(items, "TRAVERSE link FROM 'a' DEPTH 5 LIMIT 1;")) == ["b"]
    get = lambda pattern, depth: [(r["id"], r["_depth"]) for r in run(items, f"TRAVERSE FROM 'a' MATCH {pattern} DEPTH {depth};").rows()]
    assert get("(x)-[:link]->(y)", "1..2") == [("b", 1), ("c", 2)]
    assert get("(x)-[:link]->(y)", "2..2") == [("c", 2)]
    assert get("(x)<-[:link]-(y)", "1..1") == [("c", 1)]
    assert get("(x)-[:link]-(y)", "1..1") == [("b", 1), ("c", 1)]
    assert get("(x)-[]->(y)", "1..1") == [("b", 1)]


def test_match_confidence_and_type_column(items):
    run(items, "CONFIRM EDGE FROM 'a' TO 'e' TYPE link CONFIDENCE 0.4;")
    out = run(items, "TRAVERSE FROM 'a' MATCH (x)-[:link]->(y) DEPTH 1..1 CONFIDENCE > 0.5;").rows()
    assert [(r["id"], r["_edge_confidence"], r["_edge_type"]) for r in out] == [("b", 1.0, "link")]
    assert "_edge_type" not in run(items, "TRAVERSE FROM 'a' MATCH (x)-[]->(y) DEPTH 1..1;").frame.columns


def test_delete_cascades(items):
    run(items, "DELETE 'b' FROM items;")
    assert ids(run(items, "TRAVERSE link FROM 'a' DEPTH 5;")) == []
    assert ids(run(items, "TRAVERSE link FROM 'c' DEPTH 5;")) == ["a"]
    with pytest.raises(E.EntityNotFound):
        run(items, "DELETE 'b' FROM items;")


def test_inference_lifecycle(engine):
    run(engine, "CREATE COLLECTION dishes (REPRESENTATION taste DIMENSIONS 2 METRIC COSINE);", "CREATE COLLECTION wines (REPRESENTATION taste DIMENSIONS 2 METRIC COSINE);")
    run(engine, "CREATE EDGE goes_with FROM dishes TO wines DECAY EXPONENTIAL RATE 0.002 PRUNE 0.3 INFER AUTO CONFIDENCE > 0.8 LIMIT 4;")
    run(engine, "INSERT INTO dishes (id) VALUES ('stew') REPRESENTATION taste VECTOR [4, 3];")
    run(engine, "INSERT INTO wines (id) VALUES ('red') REPRESENTATION taste VECTOR [3, 2];", "INSERT INTO wines (id) VALUES ('sweet') REPRESENTATION taste VECTOR [-1, 2];")
    out = run(engine, "INFER EDGES FROM 'stew' RETURNING TOP 7;").rows()
    assert [r["to_id"] for r in out] == ["red", "sweet"] and out[0]["edge_type"] == "goes_with"
    assert [r["to_id"] for r in run(engine, "INFER EDGES FROM 'stew' VIA goes_with RETURNING ALL CONFIDENCE > 0.7;").rows()] == ["red"]
    run(engine, "CONFIRM EDGE FROM 'stew' TO 'red' TYPE goes_with CONFIDENCE 0.75;")
    assert ids(run(engine, "TRAVERSE goes_with FROM 'stew';")) == ["red"]
    assert [r["to_id"] for r in run(engine, "INFER EDGES FROM 'stew' RETURNING TOP 7;").rows()] == ["sweet"]
    history = run(engine, "EXPLAIN HISTORY 'stew' LIMIT 2;").rows()
    assert [h["trigger"] for h in history] == ["Explicit", "Explicit"]
    run(engine, "INSERT INTO wines (id) VALUES ('rose') REPRESENTATION taste VECTOR [5, 3];")
    assert engine.infer_queued() == 1  # red is linked, sweet is below the threshold
    held = lambda: {(r.dst, r.source) for r in engine.catalog.edge("goes_with").frame.collect()}
    assert held() == {("red", "Confirmed"), ("rose", "Inferred")}
    engine.clock = lambda: 1_700_000_000_000 + 10_000_000
    assert engine.sweep_decayed() == 1 and held() == {("red", "Confirmed")}


def test_confirm_rules(items):
    with pytest.raises(E.InvalidQuery):
        run(items, "CONFIRM EDGE FROM 'a' TO 'b' TYPE link CONFIDENCE 0.5;")
    run(items, "CONFIRM EDGE FROM 'a' TO 'zzz' TYPE link CONFIDENCE 0.5;", "CONFIRM EDGE FROM 'a' TO 'zzz' TYPE link CONFIDENCE 0.7;")
    assert items.catalog.edge("link").table.get("a", "zzz")["confidence"] == 0.7


def test_dirty_representations(engine):
    run(engine, "CREATE COLLECTION v (REPRESENTATION semantic DIMENSIONS 8 METRIC COSINE FIELDS (name), FIELD name TEXT);")
    run(engine, "INSERT INTO v (id, name) VALUES ('v1', 'one');", "INSERT INTO v (id, name) VALUES ('v2', 'two');")
    assert len(ids(run(engine, "SEARCH v NEAR 'anything';"))) == 2
    before = engine.catalog.collection("v").table.get("v1")["semantic"]
    run(engine, "UPDATE 'v1' IN v SET name = 'other';")
    assert ids(run(engine, "SEARCH v NEAR 'anything';")) == ["v2"]
    assert engine.recompute_dirty("v") == 1
    assert sorted(ids(run(engine, "SEARCH v NEAR 'anything';"))) == ["v1", "v2"]
    after = engine.catalog.collection("v").table.get("v1")["semantic"]
    expected = engine.vectoriser("v", "semantic").encode({"name": "other"})
    assert after != before and after == pytest.approx(expected)


def test_alterations(items):
    run(items, "ALTER COLLECTION items RENAME FIELD name TO title;")
    assert run(items, "FETCH title FROM items WHERE id = 'a';").rows() == [{"id": "a", "title": "na"}]
    run(items, "ALTER COLLECTION items DROP FIELD title;")
    assert "title" not in run(items, "FETCH * FROM items;").frame.columns
    run(items, "ALTER COLLECTION items ADD REPRESENTATION extra DIMENSIONS 4 METRIC COSINE FIELDS (city);")
    assert items.recompute_dirty("items") == 5
    assert len(ids(run(items, "SEARCH items NEAR 'x' USING extra;"))) == 5
    with pytest.raises(E.DuplicateName):
        run(items, "ALTER COLLECTION items ADD REPRESENTATION extra METRIC COSINE;")
    with pytest.raises(E.InvalidQuery):
        run(items, "ALTER COLLECTION items RENAME FIELD nothing TO x;")


def test_tiers(items):
    run(items, "DEMOTE 'a' FROM items TO WARM;", "DEMOTE 'b' FROM items TO ARCHIVE;")
    assert {r["tier"]: r["n"] for r in run(items, "EXPLAIN TIERS items;").rows()} == {"Hot": 3, "Warm": 1, "Archive": 1}
    assert ids(run(items, "SEARCH items NEAR VECTOR [1, 0, 0] LIMIT 1;")) == ["c"]
    run(items, "PROMOTE 'a' FROM items;")
    assert ids(run(items, "SEARCH items NEAR VECTOR [1, 0, 0] LIMIT 1;")) == ["a"]
    with pytest.raises(E.InvalidStateTransition):
        run(items, "PROMOTE 'a' FROM items;")


def test_backup_and_import(items, tmp_path):
    said = run(items, f"BACKUP TO '{tmp_path}/b';").rows()[0]
    assert said == {"schemas": 1, "entities": 5}
    run(items, "CREATE COLLECTION copy (FIELD name TEXT);")
    assert run(items, f"IMPORT INTO copy FROM '{tmp_path}/b/items';").rows() == [{"imported": 5}]
    assert run(items, "FETCH name FROM copy WHERE id = 'c';").rows() == [{"id": "c", "name": "nc"}]
    assert "IMPORT" in run(items, "RESTORE FROM 'x';").rows()[0]["result"]


def test_explain_and_budget(items):
    props = {r["property"]: r["value"] for r in run(items, "EXPLAIN FETCH * FROM items WHERE city = 'L' ORDER BY name DESC LIMIT 3;").rows()}
    assert props["strategy"] == "FieldIndexLookup (by_city)" and props["estimated_acu"] == "2.0" and props["order_by"] == "name DESC"
    props = {r["property"]: r["value"] for r in run(items, "EXPLAIN FETCH * FROM items;").rows()}
    assert props["strategy"] == "FullScan" and props["estimated_acu"] == "2.5"
    props = {r["property"]: r["value"] for r in run(items, "EXPLAIN SEARCH items NEAR VECTOR [1, 0, 0] LIMIT 100;").rows()}
    assert props["estimated_acu"] == "165.0" and props["two_pass"] == "first_pass_k=300"
    with pytest.raises(E.BudgetExceeded):
        run(items, "SEARCH /*+ MAX_ACU(10) */ items NEAR VECTOR [1, 0, 0];")
    assert any("TraverseHopReorder" in w for w in run(items, "TRAVERSE link FROM 'a' DEPTH 6;").warnings)


def test_definition_errors(engine):
    run(engine, "CREATE COLLECTION c (FIELD a INT);")
    for text, error in (
        ("CREATE COLLECTION c (FIELD a INT);", E.CollectionExists),
        ("CREATE COLLECTION d (FIELD a INT, FIELD a TEXT);", E.DuplicateName),
        ("CREATE EDGE e FROM c TO nothing;", E.CollectionNotFound),
        ("FETCH * FROM nothing;", E.CollectionNotFound),
        ("TRAVERSE nothing FROM 'a';", E.EdgeTypeNotFound),
        ("UPDATE 'x' IN c SET a = 1;", E.EntityNotFound),
    ):
        with pytest.raises(error):
            run(engine, text)
    run(engine, "DROP COLLECTION c;", "CREATE COLLECTION c (FIELD b INT);", "CREATE EDGE e FROM c TO c;", "DROP EDGE TYPE 'e';")


def test_affinity(engine):
    run(engine, "CREATE COLLECTION c (FIELD a INT);", "CREATE AFFINITY GROUP 'g';", "INSERT INTO c (id) VALUES ('x') AFFINITY GROUP 'g';", "INSERT INTO c (id) VALUES ('y') COLLOCATE WITH ('x', 'z');")
    assert engine.groups["g"] == {"x"}
    run(engine, "ALTER ENTITY 'x' DROP AFFINITY GROUP;")
    assert engine.groups["g"] == set()
    assert {(r.a, r.b): r.score for r in engine.cooccurrence().collect()} == {("x", "y"): 0.5, ("x", "z"): 0.5, ("y", "z"): 0.5}


def test_changes_are_folded_in(spark, tmp_path):
    e = Engine(spark, folder=str(tmp_path))
    run(e, "CREATE COLLECTION c (FIELD a INT);", *[f"INSERT INTO c (id, a) VALUES ('{i}', {i});" for i in range(5)], "CHECKPOINT;", "UPDATE '3' IN c SET a = 33;", "DELETE '1' FROM c;")
    assert e.catalog.collection("c").table.version == 1
    assert sorted((r["id"], r["a"]) for r in run(e, "FETCH a FROM c;").rows()) == [("0", 0), ("2", 2), ("3", 33), ("4", 4)]


def test_recovery_from_the_log(spark, tmp_path):
    define = ["CREATE COLLECTION c (FIELD a INT, REPRESENTATION d DIMENSIONS 2 METRIC COSINE, REPRESENTATION s SPARSE true);", "CREATE EDGE e FROM c TO c;"]
    first = Engine(spark, folder=str(tmp_path))
    run(first, *define, "INSERT INTO c (id, a) VALUES ('x', 1) REPRESENTATION d VECTOR [1, 0] REPRESENTATION s SPARSE [3:0.5];", "INSERT INTO c (id, a) VALUES ('y', 2);", "INSERT INTO c (id, a) VALUES ('z', 3);", "INSERT EDGE e FROM 'x' TO 'y';", "INSERT EDGE e FROM 'x' TO 'z';", "UPDATE 'y' IN c SET a = 5;", "DELETE 'z' FROM c;")
    second = Engine(spark, folder=str(tmp_path))
    run(second, *define)
    for _ in range(2):
        assert second.recover() == 3
    assert sorted((r["id"], r["a"]) for r in run(second, "FETCH a FROM c;").rows()) == [("x", 1), ("y", 5)]
    assert ids(run(second, "SEARCH c NEAR VECTOR [1, 0.1];")) == ["x"] == ids(run(second, "SEARCH c NEAR SPARSE [3:1.0];"))
    assert ids(run(second, "TRAVERSE e FROM 'x';")) == ["y"]
    assert second.metrics["Search"] == 2


def test_command_line(spark, tmp_path, capsys):
    from strandbase.__main__ import main

    spark.range(3).selectExpr("id", "id * 2 as v").write.parquet(str(tmp_path / "t"))
    assert main(["--table", f"t={tmp_path}/t:id", "-e", "FETCH v FROM t WHERE v > 1 ORDER BY v; FETCH * FROM nothing;"], spark) == 1
    out = capsys.readouterr()
    assert '{"id": "1", "v": 2}' in out.out and "CollectionNotFound" in out.err

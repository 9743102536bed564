"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, mih, packing, quality, rules, secrets, simhash, tokens, toxicity, warc
from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table with texts, spread over all cores."""
    return spread(table(spark, sf_dir, name))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(texts(spark, sf_dir), batches=2)  # the second skips the blobs of the first


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), k=10, every=50)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(texts(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(texts(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(texts(spark, sf_dir, "pages"), least_bytes=0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_token_ids,
        op3_exact_topk,
        op4_quality_classifier,
        op5_quality_rules,
        op6_toxicity,
        op7_byte_bpe,
        op8_simhash_near_dedup,
        op9_best_fit_packing,
        op10_warc,
    )
}


def _spans(rule: secrets.Rule, order: int) -> str:
    """Matches and the pieces between them give the places; a run that is too short has no longer match inside it."""
    p = rule.pattern.replace("'", "''")
    places = f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, m[i] AS m, v[i] AS v, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS a"
    return (
        f"SELECT doc_id, o, kind, a, a + length(m) AS b FROM ({places} FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM"
        f" (SELECT doc_id, regexp_extract_all(x, '{p}', 0) AS m, regexp_extract_all(x, '{p}', {rule.group}) AS v, string_split_regex(x, '{p}') AS g FROM t WHERE regexp_matches(x, '{p}')))) WHERE length(v) >= {rule.least}"
    )


_BITS = "SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i::INT ELSE 0 END)) AS code FROM embeddings"

ORACLES: dict[str, str] = {
    "op1_secret_scans": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), f AS ({" UNION ALL ".join(_spans(r, i) for i, r in enumerate(secrets.RULES))}),
        s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans FROM f GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t.x) AS blob
        FROM t LEFT JOIN s USING (doc_id)""",
    "op3_exact_topk": f"""WITH c AS ({_BITS}), d AS (SELECT q.id AS query_id, c.id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c AS q JOIN c ON q.id <> c.id WHERE q.id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d QUALIFY rank <= 10""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p),
        s AS (SELECT page_id, last, octet_length(encode(html))::BIGINT AS payload_bytes, unhex(sha1(html)) AS h FROM m),
        SELECT page_id, payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0b' || substr(bits, (5 * i + 1)::INT, 5))::INT), 1), '' ORDER BY i) FROM range(32) AS r(i)) AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM (SELECT *, h::BIT::VARCHAR AS bits FROM s)""",
}

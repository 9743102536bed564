"""Every operator and stage over nulls, empty, very long and repeated texts, clashing columns and empty tables."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from strandbase.llm import bpe, mih, packing, quality, rules, secrets, simhash, tokens, toxicity, warc

from .conftest import CLASHING, TEXTS

OPERATORS = {
    "secrets": lambda d, lab: secrets.secret_digest(d),
    "tokens": lambda d, lab: tokens.token_ids(d, P.path("word_bpe_49k.json")),
    "quality": lambda d, lab: quality.quality_scores(d, lab),
    "rules": lambda d, lab: rules.judge(d),
    "toxicity": lambda d, lab: toxicity.toxicity_scores(d, lab),
    "bpe": lambda d, lab: bpe.encode_decode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "simhash": lambda d, lab: simhash.simhash_digest(d),
    "packing": lambda d, lab: packing.pack_documents(d, P.path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, awkward, labels):
    rows = OPERATORS[name](awkward, labels).collect()
    ids = [r.doc_id for r in rows]
    expected = [i for i, *_ in TEXTS]
    if name == "packing":
        assert sorted(set(ids), key=str) == sorted(set(expected), key=str)
    else:
        assert sorted(ids, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(name, nothing, labels):
    assert OPERATORS[name](nothing, labels).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_without_labels(name, awkward, labels):
    rows = OPERATORS[name](awkward, labels.limit(0)).collect()
    assert {r.score for r in rows} == {1.0 if name == "quality" else 0.0}


@pytest.fixture
def sf_dir(labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(name, stage, spark, awkward, sf_dir):
    out = stage(spark, awkward, sf_dir)
    rows = out.collect()
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
        assert all(r[c] == "clash" for r in rows for c in CLASHING)
    if name == "simhash_near_dedup":
        kept = [r.doc_id for r in rows if r.doc_id is not None]
        assert len(kept) == len(set(kept)) and 1 in kept and 2 not in kept
        assert None in [r.doc_id for r in rows]
    if name == "secret_scans":
        text = {r.doc_id: r for r in rows}
        assert text[8].text == "[REDACTED]\" and [REDACTED]\n[REDACTED]" and text[8].n_chars == len(text[8].text)
        assert text[3].text is None and text[1].text == TEXTS[0][1]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(name, stage, spark, nothing, sf_dir):
    assert stage(spark, nothing, sf_dir).collect() == []


def test_pages(spark):
    rows = [(1, "http://a b/", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (None, "u", "<p>x</p>", "c"), (4, "u", None, "c"), (5, "u", "", "c"), (5, "u", "", "c"), (6, "u", "é" * 300_000, "c")]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, address string")).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=str)
    assert got == sorted([(1, 8, "revisit", 2), (2, 8, "response", None), (None, 8, "response", None), (4, 0, "revisit", 5), (5, 0, "response", None), (5, 0, "response", None), (6, 600_000, "response", None)], key=str)
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_vectors(spark):
    rows = [(50, [1.0] * 64, 1), (51, [1.0] * 64, 1), (52, None, 1), (None, [1.0] * 64, 1), (100, [-1.0] * 64, 1), (53, [1.0] * 63 + [-1.0], 1), (54, [], 1)]
    out = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in out) == [(50, 1, 51, 0), (50, 2, 53, 1), (100, 1, 54, 0), (100, 2, 53, 63)]
    assert mih.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []

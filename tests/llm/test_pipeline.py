import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from strandbase.llm import packing

from .test_secrets_and_rules import brute
from .test_simhash import near_by_several, plain_components, plain_several

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    from strandbase.llm.common import stage

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity_filter", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:-1])


def test_filters_follow_the_labels(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept, clean = set(rows(steps[0])), set(rows(steps[1]))
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    assert sum(good) >= 0.99 * len(good) and not any(r.doc_id in kept for r in labels if r.quality == 0)
    ordinary = [r.doc_id in clean for r in labels if r.toxic == 0 and r.quality == 1]
    assert sum(ordinary) >= 0.99 * len(ordinary) and clean <= kept


def test_near_dedup_against_brute_force(steps):
    before, after = rows(steps[1]), rows(steps[2])
    fps = {i: plain_several(r.text) for i, r in before.items()}
    of = plain_components(set(fps.values()), near_by_several)
    least = {}
    for i, f in fps.items():
        least[of[f]] = min(least.get(of[f], i), i)
    assert set(after) == set(least.values()) and all(after[i] == before[i] for i in after)


def test_redaction_against_brute_force(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert set(before) == set(after)
    for i, r in before.items():
        text, at, out = r.text, 0, ""
        for span in filter(None, brute(r.text).split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                out += text[at : int(a)] + "[REDACTED]"
            at = max(at, int(b))
        assert after[i].text == out + text[at:] and after[i].n_chars == len(after[i].text)


def test_packing_holds_every_document(steps):
    docs, sequences, pieces = rows(steps[3]), {}, {}
    for r in steps[4].collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert set(pieces) == set(docs)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= 1.02 * -(-sum(pieces.values()) // packing.CAPACITY) + 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(pieces[i] == len(t.encode(docs[i].text, add_special_tokens=False).ids) + 1 for i in list(docs)[:50])


def test_run_is_the_stages_one_after_another(spark, steps):
    a, b = (sorted((r.doc_id, r.piece, r.length) for r in df.collect()) for df in (corpus_pipeline.run(spark, SF), steps[-1]))
    assert a == b


def test_all_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Words counted where the texts lie."""

from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from strandbase.functions import words

TEXTS = [("1", "The the OF  with"), ("2", None), ("3", "   "), ("4", "of of über Straße"), ("5", "the " * 3000 + "end"), ("6", "")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def right(rows):
    counts: dict = {}
    for i, text in rows:
        if text is not None:
            counts.setdefault(i, Counter()).update(w for w in text.lower().split(" ") if w)
    return {i: [(w, pytest.approx(log(1 + n))) for w, n in sorted(c.items())] for i, c in counts.items() if c}


def found(df):
    return {r.id: [(w.dim, w.weight) for w in r.words] for r in df.collect()}


@pytest.mark.parametrize("chunk", [8, 4 << 20])
def test_words_of_a_document_are_counted_without_a_shuffle(spark, monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    df = words.word_vectors(spark.createDataFrame(TEXTS, "id string, text string").coalesce(1), F.col("id"), "text")
    assert "Exchange" not in plan(df) and found(df) == right(TEXTS)


def test_rows_of_one_id_are_one_document(spark):
    rows = [*TEXTS, ("4", "of the"), (None, "a b"), (None, "b c")]
    df = words.word_vectors(spark.createDataFrame(rows, "id string, text string").repartition(3), F.col("id"), "text")
    assert found(df) == right(rows)

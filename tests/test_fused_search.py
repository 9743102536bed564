"""Fused search takes both scores in one pass."""

import pytest

from strandbase.operators import searching


@pytest.mark.parametrize("named", [0, 1000])
def test_fused_search_reads_the_rows_once_for_both_scores(spark, monkeypatch, named):
    monkeypatch.setattr(searching, "NAMED", named)
    passes = []
    cut = searching.lineage.cut
    monkeypatch.setattr(searching.lineage, "cut", lambda df: passes.append(df) or cut(df))
    rows = [(str(i), [1.0, i / 10], [("a", float(i))] if i % 2 else None, ["s"] if i == 3 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, d array<double>, s array<struct<dim: string, weight: double>>, _dirty array<string>")
    got = [(r.id, r._score) for r in searching.search_hybrid(df, "d", [1.0, 0.0], "s", [("a", 2.0)], 3, 3).collect()]
    part = {"0": 1 / 61, "1": 1 / 62 + 1 / 63, "2": 1 / 63, "7": 1 / 61, "5": 1 / 62}
    assert got == [(i, pytest.approx(x)) for i, x in sorted(part.items(), key=lambda p: (-p[1], p[0]))[:3]]
    assert len(passes) == 1

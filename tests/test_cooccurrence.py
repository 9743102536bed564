"""Pairs of sets, in tasks of a bounded size."""

from collections import defaultdict
from itertools import combinations

import pytest

from strandbase import queries
from strandbase.operators import placement

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(placement, "ROWS_A_TASK", 250)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    n = -(-rows.count() // 250)
    assert n > 16 and placement.parts_for(rows) == n
    for name in ("cooccurrence_scores", "affinity_promotion"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2 and plan.count(f", {n}), REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_pairs_of_dealt_sets(spark, parts):
    rows = [(k, m) for k in range(40) for m in {k % 7, k % 3 + 10, k % 2 + 20, 30}] + [(1, 30), (50, 4), (None, 4), (None, 30)]
    df = placement.sets_by(spark.createDataFrame(rows, "k long, m long").repartition(3), "k", "m", parts)
    got = {(r.a, r.b): r.score for r in placement.cooccurrence(df, "members", parts).collect()}
    sets, right = defaultdict(set), defaultdict(float)
    for k, m in rows:
        if k is not None:
            sets[k].add(m)
    for s in sets.values():
        for pair in combinations(sorted(s), 2):
            right[pair] += 1 / (len(s) - 1)
    assert got == {k: pytest.approx(x) for k, x in right.items()}

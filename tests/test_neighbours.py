"""The all-pairs sweep: one pass however many sources, ties by id, existing edges."""

import numpy as np

from strandbase.operators import inference, neighbours

EMPTY = "src string, dst string"


def table(spark, v, names=None):
    rows = [(names[i] if names else str(i), None if x is None else [float(y) for y in x]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)


def found(df):
    out: dict = {}
    for r in df.orderBy("src", "confidence", "dst").collect():
        out.setdefault(r.src, []).append((r.dst, r.confidence))
    return out


def brute(ids, v, have, limit, at_least):
    out: dict = {}
    v = np.array(v, np.float32).astype(float)
    for i, a in enumerate(ids):
        rows = sorted((-float(sum(x * y for x, y in zip(v[i], v[j])) / np.sqrt(sum(v[i] ** 2)) / np.sqrt(sum(v[j] ** 2))), b) for j, b in enumerate(ids) if a != b and (a, b) not in have)
        rows = [(b, -s) for s, b in rows if -s >= at_least][:limit]
        if rows:
            out[a] = rows
    return out


def test_plan_does_not_grow_with_the_sources(spark):
    v = np.random.default_rng(1).normal(size=(2 * inference.BATCH + 1, 4))
    plans = []
    for n in (10, len(v)):
        items = table(spark, v[:n])
        df = inference.sweep(items, items, "embedding", spark.createDataFrame([], EMPTY), 2, 0.1)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert [p.count("MapInArrow") for p in plans] == [3, 3] and "Union" not in plans[1]


def test_equal_vectors_tie_by_id_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "TARGETS_A_TASK", 150)
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "WIDTH", 32)
    rng = np.random.default_rng(2)
    few = rng.normal(size=(40, 8)).round(2)
    v = np.concatenate([few[rng.integers(0, 40, 300)], np.repeat(few[:1], 100, axis=0)])
    ids = [str(x) for x in range(len(v))]
    have = {(a, b) for a in ("0", "17", "399") for b in ids[::2]}
    items = table(spark, v)
    got = found(inference.sweep(items, items, "embedding", spark.createDataFrame(sorted(have), EMPTY), 3, 0.2))
    right = brute(ids, v, have, 3, 0.2)
    assert {k: {b for b, _ in x} for k, x in got.items()} == {k: {b for b, _ in x} for k, x in right.items()}
    for k, x in right.items():
        assert np.allclose(sorted(s for _, s in got[k]), sorted(s for _, s in x), atol=1e-12)


def test_vectors_without_length_and_missing_ones(spark):
    items = table(spark, [[1, 0], [0, 0], None, [1, 1], [float("nan"), 1]])
    got = found(inference.sweep(items, items, "embedding", spark.createDataFrame([], EMPTY), 5, -1.0))
    assert {k: [b for b, _ in x] for k, x in got.items()} == {"0": ["3"], "3": ["0"]}
    assert found(inference.sweep(items.limit(0), items, "embedding", spark.createDataFrame([], EMPTY), 5, 0.0)) == {}

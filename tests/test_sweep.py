"""The inference sweep over more sources than one batch holds."""

import numpy as np
import pytest

from strandbase import queries
from strandbase.operators import inference

SF = "/root/testdata/sf0.1"


def test_sweep_takes_every_source_in_batches(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2 * inference.BATCH + 300, 8))
    items = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>").repartition(4)
    have = spark.createDataFrame([("0", "1"), ("2200", "5")], "src string, dst string")
    got: dict = {}
    for r in inference.sweep(items, items, "embedding", have, 2, 0.3).collect():
        got.setdefault(int(r.src), {})[int(r.dst)] = r.confidence
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    s[0, 1] = s[2200, 5] = -1
    assert set(got) == set(range(len(v)))
    for i in range(len(v)):
        right = np.argsort(-s[i])[:2]
        assert sorted(got[i]) == sorted(right.tolist()) and all(got[i][j] == pytest.approx(s[i, j]) for j in right.tolist())


def test_registered_sweep_covers_all_embeddings(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    best = -np.sort(-s, axis=1)[:, :3]
    got: dict = {}
    for r in queries.auto_infer_batch(spark, SF).collect():
        got.setdefault(int(r.src), []).append(r.confidence)
    assert len(v) > inference.BATCH
    for r, row in zip(v, best):
        assert sorted(got.get(r.vec_id, []), reverse=True) == pytest.approx([c for c in row if c >= 0.15], abs=2e-5)

import json

import pytest
from pyspark.sql import functions as F

from strandbase.functions import scalars
from strandbase.functions import vectors as V
from strandbase.functions.vectorisers import HashedTerms, HashVectoriser, Passthrough
from strandbase.language import nodes as n
from strandbase.operators import graph
from strandbase.sources.changelog import ChangeLog, recent_after_checkpoint, state
from strandbase.streaming import streams


@pytest.mark.parametrize(
    "function, rate, floor, seconds, expected",
    [("exponential", 0.001, None, 1000, 0.368), ("linear", 0.001, None, 500, 0.5), ("linear", 0.01, 0.2, 1000, 0.2), ("step", 3600.0, 0.1, 1000, 1.0), ("step", 3600.0, 0.1, 5000, 0.1), (None, None, None, 1000, 1.0), ("exponential", 0.001, None, 0, 1.0)],
)
def test_decay(spark, function, rate, floor, seconds, expected):
    now = 1_700_000_000_000
    df = spark.createDataFrame([(1.0, now - seconds * 1000)], "confidence double, created_at long")
    assert df.select(scalars.decayed(F.col("confidence"), F.col("created_at"), now, function, rate, floor)).first()[0] == pytest.approx(expected, abs=0.01)


def test_no_decay_without_a_creation_time(spark):
    df = spark.createDataFrame([(0.8, 0)], "confidence double, created_at long")
    assert graph.effective(df, n.DecayDecl("linear", 1.0), 10**12).first()[0] == 0.8


def test_quantisation(spark):
    df = spark.createDataFrame([([0.5, -1.0, 2.0],), ([3.0, 3.0],)], "v array<float>")
    back = df.select("v", V.dequantise_int8(V.quantise_int8(F.col("v"))).alias("b"), V.quantise_binary(F.col("v")).alias("bits")).collect()
    for r in back:
        assert max(abs(a - b) for a, b in zip(r.v, r.b)) <= (max(r.v) - min(r.v)) / 510 + 1e-9
    assert [r.bits for r in back] == ["101", "11"]


def test_vectorisers(spark):
    v = HashVectoriser(40)
    df = spark.createDataFrame([("x", None), ("y", "z")], "a string, b string").withColumn("v", v.column(["b", "a"]))
    got = [r.v for r in df.collect()]
    assert got[0] == pytest.approx(v.encode({"a": "x"})) and got[1] == pytest.approx(v.encode({"b": "z", "a": "y"})) and len(got[0]) == 40
    assert HashedTerms().encode_query("the The cat")[0][1] > 0
    with pytest.raises(Exception):
        Passthrough().encode({})


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.commit([("EntityWrite", "c", "a", {"v": 1}), ("EntityWrite", "c", "b", {"v": 1})], 0)
    log.commit([("EntityWrite", "c", "a", {"v": 2}), ("EntityDelete", "c", "b", None)], 0)
    log.commit([("Checkpoint", "", "", None)], 0)
    log.commit([("EntityWrite", "c", "d", {"v": 3})], 0)
    rows = {r.key: json.loads(r.payload) for r in state(log.frame()).collect()}
    assert rows == {"a": {"v": 2}, "d": {"v": 3}}
    open_ = log.frame().filter("record <> 'TxCommit' or tx_id < 4")
    assert {r.key for r in state(open_).collect()} == {"a"}
    assert {r.key for r in state(recent_after_checkpoint(log.frame())).collect()} == {"d"}
    again = ChangeLog(spark, str(tmp_path / "log"))
    assert again.commit([("EntityWrite", "c", "e", {"v": 4})], 0) == 5


def test_stream_follows_the_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    target = f"file://{tmp_path}/state"
    for i in range(4):
        log.commit([("EntityWrite", "c", f"k{i % 2}", {"v": i}), ("EntityWrite", "c", "gone", {})], 0)
    log.commit([("EntityDelete", "c", "gone", None)], 0)
    for _ in range(2):
        streams.follow_state(streams.read_log(spark, str(tmp_path / "log"), 2), target, f"file://{tmp_path}/check").awaitTermination()
    now = {r.key: json.loads(r.payload)["v"] for r in streams.followed_state(spark, target).collect()}
    assert now == {"k0": 2, "k1": 3} == {r.key: json.loads(r.payload)["v"] for r in streams.batch_state(log.frame()).collect()}


def test_inference_queue_sees_each_entity_once_a_batch(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    for k in ("a", "b", "a"):
        log.commit([("EntityWrite", "acts", k, {})], 0)
    seen = []
    streams.inference_queue(streams.read_log(spark, str(tmp_path / "log")), ["acts"], lambda df, i: seen.extend(sorted(r.id for r in df.collect())), f"file://{tmp_path}/check").awaitTermination()
    assert seen == ["a", "b"]


def test_reach_cuts_long_plans(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), 1.0, "t") for i in range(12)], "src string, dst string, confidence double, edge_type string")
    found = graph.reach(spark.createDataFrame([("0",)], "id string"), edges, 50)
    assert sorted((r["id"], r["_depth"]) for r in found.collect()) == sorted((str(i), i) for i in range(1, 11))

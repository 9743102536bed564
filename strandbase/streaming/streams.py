"""Streams over the change log and over event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.changelog import SCHEMA, state


def read_log(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Committed transactions as they come; files appear whole, one transaction each."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)


def follow_state(log: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the latest row of each key under ``target``, one version a batch, with the last in ``target``/current.

    A batch that is run again writes its version again from the version before it, so the state is the same.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(~F.col("record").isin("TxBegin", "TxCommit")).select("collection", "key", "lsn", "record", "payload")
        before = _version(spark, target, number)
        if before is not None:
            rows = rows.unionByName(before)
        last = rows.groupBy("collection", "key").agg(F.max_by(F.struct("lsn", "record", "payload"), "lsn").alias("r"))
        last.select("collection", "key", "r.lsn", "r.record", "r.payload").write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    writer = log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def _version(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The rows of the last version, or of the last below a batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    numbers = sorted(int(x.removeprefix("batch=")) for x in names if x.startswith("batch="))
    numbers = [x for x in numbers if (below is None or x < below) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={x:08d}/_SUCCESS"))]
    schema = T.StructType().add("collection", "string").add("key", "string").add("lsn", "long").add("record", "string").add("payload", "string")
    return spark.read.schema(schema).parquet(f"{target}/batch={numbers[-1]:08d}") if numbers else None


def followed_state(spark: SparkSession, target: str) -> DataFrame:
    """What is there now, deletions left out."""
    rows = _version(spark, target)
    if rows is None:
        return spark.createDataFrame([], "collection string, key string, lsn long, payload string")
    return rows.filter(~F.col("record").isin("EntityDelete", "EdgeDelete")).select("collection", "key", "lsn", "payload")


def batch_state(log: DataFrame) -> DataFrame:
    """The same from the whole log at once."""
    return state(log)


def inference_queue(log: DataFrame, collections: list[str], propose: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each changed entity once a batch to ``propose``."""
    ids = log.filter((F.col("record") == "EntityWrite") & F.col("collection").isin(collections)).select("collection", F.col("key").alias("id"))
    return ids.writeStream.foreachBatch(lambda df, number: propose(df.distinct(), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """window_start, keys, n and total value of each window; rows later than ``late`` are left out in a stream."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result from memory; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)

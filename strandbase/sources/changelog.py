"""The change log: what was written, in order, and the state it amounts to."""

from __future__ import annotations

import json
import time
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType().add("lsn", "long").add("tx_id", "long").add("ts", "long").add("record", "string").add("collection", "string").add("key", "string").add("payload", "string")
WRITES = ("EntityWrite", "EdgeWrite", "EdgeInferred", "EdgeConfirm", "EdgeConfidenceUpdate", "ReprWrite")
DELETES = ("EntityDelete", "EdgeDelete")
COLLECTIONS = ("SchemaCreateColl", "SchemaAlter", "SchemaDropColl")
EDGE_TYPES = ("SchemaCreateEdgeType", "SchemaDropEdgeType")


class ChangeLog:
    """One file a transaction, put in place whole, so that readers and streams see transactions or nothing.

    ``folder`` may be in any store that Spark's Hadoop file systems reach.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.lsn, self.tx = spark, folder, 0, 0
        self.recent: list[dict[str, Any]] = []
        self.bulk: list[DataFrame] = []
        if folder:
            self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            self.files = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            self.files.mkdirs(self.path(folder))
            if any(x.getPath().getName().endswith(".json") for x in self.files.listStatus(self.path(folder))):
                self.lsn, self.tx = (x or 0 for x in spark.read.schema(SCHEMA).json(folder).agg(F.max("lsn"), F.max("tx_id")).first())

    def commit(self, records: list[tuple[str, str, str, Any]], now_ms: int | None = None) -> int:
        """Append (record, collection, key, payload) rows as one transaction; its number."""
        self.tx += 1
        rows = []
        now = int(time.time() * 1000) if now_ms is None else now_ms
        for record, collection, key, payload in [("TxBegin", "", "", None), *records, ("TxCommit", "", "", None)]:
            self.lsn += 1
            rows.append({"lsn": self.lsn, "tx_id": self.tx, "ts": now, "record": record, "collection": collection, "key": key, "payload": None if payload is None else json.dumps(payload, default=str, sort_keys=True)})
        if self.folder:
            part, whole = self.path(f"{self.folder}/_{self.tx}.tmp"), self.path(f"{self.folder}/tx-{self.tx:020d}.json")
            out = self.files.create(part, True)
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
            out.close()
            if not self.files.rename(part, whole):
                raise OSError(f"{whole.toString()} can't be written")
        else:
            self.recent += rows
        return self.tx

    def commit_rows(self, record: str, collection: str, rows: DataFrame, now_ms: int | None = None) -> int:
        """Append a table with key and payload as one transaction, written by the tasks that hold its rows; its number.

        All rows have one lsn. Its end is committed after them, so a reader sees all of them or none.
        """
        now = int(time.time() * 1000) if now_ms is None else now_ms
        self.tx, self.lsn = self.tx + 1, self.lsn + 1
        bulk = rows.select(F.lit(self.lsn).cast("long").alias("lsn"), F.lit(self.tx).cast("long").alias("tx_id"), F.lit(now).cast("long").alias("ts"), F.lit(record).alias("record"), F.lit(collection).alias("collection"), "key", "payload")
        if self.folder:
            path = f"{self.folder}/bulk-{self.tx:020d}"
            bulk.write.mode("overwrite").json(path)
        else:
            self.bulk.append(bulk)
        self.tx -= 1
        return self.commit([], now_ms)

    def frame(self) -> DataFrame:
        if self.folder:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.folder)
        return reduce(DataFrame.unionByName, self.bulk, self.spark.createDataFrame([tuple(r[f.name] for f in SCHEMA) for r in self.recent], SCHEMA))


def committed(log: DataFrame) -> DataFrame:
    """Rows of transactions that were committed; one pass and no window: a semi-join with the commit rows."""
    done = log.filter(F.col("record") == "TxCommit").select("tx_id").distinct()
    return log.filter(~F.col("record").isin("TxBegin", "TxCommit")).join(done, "tx_id", "left_semi")


def latest(log: DataFrame, keys: tuple[str, ...] = ("collection", "key"), order: str = "lsn") -> DataFrame:
    """The last row of each key, by partial maxima before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def state(log: DataFrame) -> DataFrame:
    """collection, key, lsn, payload of what is there after all committed changes; replaying twice gives the same."""
    rows = committed(log).filter(F.col("record").isin(*WRITES, *DELETES)).dropDuplicates(["lsn", "collection", "key"])
    now = latest(rows.select("collection", "key", "lsn", "record", "payload"))
    return now.filter(F.col("record").isin(*WRITES)).select("collection", "key", "lsn", "payload")


def recent_after_checkpoint(log: DataFrame) -> DataFrame:
    """Rows after the last checkpoint record, as a restart replays them."""
    last = log.filter(F.col("record") == "Checkpoint").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("from_lsn"))
    return log.join(F.broadcast(last), F.col("lsn") > F.col("from_lsn")).drop("from_lsn")  # one row


def definitions(log: DataFrame, records: tuple[str, ...]) -> dict[str, dict[str, Any]]:
    """What each name was last defined as, of collections or of edge types; dropped ones are left out."""
    last = latest(committed(log).filter(F.col("record").isin(*records)).select("collection", "lsn", "record", "payload"), ("collection",))
    found = {r.collection: json.loads(r.payload) for r in last.orderBy("lsn").collect() if "Drop" not in r.record}  # a row a definition
    return {name: d["definition"] for name, d in found.items() if "definition" in d}


def checkpointed(log: DataFrame) -> tuple[int, dict[str, str]]:
    """The lsn of the last committed checkpoint and the table version of each name then; -1 and none before the first."""
    last = committed(log).filter(F.col("record") == "Checkpoint").orderBy(F.col("lsn").desc()).select("lsn", "payload").first()
    return (last.lsn, json.loads(last.payload or "{}")) if last else (-1, {})


def rows_since(log: DataFrame, collection: str, schema: T.StructType, lsn: int, version: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
    """The rows of ``version``, written at a checkpoint, with what was committed after ``lsn``; None where fields or the
    whole collection were redefined since, which takes the whole log."""
    own = committed(log).filter((F.col("collection") == collection) & (F.col("lsn") > lsn))
    if not own.filter(F.col("record").isin(*COLLECTIONS, *EDGE_TYPES)).isEmpty():
        return None
    touched = own.filter(F.col("record").isin(*WRITES, *DELETES)).select("key").distinct()
    held = [F.col(f"`{f.name}`") if f.name in version.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    old = version.withColumn("key", F.concat_ws("\x1f", *keys)).join(touched, "key", "left_anti").select(*held)
    return old.unionByName(rows_of(log.filter(F.col("lsn") > lsn), collection, schema))


def rows_of(log: DataFrame, collection: str, schema: T.StructType) -> DataFrame:
    """The rows of one collection after all committed changes, with the columns of ``schema``.

    Only what was written since it was last dropped counts, and fields that were renamed since a row was written are
    read by the name they had then.
    """
    own = committed(log).filter(F.col("collection") == collection)
    defined = own.filter(F.col("record").isin("SchemaDropColl", "SchemaDropEdgeType", "SchemaAlter")).select("lsn", "record", "payload").orderBy("lsn").collect()  # a row a definition
    since = max((r.lsn for r in defined if r.record != "SchemaAlter"), default=-1)
    renamed = [(r.lsn, a["old"], a["new"]) for r in defined if r.lsn > since and r.record == "SchemaAlter" and (a := json.loads(r.payload)).get("op") == "RENAME_FIELD" and "old" in a]
    kept = own.filter((F.col("lsn") > since) & F.col("record").isin(*WRITES, *DELETES))
    now = latest(kept.select("key", "lsn", "tx_id", "record", "payload"), ("key",)).filter(F.col("record").isin(*WRITES))
    kinds, wide = {f.name: f.dataType for f in schema}, T.StructType(list(schema.fields))
    for _, old, new in reversed(renamed):
        if old not in kinds and new in kinds:
            kinds[old] = kinds[new]
            wide = wide.add(old, kinds[new])
    rows = now.select("tx_id", "lsn", F.from_json("payload", wide).alias("r")).select("tx_id", F.col("lsn").alias("__lsn"), "r.*")
    for lsn, old, new in renamed:
        if old in rows.columns and new in rows.columns:
            rows = rows.withColumn(new, F.when(F.col("__lsn") < lsn, F.col(f"`{old}`")).otherwise(F.col(f"`{new}`")))
    stamped = [F.coalesce(F.col("tx_time"), F.col("tx_id")).alias(c) if c == "tx_time" else F.col(f"`{c}`") for c in schema.names]
    return rows.select(*stamped)

"""Cutting long plans."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame

_written: list[tuple[object, str]] = []


def shared_folder(df: DataFrame) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only where it is unset, as in tests."""
    found = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    return found.rstrip("/") if found else f"file://{os.path.join(tempfile.gettempdir(), 'strandbase-shared')}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again: computed once, of known size, and there
    even when executors are lost. Removed when the driver ends."""
    path = f"{shared_folder(df)}/strandbase/cut-{uuid.uuid4().hex}"
    _written.append((df.sparkSession.sparkContext._jvm, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for jvm, path in _written:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.spark.SparkContext.getOrCreate().hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; a leftover folder is no error
            return


atexit.register(_sweep)

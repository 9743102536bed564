"""Helpers shared by the corpus operators: staging, task files, bounded text chunks."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in the contracts, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a Python task.
CHUNK_CHARS = 2_000_000
#: Short rows of a staged table in one file and task.
ROWS_A_FILE = 200_000

_staged: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    own = os.path.join(tempfile.gettempdir(), "strandbase-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def _sweep() -> None:
    for jvm, path in _staged:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.spark.SparkContext.getOrCreate().hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; a leftover folder is no error
            return


atexit.register(_sweep)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/strandbase/{label}-{uuid.uuid4().hex}"
    _staged.append((spark.sparkContext._jvm, path))
    return path


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    Of a table known to have at most ``rows`` short rows, no more files are written than there are cores or
    ROWS_A_FILE asks for: each file costs the executor some processes, which share all of its memory as they start.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read; where the scan has fewer splits than there are cores, dealt out evenly over all of them.

    Of a small table one shuffle; a large one has splits enough and is left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Work that is done inside hands texts to Python in batches of ``rows``, for less memory in executor and worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_write(uri: str):
    """A binary file for writing in any store that pyarrow knows; missing parent folders are made."""
    if "://" not in uri or uri.startswith("file:"):
        path = uri.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def commit_file(uri: str, attempt: int, data: list[bytes]) -> None:
    """Write a task's file under an attempt name, then move it in place, so that a retried task leaves one whole file."""
    part = f"{os.path.dirname(uri)}/_{os.path.basename(uri)}.{attempt}"
    with open_write(part) as f:
        for x in data:
            f.write(x)
    if "://" not in uri or uri.startswith("file:"):
        strip = lambda u: u.removeprefix("file://").removeprefix("file:")
        os.replace(strip(part), strip(uri))
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)  # of an attempt before; it holds the same
        store.move(fs.FileSystem.from_uri(part)[1], path)


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches whose texts hold about ``most`` bytes, with the texts; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).fill_null("")
        sizes = pa.compute.binary_length(column).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= most or i == len(sizes) - 1:
                yield batch.slice(begin, i + 1 - begin), column.slice(begin, i + 1 - begin)
                begin, total = i + 1, 0


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """arrow_chunks with the texts as Python strings."""
    for part, texts in arrow_chunks(batches, text, most):
        yield part, texts.to_pylist()


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges that hold about ``most`` rows together."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def held_by_worker(key: tuple, make):
    """An object that a Python worker keeps from task to task; only ever a cache, so a new worker makes its own."""
    held = sys.modules.setdefault("strandbase_worker", types.ModuleType("strandbase_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def crc_fold(column, modulus: int):
    """crc32 of a column as text, modulo: the fold rule of the labelled operators."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)).cast("int")

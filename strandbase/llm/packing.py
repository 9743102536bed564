"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the instance is a histogram of at most ``capacity`` counts,
whatever the number of documents; the driver solves it on these counts. A solution is a list of patterns with
multiplicities, at most a few a length. Pieces then take their place by their rank among pieces of equal length.

Defined results: null text is empty (one piece with the end id alone); documents of more than the capacity are cut
into whole sequences after a first piece that may be shorter; repeated rows are packed each for itself; an empty
table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_chunks, held_by_worker, small_batches, stage, text_or_empty
from .tokens import word_encoder

CAPACITY = 2048
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), bins


class _Lengths:
    """Counts by length with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect_left(self.order, length))

    def largest_up_to(self, x: int) -> int:
        i = bisect_left(self.order, x + 1)
        return self.order[i - 1] if i else 0

    def smallest_pair(self, without: int) -> tuple[int, int]:
        """The two smallest items when one of ``without`` is set aside; a missing one is larger than all."""
        found: list[int] = []
        for k in self.order[:3]:
            found += [k] * min(2, self.counts[k] - (k == without))
            if len(found) >= 2:
                break
        return (*found, 1 << 60, 1 << 60)[:2]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix sets that dominate every other set with their largest item; the rest of the instance.

    For the largest item j with room r: alone, if nothing fits beside it; with the largest k <= r, if no two items
    fit beside it or k fills the room. Each fix leaves an optimum reachable. It is carried on until none applies.
    """
    left, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for j in reversed(list(left.order)):
            while left.counts.get(j):
                room, n = capacity - j, left.counts[j]
                first, second = left.smallest_pair(j)
                if first > room:
                    fixed.append((((j, 1),), n))
                    left.take(j, n)
                    changed = True
                    break
                k = left.largest_up_to(room)
                if k == j and n < 2:  # only itself
                    k = left.largest_up_to(j - 1)
                if k and (first + second > room or k == room):
                    m = n // 2 if k == j else min(n, left.counts[k])
                    fixed.append((((j, 2),) if k == j else ((j, 1), (k, 1)), m))
                    left.take(j, 2 * m if k == j else m)
                    if k != j:
                        left.take(k, m)
                    changed = True
                    continue
                break
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in descending order, many equal items and bins at a time; the same bins as one by one."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = {}  # room -> [pattern, bins]

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, pattern, there = capacity, (), n
            else:
                room = rooms[i]
                pattern, there = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(i)
            each = room // length
            whole = min(there, n // each)
            if whole:
                put(room - each * length, (*pattern, (length, each)), whole)
                n -= whole * each
                there -= whole
            if n and n < each and there:
                put(room - n * length, (*pattern, (length, n)), 1)
                there, n = there - 1, 0
            if pattern and there:
                put(room, pattern, there)
    return [(p, n) for kinds in bins.values() for p, n in kinds]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: a run from rank r0 has ``copies`` a sequence, from sequence ``first`` on at ``offset``."""
    rows, used, first = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length, copies in pattern:
            r0 = used.get(length, 0)
            rows.append((length, r0, first, copies, offset))
            used[length] = r0 + n * copies
            offset += length * copies
        first += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "first": a[:, 2], "copies": a[:, 3], "offset": a[:, 4]}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, spaced: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_by_worker(("words", tokenizer, spaced), lambda: word_encoder(tokenizer, spaced))
        for part, texts in arrow_chunks(batches):
            ids, n = encoder.encode(texts)
            ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
            k = -(-n // capacity)
            rows = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(k) - k, k)
            short = n - (k - 1) * capacity
            start = np.where(piece == 0, 0, short[rows] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[rows], capacity)
            at = (np.cumsum(n) - n)[rows] + start
            crc = [zlib.crc32(ids[a : a + b]) for a, b in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY, rows_a_bucket: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a length from 1 to ``capacity``."""
    spark = cut.sparkSession
    with small_batches(spark):
        cut = stage(cut, "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    patterns = solve(counts, capacity)
    runs = spark.sparkContext.broadcast(places(patterns))  # at most a few runs for each length and pattern
    buckets = max(16, -(-sum(counts.values()) // rows_a_bucket))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "bucket").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(order)).join(before.drop("count"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.coalesce("before", F.lit(0)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r, key = runs.value, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        i = np.searchsorted(r["key"], key, "right") - 1
        within = key - r["key"][i]
        return pd.DataFrame({"sequence_id": r["first"][i] + within // r["copies"][i], "offset": r["offset"][i] + within % r["copies"][i] * length.to_numpy(np.int64)})

    out = ranked.withColumn("at", place("length", "rank"))
    return out.select(*cut.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)

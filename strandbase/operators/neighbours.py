"""The nearest targets of every source: the exact all-pairs job, in blocks.

Sources and targets are packed into blocks of a few MB; every block of sources meets every block of targets in some task,
so memory is bounded by the blocks and tasks can be dealt to any number of machines. A product in single precision finds
the pairs that may be among a source's best; only those are scored in double precision, in SQL's order of operations, so
that equal vectors have equal scores and ties are settled by the target's id.
"""

from __future__ import annotations

import sys
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tasks carry this module's functions themselves, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a block, and of the targets that one task meets.
BLOCK, TARGETS_A_TASK = 16_384, 150_000
#: Sources and targets of one product, and pairs scored exactly at once.
TILE, WIDTH, PAIRS = 2048, 4096, 1 << 19

SOURCE_BLOCK = "part int, block long, ids array<string>, vectors binary, have_at array<int>, have array<string>"
TARGET_BLOCK = "part int, ids array<string>, sizes array<int>, vectors binary"


def vectors_of(column: pa.Array) -> np.ndarray:
    """A row a vector; elements that are missing are NaN."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lengths_of(v: np.ndarray) -> np.ndarray:
    """Square roots of the sums of squares, summed from the first element on."""
    total = np.zeros(len(v))
    for x in v.T:
        total += x * x
    return np.sqrt(total)


def units_of(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.divide(v, length[:, None], out=np.zeros_like(v), where=length[:, None] > 0).astype(np.float32)


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of at most ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def usable(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows whose vector has a length."""
    v = vectors_of(table["v"].chunk(0))
    length = lengths_of(v)
    good = np.isfinite(length) & (length > 0)
    return table.filter(pa.array(good)), v[good]


def pack_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, table in enumerate(runs(batches, BLOCK)):
        table, v = usable(table)
        have = [(i, x) for i, some in enumerate(table["have"].to_pylist()) for x in some or ()]
        columns = [[part], [(part << 24) + k], [table["id"].to_pylist()], [v.tobytes()], [[i for i, _ in have]], [[x for _, x in have]]]
        types = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())]
        if len(v):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "block", "ids", "vectors", "have_at", "have"])


def pack_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal vectors of a block are held once, with their ids in order."""
    part = TaskContext.get().partitionId()
    for table in runs(batches, BLOCK):
        table, v = usable(table)
        if not len(v):
            continue
        _, first, group = np.unique(v.view(f"V{v.itemsize * v.shape[1]}").ravel(), return_index=True, return_inverse=True)
        ids, group = table["id"].to_pylist(), group.ravel()
        ordered = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (group[i], ids[i]))]
        columns = [[part], [ordered], [np.bincount(group).tolist()], [v[first].tobytes()]]
        types = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "ids", "sizes", "vectors"])


class Sources:
    """A block of sources with the best targets met so far."""

    def __init__(self, ids: list[str], vectors: bytes, have_at: list[int], have: list[str], limit: int, at_least: float):
        self.ids, self.limit, self.at_least = ids, limit, at_least
        v = np.frombuffer(vectors).reshape(len(ids), -1)
        self.length = lengths_of(v)
        self.unit, self.columns = units_of(v, self.length), np.ascontiguousarray(v.T)
        self.have: dict[int, set[str]] = {}
        for i, x in zip(have_at, have):
            self.have.setdefault(i, set()).add(x)
        self.free = np.ones(len(ids), bool)  # of sources without such targets, at most one of the others is left out: itself
        self.free[list(self.have)] = False
        self.best: list[list[tuple[float, str]]] = [[] for _ in ids]  # (-score, id), in order
        self.least = np.full(len(ids), float(at_least))  # what a score must reach to count
        self.error = (v.shape[1] + 4) * 2.0**-23  # bounds that of the product in single precision

    def meet(self, ids: list[str], sizes: list[int], vectors: bytes) -> None:
        v = np.frombuffer(vectors).reshape(len(sizes), -1)
        ends = np.cumsum(sizes)
        names = [ids[e - n : e] for n, e in zip(sizes, ends.tolist())]
        length = lengths_of(v)
        unit, columns = units_of(v, length), np.ascontiguousarray(v.T)
        for a in range(0, len(self.ids), TILE):
            at, width = 0, WIDTH // 16
            while at < len(v):  # few targets first, which raises what the next ones must reach
                self._tile(a, at, self.unit[a : a + TILE] @ unit[at : at + width].T, columns, length, names)
                at, width = at + width, min(2 * width, WIDTH)

    def _tile(self, a: int, b: int, near: np.ndarray, columns: np.ndarray, length: np.ndarray, names: list[list[str]]) -> None:
        least = self.least[a : a + len(near)] - self.error
        open_ = np.flatnonzero(self.free[a : a + len(near)] & np.fromiter((len(x) < self.limit for x in self.best[a : a + len(near)]), bool, len(near)))
        if len(open_) and near.shape[1] > self.limit + 1:
            nth = np.partition(near[open_], -self.limit - 1, axis=1)[:, -self.limit - 1]
            least[open_] = np.maximum(least[open_], nth - 2 * self.error)
        found = np.flatnonzero(near >= least.astype(np.float32)[:, None])
        for o in range(0, len(found), PAIRS):
            i, j = np.divmod(found[o : o + PAIRS], near.shape[1])
            i, j = i + a, j + b
            score = np.zeros(len(i))
            for x, y in zip(self.columns, columns):
                score += x[i] * y[j]
            score = score / self.length[i] / length[j]
            good = score >= self.least[i]
            self._add(i[good].tolist(), j[good].tolist(), score[good].tolist(), names)

    def _add(self, i: list[int], j: list[int], score: list[float], names: list[list[str]]) -> None:
        for s, t, x in zip(i, j, score):
            best, own, have = self.best[s], self.ids[s], self.have.get(s, ())
            for name in names[t]:
                entry = (-x, name)
                if len(best) >= self.limit and entry >= best[-1]:
                    break  # so are the next names
                if name != own and name not in have:
                    insort(best, entry)
                    del best[self.limit :]
            if len(best) >= self.limit:
                self.least[s] = max(self.at_least, -best[-1][0])

    def found(self) -> pa.RecordBatch:
        src = [own for own, best in zip(self.ids, self.best) for _ in best]
        pairs = [x for best in self.best for x in best]
        return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array([x[1] for x in pairs], pa.string()), pa.array([-x[0] for x in pairs], pa.float64())], ["src", "dst", "confidence"])


def all_pairs(sources: DataFrame, targets: DataFrame, vector: str, existing: DataFrame, limit: int, at_least: float) -> DataFrame:
    """src, dst, confidence: up to ``limit`` new targets of each source, cosine at least ``at_least``."""
    if limit < 1:
        return sources.sparkSession.createDataFrame([], "src string, dst string, confidence double")
    cores = sources.sparkSession.sparkContext.defaultParallelism

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("string").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                if held is None or row["block"].as_py() != number:
                    if held is not None:
                        yield held.found()
                    number = row["block"].as_py()
                    held = Sources(row["ids"].as_py(), row["vectors"].as_py(), row["have_at"].as_py(), row["have"].as_py(), limit, at_least)
                held.meet(row["names"].as_py(), row["sizes"].as_py(), row["targets"].as_py())
        if held is not None:
            yield held.found()

    n = sources.count()
    m = n if targets is sources else targets.count()
    left = max(-(-n // BLOCK), min(cores, -(-n // 1024)), 1)
    right = max(-(-m // TARGETS_A_TASK), 1)
    known = existing.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("have"))
    asked = rows(sources).join(known, "id", "left").repartition(left).mapInArrow(pack_sources, SOURCE_BLOCK).repartitionById(left, "part")
    given = rows(targets).repartition(right).mapInArrow(pack_targets, TARGET_BLOCK).repartitionById(right, "part")
    given = given.select(F.col("ids").alias("names"), "sizes", F.col("vectors").alias("targets"))
    near = asked.drop("part").crossJoin(given.hint("shuffle_replicate_nl")).mapInArrow(meet, "src string, dst string, confidence double")
    order = Window.partitionBy("src").orderBy(F.col("confidence").desc(), F.col("dst"))
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")

"""Exact top-k search by Hamming distance: incremental multi-index hashing.

Codes are cut into four segments of 16 bits. A code within distance 4 (r + 1) - 1 of a query is within r of it in some
segment, so looking up all segment values within r finds every such code. r grows from 0 until the kth verified
distance is covered. Where more values lie within a radius than the segment has values in use, those in use are taken by
their distance instead: the same values, without looking up empty ones. Every code that is found is found by a segment
within the radius, at every size of table.

Codes are searched in blocks of different codes; of one code only its k smallest ids matter, as they tie. Queries meet
every block, in parts of QUERIES_A_TASK; each block gives at most k rows a query, and these are merged. A task searches
for QUERIES_AT_ONCE at a time and drops what is beyond the kth distance found so far. Shuffled are
N * ceil(Q / QUERIES_A_TASK) codes and Q * ceil(N / BLOCK_CODES) queries of N codes and Q queries.

Defined results: rows without a vector or id take no part; an empty vector has no bit set; a vector has the same code as an equal one; neighbours are
ordered by distance, then id; a query is not its own neighbour, other rows with its code are; with fewer than k other
rows all are returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups

SEGMENTS, SEGMENT_BITS = 4, 16
BITS = SEGMENTS * SEGMENT_BITS
BLOCK_CODES = 400_000
QUERIES_A_TASK = 400_000
AT_ONCE = 500_000  # values or codes that a task looks at
QUERIES_AT_ONCE = 1000  # of a task's queries; of each only the k nearest codes found so far are held
SALTS = 64


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and code: bit i is set where element i of the first 64 is above zero."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), code.alias("code"))


def code_classes(codes: DataFrame, k: int) -> DataFrame:
    """Each different code with its k + 1 smallest ids (one may be the query); first by salt, so no code is one task's."""
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    order = Window.partitionBy("code", "salt").orderBy("id")
    few = salted.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))  # at most SALTS * (k + 1) ids a code


def _masks(radius: int) -> np.ndarray:
    """Segment values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)], np.int64)


class Block:
    """Different codes by their segments, for exact searches; ``least`` (of each code) breaks ties where it is given."""

    def __init__(self, codes: np.ndarray, least: np.ndarray | None = None):
        self.codes, self.least = codes, least
        self.orders = [np.argsort(_segment(codes, s), kind="stable").astype(np.int32) for s in range(SEGMENTS)]
        self.starts = [np.searchsorted(_segment(codes, s)[o], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in enumerate(self.orders)]
        self.in_use = [np.flatnonzero(np.diff(x)) for x in self.starts]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) places of the k nearest codes of each query, with all that tie with the kth or, where
        ties are broken, k at most; and the radius at which each query was covered.

        Codes beyond the kth distance found so far are dropped at once, so that what is held does not grow with what is
        looked at."""
        codes, k = self.codes, min(k, len(self.codes))
        # How many found codes each left query has at each distance: the kth verified distance follows.
        counts, covered_at = np.zeros((len(queries), BITS + 1), np.int64), np.full(len(queries), SEGMENT_BITS)
        last = np.full(len(queries), BITS, np.uint8)  # the kth distance among those found
        held, n_held, most = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))], 0, AT_ONCE
        left = np.arange(len(queries), dtype=np.int32)
        for radius in range(SEGMENT_BITS + 1):
            masks = _masks(radius)
            for s in range(SEGMENTS):
                step = max(1, AT_ONCE // min(len(masks), max(1, len(self.in_use[s]))))
                for lo in range(0, len(left), step):
                    for asking, places in self._looked_up(queries, left[lo : lo + step], s, radius, masks):
                        x = queries[asking] ^ codes[places]
                        d = np.bitwise_count(x)
                        near = np.flatnonzero(d <= last[asking])
                        # A code counts at the first segment and radius that finds it.
                        parts = np.array([np.bitwise_count(_segment(x[near], t)) for t in range(SEGMENTS)])
                        near = near[(parts.min(axis=0) == radius) & (parts.argmin(axis=0) == s)]
                        who, what, d = asking[near], places[near], d[near]
                        np.add.at(counts, (who, d), 1)
                        touched = np.unique(who)
                        last[touched] = np.minimum((np.cumsum(counts[touched], axis=1) < k).sum(axis=1), BITS)
                        held.append((who, what, d))
                        n_held += len(who)
                        if n_held > most:
                            held = [self._nearest(held, last, k)]
                            n_held = len(held[0][0])
                            most = max(AT_ONCE, 2 * n_held)
            covered = SEGMENTS * (radius + 1) - 1
            done = counts[left, : covered + 1].sum(axis=1) >= k
            covered_at[left[done]] = radius
            left = left[~done]
            if not len(left):
                break
        return *self._nearest(held, last, k), covered_at

    def _looked_up(self, queries: np.ndarray, q: np.ndarray, s: int, radius: int, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and places of the codes whose segment ``s`` is at that radius, about AT_ONCE at a time."""
        own, in_use, starts = _segment(queries[q], s)[:, None], self.in_use[s], self.starts[s]
        if len(masks) <= len(in_use):
            asking, values = np.repeat(q, len(masks)), (own ^ masks).ravel()
        else:
            row, value = np.nonzero(np.bitwise_count(own ^ in_use) == radius)
            asking, values = q[row], in_use[value]
        first, sizes = starts[values], starts[values + 1] - starts[values]
        used = np.flatnonzero(sizes)
        for i, j in groups(sizes[used], AT_ONCE):
            at = used[i:j]
            n = sizes[at]
            yield np.repeat(asking[at], n), self.orders[s][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)]

    def _nearest(self, held: list[tuple], last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what is held, all within the kth distance; where ties are broken, the k first of them by distance and least."""
        who, what, d = (np.concatenate([h[i] for h in held]) for i in range(3))
        keep = np.flatnonzero(d <= last[who])
        if self.least is not None:
            keep = keep[np.lexsort((self.least[what[keep]], d[keep], who[keep]))]
            first = np.flatnonzero(np.diff(who[keep], prepend=-1))
            rank = np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep))))
            keep = keep[rank < k]
        return who[keep], what[keep], d[keep]


def _segment(x: np.ndarray, s: int) -> np.ndarray:
    return ((x >> np.uint64(SEGMENT_BITS * s)) & np.uint64(0xFFFF)).astype(np.int64)


def search_block(codes: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block.search with all ties."""
    return Block(codes).search(queries, k)


def nearest_rows(codes: np.ndarray, ids: np.ndarray, ends: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id and distance of the k nearest other rows of each query; each code's ids, in order, end at ``ends``."""
    many = np.diff(ends, prepend=0)
    block, out = Block(codes, ids[ends - many]), []
    for lo in range(0, len(queries), QUERIES_AT_ONCE):
        # One more than k, as a query may find itself.
        who, what, d, _ = block.search(queries[lo : lo + QUERIES_AT_ONCE], k + 1)
        n = many[what]
        who, d = np.repeat(who, n), np.repeat(d, n)
        found = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((ends - many)[what], n)]
        asked = query_ids[lo : lo + QUERIES_AT_ONCE][who]
        other = np.flatnonzero(asked != found)
        order = other[np.lexsort((found[other], d[other], who[other]))]
        first = np.flatnonzero(np.diff(who[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order = order[rank < k]
        out.append((asked[order], found[order], d[order].astype(np.int64)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *[x[i] for x in out]]) for i in range(3))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, distance: the k nearest other rows of each query; both tables have id and code."""
    classes = code_classes(codes, k)
    n_codes, n_queries = codes.select("code").distinct().count(), queries.count()
    blocks, parts = max(1, -(-n_codes // BLOCK_CODES)), max(1, -(-n_queries // QUERIES_A_TASK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), spread(parts).alias("part"), "code", "ids")
    right = queries.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), spread(blocks).alias("block"), "id", "code")

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        lists = index.column("ids").combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        rows = nearest_rows(numbers(index, "code").view(np.uint64), lists.flatten().to_numpy(), ends, numbers(asked, "code").view(np.uint64), numbers(asked, "id"), k)
        return pa.Table.from_arrays([pa.array(x) for x in rows], ["query_id", "id", "distance"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "query_id long, id long, distance long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


def nearest(vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """The k nearest other rows, by the signs of their vectors, of every row whose id ``every`` divides."""
    codes = sign_codes(vectors)
    return top_k(codes, codes.filter(F.col("id") % every == 0), k)

"""SimHash near-duplicates: fingerprints linked by binary trie self-joins.

The trie of all fingerprints is joined with itself from the root: pairs of nodes go down together, differing bits add
up, and a pair is dropped once they exceed what is allowed at its depth. With a budget of B bits the 64 bits are cut
into B + 1 segments in a ring. If two fingerprints differ in at most B bits, then from some segment on, going round,
the first j segments never hold more than j - 1 of them (the cycle lemma). So the join is done once for each segment
that can lead, on fingerprints turned so that it does, with a budget of j - 1 bits down to the end of the jth segment:
no link is lost, and far fewer node pairs live than under the whole budget from the root on.

The upper part of the first segment has no budget, so its nodes only meet themselves: subtrees below it are dealt out
to tasks, the deeper the more fingerprints there are. A subtree with too many fingerprints is dealt out further, by
the pairs of its nodes that are within the budget. A task keeps only a spanning forest of the links in each subtree,
which loses no component. Components of the links are found by large-star and small-star rounds over tables in the
shared folder.

Several fingerprints of a document can be used: documents are linked where one of them is within the budget and all
together differ in at most ``apart`` bits. One fingerprint of 64 bits tells similarities apart too badly.

Defined results: null and wordless texts have fingerprint zero, linked like any other; repeated rows share
fingerprint and component; a null doc_id counts as no candidate for the smallest id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage, text_or_empty

SEED = 42
BUDGET = 3  # one less than a divisor of 64
#: Fingerprints of a subtree that is dealt out whole on average, and from which on it is dealt out by node pairs.
DEALT = 4096
SPLIT_ABOVE = 50_000
SPLIT_BITS = 6
LEAF = 16  # pairs of a node pair that are compared at once, four fingerprints with four
WIDTH = 500_000  # node pairs that a task holds at once


def shingle_hashes(text: str, words: int) -> list[int]:
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # bytes: A-Z and the white space of the contract only
    if len(w) < words:
        return [xxh64_intdigest(b" ".join(w), SEED)] if w else []
    return list(map(xxh64_intdigest, map(b" ".join, zip(*[w[i:] for i in range(words)])), repeat(SEED)))


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """The hashes themselves, or other 64 bits made of them."""
    if not turn:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(hashes: list[int], turn: int = 0) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(_mixed(h[i : i + 65_536], turn).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, many: int = 1) -> DataFrame:
    """doc_id, text_key (a hash of the text) and f0, f1, ... (``many`` fingerprints of 64 bits as longs) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            hashes = [shingle_hashes(t, words) for t in texts]
            f = [pa.array(np.array([fingerprint(h, k) for h in hashes], np.uint64).view(np.int64)) for k in range(many)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *f], ["doc_id", "text_key", *names])

    names, text = [f"f{k}" for k in range(many)], text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in names))


class _Forest:
    """Labels of a task's fingerprints; equal labels are linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            open_ = lo != hi
            if not open_.any():
                return
            i, j = i[open_], j[open_]
            np.minimum.at(self.label, hi[open_], lo[open_])
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _compare(pairs: list[np.ndarray], near: Near, forest: _Forest) -> None:
    """Link all near pairs between the ranges [alo, ahi) and [blo, bhi), which are short."""
    alo, ahi, blo, bhi = pairs
    size = (ahi - alo) * (bhi - blo)
    for k in range(0, len(size), WIDTH // 4):
        n = size[k : k + WIDTH // 4]
        ends = np.cumsum(n)
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        wide = np.repeat((bhi - blo)[k : k + WIDTH // 4], n)
        i, j = np.repeat(alo[k : k + WIDTH // 4], n) + within // wide, np.repeat(blo[k : k + WIDTH // 4], n) + within % wide
        good = near(i, j) & (i != j)
        forest.link(i[good], j[good])


def trie_join(keys: np.ndarray, roots: list[np.ndarray], depth: int, budget: int, forest: _Forest, near: Near | None = None, segment: int = 0) -> int:
    """Join subtrees: ``keys`` are sorted below each root; roots are ranges [alo, ahi) x [blo, bhi) and bits used.

    Links what ``near`` says of two places (by default: keys within the budget); the number of node pairs that were
    opened. Above depth d no more than d // ``segment`` bits may differ; without segments the whole budget.
    """
    near, opened = near or (lambda i, j: np.bitwise_count(keys[i] ^ keys[j]) <= budget), 0
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, roots)]
    while todo:
        d, (alo, ahi, blo, bhi, used) = todo.pop()
        same = (alo == blo) & (ahi == bhi)
        size = (ahi - alo) * (bhi - blo)
        live = (size > 0) & ~(same & (ahi - alo < 2))
        leaf = live & ((size <= LEAF) | (d == 64))
        if leaf.any():
            _compare([x[leaf] for x in (alo, ahi, blo, bhi)], near, forest)
        go = live & ~leaf
        if not go.any():
            continue
        alo, ahi, blo, bhi, used, same = (x[go] for x in (alo, ahi, blo, bhi, used, same))
        if len(alo) > WIDTH:
            half = len(alo) // 2
            todo += [(d, [x[:half] for x in (alo, ahi, blo, bhi, used)]), (d, [x[half:] for x in (alo, ahi, blo, bhi, used)])]
            continue
        opened += len(alo)
        if d not in ones:
            ones = {k: v for k, v in ones.items() if k < d}
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[d][ahi] - ones[d][alo]), bhi - (ones[d][bhi] - ones[d][blo])
        cross = used < (min(budget, d // segment) if segment else budget)
        back = cross & ~same  # a node with itself has one crossing, not two
        todo.append(
            (
                d + 1,
                [
                    np.concatenate([alo, amid, alo[cross], amid[back]]),
                    np.concatenate([amid, ahi, amid[cross], ahi[back]]),
                    np.concatenate([blo, bmid, bmid[cross], blo[back]]),
                    np.concatenate([bmid, bhi, bhi[cross], bmid[back]]),
                    np.concatenate([used, used, used[cross] + 1, used[back] + 1]),
                ],
            )
        )
    return opened


def _turned(fp, bits: int):
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def links(distinct: DataFrame, budget: int = BUDGET, apart: int | None = None) -> DataFrame:
    """a, b: links that keep every component whole, not all pairs, between different rows of a table with node and
    fingerprints f0, f1, ...; of more than one they must also differ in at most ``apart`` bits together."""
    if 64 % (budget + 1):
        raise ValueError("the budget must be one less than a divisor of 64")
    names, segment = [c for c in distinct.columns if c != "node"], 64 // (budget + 1)
    top = min(segment, max(0, (distinct.count() // DEALT).bit_length()))
    turns = [F.struct(F.lit(k).alias("f"), F.lit(q).alias("q"), _turned(F.col(c), segment * q).alias("key")) for k, c in enumerate(names) for q in range(budget + 1)]
    others_of = names if len(names) > 1 else []
    turned = distinct.select("node", *others_of, F.explode(F.array(*turns)).alias("x"))
    lead = F.shiftrightunsigned("x.key", 64 - top).cast("int") if top else F.lit(0)
    turned = turned.select("node", *others_of, "x.f", "x.q", "x.key", lead.alias("lead"))
    hot = turned.groupBy("f", "q", "lead").count().filter(F.col("count") > SPLIT_ABOVE).select("f", "q", "lead", F.lit(True).alias("hot"))
    nodes, deep = 1 << SPLIT_BITS, top + SPLIT_BITS
    node = F.shiftrightunsigned("key", 64 - deep).bitwiseAND(nodes - 1).cast("int")
    flips = F.transform(F.array(*[F.lit(x) for x in range(nodes) if x.bit_count() <= (deep - 1) // segment]), lambda x: node.bitwiseXOR(x))
    both = F.transform(flips, lambda o: F.least(node, o) * nodes + F.greatest(node, o))
    turned = turned.join(hot, ["f", "q", "lead"], "left").withColumn("pair", F.explode(F.when(F.col("hot"), both).otherwise(F.array(F.lit(-1)))))
    # Signed order of the keys is not that of their bits; flipping the first bit makes it so.
    rows = turned.select("f", "q", "lead", "pair", F.col("key").bitwiseXOR(F.lit(-(2**63))).alias("key"), "node", *others_of)
    rows = rows.repartition("f", "q", "lead", "pair").sortWithinPartitions("f", "q", "lead", "pair", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        f, q, lead, pair, key, ids, *bits = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        keys, bits = key.view(np.uint64) ^ np.uint64(1 << 63), [b.view(np.uint64) for b in bits]
        group = np.flatnonzero(np.concatenate([[True], (np.diff(f) != 0) | (np.diff(q) != 0) | (np.diff(lead) != 0) | (np.diff(pair) != 0)]))
        lo, hi = group, np.append(group[1:], len(keys))
        forest, zero = _Forest(len(keys)), np.zeros(len(lo), np.int64)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            good = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if bits:
                some = np.flatnonzero(good)
                good[some] = sum(np.bitwise_count(b[i[some]] ^ b[j[some]]).astype(np.int64) for b in bits) <= apart
            return good

        whole = pair[lo] < 0
        trie_join(keys, [x[whole] for x in (lo, hi, lo, hi, zero)], top, budget, forest, near, segment)
        # Node pairs of a dealt-out subtree: the first node's keys come first.
        lo, hi = lo[~whole], hi[~whole]
        first, second = pair[lo] // nodes, pair[lo] % nodes
        is_first = np.concatenate([[0], np.cumsum(_first_of((keys >> np.uint64(64 - deep)).astype(np.int64) & (nodes - 1), lo, hi, first))])
        own = first == second
        mid = np.where(own, hi, lo + is_first[hi] - is_first[lo])
        trie_join(keys, [lo, mid, np.where(own, lo, mid), hi, np.bitwise_count(first ^ second).astype(np.int64)], deep, budget, forest, near, segment)
        i = np.flatnonzero(forest.label != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[forest.label[i]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _first_of(nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(nodes), bool)
    for a, b, f in zip(lo.tolist(), hi.tolist(), first.tolist()):
        out[a:b] = nodes[a:b] == f
    return out


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node and root (the least node reachable) of every node that an edge has; ``most``: no more edges than that."""
    edges = stage(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", most)
    mark, most = None, edges.count()  # no round makes more
    while True:
        # Large star: larger neighbours of a node move to the least of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "star", most)
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.distinct(), "star", most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = BUDGET, many: int = 1, apart: int | None = None) -> DataFrame:
    """doc_id, text_key and fingerprints of every document, with ``first``: doc_id and text_key of the first document of
    its component, by doc_id (a null one last), then text_key."""
    rows = stage(fingerprints(docs, words, many), "fingerprints")
    names = [f"f{k}" for k in range(many)]
    node = F.col("f0") if many == 1 else F.xxhash64(*names)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = stage(rows.groupBy(*names).agg(F.min(key).alias("least")).withColumn("node", node), "classes", rows.count())
    # A forest of each turn of each fingerprint, unless a subtree is dealt out further; twice as many rows as nodes at most.
    n = classes.count()
    roots = stage(components(links(classes.select("node", *names), budget, apart), n * many * (budget + 1)), "roots", 2 * n).withColumnRenamed("node", "linked")
    joined = classes.join(roots, F.col("node") == F.col("linked"), "left").select(*names, "least", "root")
    linked = joined.filter(F.col("root").isNotNull())
    ids = linked.groupBy("root").agg(F.min("least").alias("first"))
    of_class = linked.join(ids, "root").select(*names, "first").unionByName(joined.filter(F.col("root").isNull()).select(*names, F.col("least").alias("first")))
    return rows.join(of_class, names).select("doc_id", "text_key", *names, "first")


def first_of_each(docs: DataFrame, words: int = 5, budget: int = 7, many: int = 4, apart: int = 39) -> DataFrame:
    """The documents without near copies of others: of each component the first one stays, repeated rows of it once.
    Rows without a doc_id are left alone.

    Four fingerprints of 64 bits over shingles of five words: 39 of 256 bits are what a Jaccard similarity of 0.8 gives
    on average. Of copies that similar, those are found that differ in at most seven bits in one of the four.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    groups = near_duplicates(known, words, budget, many, apart)
    stay = groups.filter((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = known.withColumn("__text_key", F.xxhash64(text_or_empty(docs))).dropDuplicates(["doc_id", "__text_key"])
    kept = keyed.join(stay, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def simhash_digest(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))

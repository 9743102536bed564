"""Document quality by Bradley-Terry pairwise ranking.

Each document has a strength, linear in statistics of its text. Preference pairs set a document labelled good before
one labelled bad; the weights minimise the logistic loss over all pairs of the two. The threshold is the strength that
parts the labels best, of all places between two labelled documents.

The fit takes every labelled row one may learn from. Nothing unbounded reaches the driver: a step of the weights needs
sums by label and bin of strength (``BINS``), the threshold one row for each range of strengths. How likely a pair is
the wrong way round is taken at the mean strengths of its two bins; everything else is exact, and so are threshold and
medians. Every document is scored over its whole text.

Defined results: null text is empty; empty texts are scored like any other; repeated labels of a doc_id count once
(the largest), and of rows with one doc_id the least features do; without rows of both labels every score is 1; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold, stage, text_or_empty

PAIRS = 60_000
BINS = 256  # of strength on either side of zero
KEEP_AT = 0.7

_CLASSES = np.zeros(256, np.int64)
for _i, _c in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-", b"!", b"|<>", b"#$%&*", b"=+_/\\@~^`[]{}"], 1):
    _CLASSES[list(_c)] = _i
_CLASSES[128:] = 10


def text_features(text: str) -> list[float]:
    """Shares of kinds of bytes, repetition of words and lines, lengths; all on scales that do not grow with the text."""
    data = text.encode()
    kinds = np.bincount(_CLASSES, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=11)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, n_lines, letters = max(len(words), 1), max(len(lines), 1), max(kinds[1] + kinds[2] + kinds[10], 1.0)
    ratio = lambda x: float(np.log1p(100 * x / n))
    return [
        float(kinds[1] / letters),
        ratio(kinds[3]),
        ratio(kinds[5]),
        ratio(kinds[6]),
        ratio(kinds[7]),
        ratio(kinds[8]),
        ratio(kinds[9]),
        ratio(sum(map(eq, words, words[1:]))),
        float(np.log1p(len(set(words))) / np.log1p(n)),
        1 - len(set(lines)) / n_lines,
        min(len(data) / n, 40.0) / 10,
        min(float(np.log1p(n)), 4.0),
    ]


N_FEATURES = 12


def features(docs: DataFrame) -> DataFrame:
    """The input's columns but the text, and f, the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            f = pa.array([text_features(t) for t in texts], pa.list_(pa.float64()))
            names = [x for x in part.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], f], [*names, "f"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.dtypes if c != "text"], "f array<double>"])
    return docs.mapInArrow(run, schema)


def fit_bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of w . (better - worse), by Newton's method."""
    rng = np.random.default_rng(7)
    x = better[rng.integers(0, len(better), pairs)] - worse[rng.integers(0, len(worse), pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))  # of the pair the wrong way round
        gradient = -(x * p[:, None]).mean(axis=0) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def best_quantile(strength: np.ndarray, good: np.ndarray, weight: np.ndarray) -> float:
    """The share of weight below the cut with the most weight on the right side; of equal cuts that in the widest gap."""
    order = np.argsort(strength, kind="stable")
    s, g, w = strength[order], good[order], weight[order]
    right = np.concatenate([[0], np.cumsum(w * ~g)]) + np.concatenate([np.cumsum((w * g)[::-1])[::-1], [0]])
    gaps = np.diff(np.concatenate([[s[0] - 1], s, [s[-1] + 1]]))
    right = np.where(gaps > 0, right, -1)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(w[: best[np.argmax(gaps[best])]].sum() / w.sum())


def at_quantile(strength: np.ndarray, weight: np.ndarray, quantile: float) -> float:
    """The strength with that share of weight below it, half way between the two it lies between."""
    order = np.argsort(strength, kind="stable")
    s, w = np.concatenate([[strength[order[0]] - 1], strength[order], [strength[order[-1]] + 1]]), weight[order]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), quantile + 1e-12, "right"))
    return float((s[k] + s[k + 1]) / 2)


class Ranker:
    """Weights on standardised features, threshold and scale; score() is KEEP_AT at the threshold."""

    def __init__(self, mean: np.ndarray | None = None, std: np.ndarray | None = None, w: np.ndarray | None = None, threshold: float = 0, scale: float = 1):
        self.mean, self.std, self.w, self.threshold, self.scale, self.constant = mean, std, w, threshold, scale, w is None

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.constant or not len(f):
            return np.ones(len(f))
        z = (strengths(f, self.mean, self.std, self.w) - self.threshold) / self.scale + np.log(KEEP_AT / (1 - KEEP_AT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def strengths(f: np.ndarray, mean: np.ndarray, std: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each row by itself: equal rows are equally strong wherever they lie."""
    return ((f - mean) / std * w).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


_UPPER = np.triu_indices(N_FEATURES)


def _by_strength(rows: DataFrame, mean: np.ndarray, std: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each label (good, bad) and bin of strength: rows, their mean strength, and the sums of their features and of
    the products of two; BINS on either side of zero, narrow about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4 * BINS, 2 + N_FEATURES + len(_UPPER[0])))
        for batch in batches:
            f = _matrix(batch.column("f"))
            for i in range(0, len(f), 10_000):
                x, s = (f[i : i + 10_000] - mean) / std, strengths(f[i : i + 10_000], mean, std, w)
                key = 2 * (np.floor(s / (4 + np.abs(s)) * BINS).astype(np.int64) + BINS) + (batch.column("label").to_numpy()[i : i + 10_000] != 1)
                for k, values in enumerate([np.ones(len(s)), s, *x.T, *(x[:, _UPPER[0]] * x[:, _UPPER[1]]).T]):
                    total[:, k] += np.bincount(key, values, len(total))
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["key", "v"])

    width = 2 + N_FEATURES + len(_UPPER[0])
    found = rows.select("label", "f").mapInArrow(run, "key long, v array<double>")
    got = np.array([list(r) for r in found.groupBy("key").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).orderBy("key").collect()], float).reshape(-1, width + 1)
    out = []
    for label in range(2):
        v = got[got[:, 0] % 2 == label][:, 1:]
        both = np.zeros((len(v), N_FEATURES, N_FEATURES))
        both[:, _UPPER[0], _UPPER[1]] = both[:, _UPPER[1], _UPPER[0]] = v[:, 2 + N_FEATURES :]
        out += [v[:, 0], v[:, 1] / np.maximum(v[:, 0], 1), v[:, 2 : 2 + N_FEATURES], both]
    return tuple(out)


def fit_all_pairs(rows: DataFrame, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean and deviation of the features, and the weights that minimise the mean logistic loss over all pairs of a
    good and a bad row, by Newton's method; None without rows of both labels. Rows have label and f.

    Sums over pairs are sums over pairs of bins: how likely a pair is the wrong way round follows from the mean
    strengths of the two bins, what it weighs from all rows in them."""
    zero = np.zeros(N_FEATURES)
    n, _, x, xx, m, _, y, yy = _by_strength(rows, zero, zero + 1, zero)
    if not len(n) or not len(m):
        return None
    mean = (x.sum(axis=0) + y.sum(axis=0)) / (n.sum() + m.sum())
    square = np.diag(xx.sum(axis=0) + yy.sum(axis=0)) / (n.sum() + m.sum())
    std, w, moved = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3, zero, np.inf
    for _ in range(steps):
        n, s, x, xx, m, t, y, yy = _by_strength(rows, mean, std, w)
        p = 1 / (1 + np.exp(np.clip(s[:, None] - t, -30, 30)))
        q, pairs = p * (1 - p), n.sum() * m.sum()
        gradient = -(x.T @ (p @ m) - y.T @ (n @ p)) / pairs + ridge * w
        cross = x.T @ q @ y
        hessian = (np.tensordot(q @ m, xx, 1) + np.tensordot(n @ q, yy, 1) - cross - cross.T) / pairs + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w, last, moved = w - move, moved, np.abs(move).max()
        # Near the end steps shrink by far more than half, until rows that change their bin are all that moves.
        if moved < 1e-6 or 2 * moved > last and moved < 1e-2:
            break
    return mean, std, w


def cut(rows: DataFrame) -> tuple[float, float]:
    """The strength with the most rows on the right side of it, of equal ones that in the widest gap; and how far the
    medians of good and bad rows are apart. Rows have s and good (1 or 0); all count, in the order of s."""
    by_s = rows.groupBy("s").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    ranked = stage(by_s.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "strengths")
    parts = ranked.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("s").alias("s")).orderBy("part").collect()
    before, good, bad, last = {}, 0, 0, None
    for r in parts:
        before[r.part], good, bad, last = (good, bad, last), good + r.g, bad + r.b, r.s
    final = parts[-1].part

    def run(part: pa.Table) -> pa.Table:
        part, (g0, b0, below) = part.sort_by("s"), before[part.column("part")[0].as_py()]
        s, g, b = (part.column(c).to_numpy() for c in "sgb")
        edge = np.append(s[0] - 1 if below is None else below, s)
        low, high = edge[:-1], s
        g_below, b_below = g0 + np.cumsum(g) - g, b0 + np.cumsum(b) - b
        right = b_below + good - g_below
        if part.column("part")[0].as_py() == final:
            low, high, right = edge, np.append(s, s[-1] + 1), np.append(right, bad)
        best = np.flatnonzero(right == right.max())
        k = best[np.argmax((high - low)[best])]
        at = lambda below, own, rank: next(iter(s[(below <= rank) & (rank < below + own)].tolist()), None)
        ranks = [at(g_below, g, (good - 1) // 2), at(g_below, g, good // 2), at(b_below, b, (bad - 1) // 2), at(b_below, b, bad // 2)]
        row = [int(right[k]), float(high[k] - low[k]), float(low[k] + high[k]) / 2, *ranks]
        return pa.Table.from_arrays([pa.array([x], pa.int64() if i == 0 else pa.float64()) for i, x in enumerate(row)], ["right", "gap", "at", "g1", "g2", "b1", "b2"])

    found = ranked.groupBy("part").applyInArrow(run, "right long, gap double, at double, g1 double, g2 double, b1 double, b2 double").collect()
    middle = {c: next(r[c] for r in found if r[c] is not None) for c in ("g1", "g2", "b1", "b2")}
    best = max(found, key=lambda r: (r.right, r.gap, -r["at"]))
    return best["at"], (middle["g1"] + middle["g2"] - middle["b1"] - middle["b2"]) / 2


def labelled(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and label of the rows one may learn from."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.filter(crc_fold(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))


def fit_features(read: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 4, held_out: int = 2) -> Ranker:
    """By all labelled rows one may learn from; ``read`` has doc_id and f."""
    known = labelled(labels, column, modulus, held_out).filter(F.col("label").isin(0, 1))
    rows = read.join(known.hint("shuffle_hash"), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("f").alias("f"))
    rows = stage(rows.select("label", "f"), "labelled")
    if not (fitted := fit_all_pairs(rows)):
        return Ranker()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = (batch.column("label").to_numpy() == 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(strengths(_matrix(batch.column("f")), *fitted)), pa.array(good)], ["s", "good"])

    threshold, apart = cut(rows.mapInArrow(run, "s double, good long"))
    return Ranker(*fitted, threshold, max(1e-6, apart / 8))


def read_documents(docs: DataFrame) -> DataFrame:
    """doc_id and f of every document."""
    return features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text")))


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    return fit_features(read_documents(docs), labels)


def _with_body(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, with the text besides where it is not among them."""
    return docs.select(*[F.col(c) for c in keep], *([] if "text" in keep else [text_or_empty(docs).alias("__text")]))


def score(docs: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the input and the score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, body):
            got = ranker.score(np.array([text_features(t) for t in texts], float).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(got)], [*keep, "__score"])

    rows, body, types = _with_body(docs, keep), "text" if "text" in keep else "__text", dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "__score double"]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    read = stage(read_documents(docs), "features")  # short rows, for the fit and the scores
    ranker = fit_features(read, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranker.score(_matrix(batch.column("f"))))], ["doc_id", "score"])

    out = read.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))

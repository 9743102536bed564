"""Toxicity by class-conditional Kneser-Ney models of how words are spelt.

For each class a model of order seven over the characters of words is made from the number of labelled documents of
that class that hold each word. Both back off to the same lower orders of continuation counts over all labelled
documents, so that spellings that neither class knows say nothing. A word's evidence is the difference of its toxic
and ordinary log-likelihood by its length. A document's evidence is that of all its words by their length, of its few
most telling words, and how many of its words are telling, at several levels: stems that ordinary documents hold too
tell by how often they come. A logistic curve turns it into a score; it is fitted on at most ``FIT_ROWS`` labelled
documents, each read by the counts of all the others: its own are taken off the models of its class first.

Words are runs of letters, digits and underscores of any length. Counts cover every row one may learn from and are
kept for each gram by itself, whole code points told apart: the tables that reach driver and tasks grow with the
number of different grams of the labelled documents. They are sent once, for the fit and the scores.

Defined results: null and wordless texts have no evidence (0) and a score as that gives; repeated labels of a doc_id
count once (the largest); of rows with one doc_id the curve is fitted on the least text; without rows of both labels
every score is 0; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold, stage, text_or_empty
from .quality import _with_body, labelled
from .tokens import _Index

ORDER = 7
BITS = 9  # of a character in a key; the next 9 are in the gram's high key, and no letter has more
SIGNS = 1 << 2 * BITS
FIT_ROWS = 20_000
FIT_CHARS = 200_000  # of texts read at once without their own counts: all grams of all their words are held by document
LIMIT = 6.0  # of a word's evidence
TELLING = 2.0  # evidence of a whole word that counts as telling
LEVELS = np.array([1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0])  # of a whole word's evidence, whose shares of words count
_WORD = re.compile(r"\w+")
_MASK = (1 << BITS) - 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of the full order (starts, the letters, an end), and the number of each word's; of the low or
    the high bits of the letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = letters >> BITS & _MASK if high else np.where(letters > 2, letters & _MASK, 3)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(codes)) + np.repeat((ORDER) * np.arange(len(words)), sizes) + ORDER - 1
    line = np.full(len(codes) + ORDER * len(words), 0 if high else 1, np.int64)
    line[at] = codes
    ends = begin + sizes + ORDER * np.arange(len(words)) + ORDER - 1
    line[ends] = 0 if high else 2
    keys = line[: len(line) - ORDER + 1].copy()
    for k in range(1, ORDER):
        keys = keys << BITS | line[k : len(line) - ORDER + 1 + k]
    first = begin + ORDER * np.arange(len(words))
    n = sizes + 1
    return keys[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(words) else np.zeros(0, np.int64), n


def count_grams(rows: DataFrame) -> DataFrame:
    """key, high and the toxic and ordinary documents (t, o) of each gram, of a table with text and label."""

    def flush(counts: dict) -> pa.RecordBatch:
        words = list(counts)
        (keys, n), (high, _) = grams(words), grams(words, True)
        weights = np.array(list(counts.values()), np.int64).reshape(-1, 2)
        _, at, inverse = np.unique(_ids(keys, high), return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, np.repeat(weights[:, k], n), len(at)).astype(np.int64) for k in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[at], high[at], *sums)], ["key", "high", "t", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for part, texts in chunks(batches):
            for text, label in zip(texts, part.column("label").to_pylist()):
                for w in set(words_of(text)):
                    if w not in counts:
                        counts[w] = [0, 0]
                    counts[w][label != 1] += 1
            if len(counts) > 300_000:
                yield flush(counts)
                counts = {}
        if counts:
            yield flush(counts)

    found = rows.select("text", "label").mapInArrow(run, "key long, high long, t long, o long")
    return found.groupBy("key", "high").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _ids(key: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One number of 64 bits for key and high: the key itself where high is 0, else mixed with it."""
    if not high.any():
        return key
    x = high.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (x ^ x >> np.uint64(32)).view(np.int64)


def _spread(ids: np.ndarray) -> np.ndarray:
    return ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _gathered(df: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """id and ``names`` of every gram of a table with a row for each, in the order of _spread, as arrays on the driver."""
    got = df.select("key", "high", *[F.col(c).cast("float").alias(c) for c in names]).toArrow()
    ids = _ids(got.column("key").to_numpy(), got.column("high").to_numpy())
    order = np.argsort(_spread(ids))
    return {"id": ids[order]} | {c: got.column(c).to_numpy()[order] for c in names}


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.75


class _Table:
    """Where ids lie in an array of different ones in the order of _spread: a few looks by the first bits of it."""

    def __init__(self, ids: np.ndarray):
        self.ids, bits = ids, max(1, len(ids).bit_length())
        self.shift = np.uint64(64 - bits)
        filled = np.bincount((_spread(ids) >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id; -1 for an unknown one."""
        slot = (_spread(ids) >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out, todo = np.full(len(ids), -1, np.int32), np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            hit = self.ids[at] == ids[todo]
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end = todo[more], at[more] + 1, end[more]
        return out


Level = tuple[_Table, np.ndarray, _Table, np.ndarray, np.ndarray]
Thin = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level(grams_: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> Thin:
    """max(count - D, 0) by gram; one by total, and D * kinds by total, by context; only what is not at its default."""
    d, gram, seen = _discount(counts), counts > 0, totals > 0
    by = (1 / totals[seen]).astype(np.float32)
    back = np.minimum(d * kinds[seen] * by, 1).astype(np.float32)
    return grams_[gram], np.maximum(counts[gram] - d, 0).astype(np.float32), contexts[seen], by, back


def _end(x: np.ndarray, default: float) -> np.ndarray:
    """The last entry is what holds for an unknown gram or context."""
    return np.append(x, np.float32(default))


def _prob(level: Level, gram: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    grams_, less, contexts, by, back = level
    at = contexts.find(context)
    return np.minimum(less[grams_.find(gram)] * by[at], 1) + back[at] * lower


class Class:
    """One class's model of the full order by its counts, so that a document's own can be taken off."""

    def __init__(self, grams_: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray, kinds: np.ndarray):
        gram, seen = counts > 0, totals > 0
        self.discount = _discount(counts)
        self.grams, self.counts = grams_[gram], counts[gram].astype(np.float32)
        self.contexts, self.totals, self.kinds = contexts[seen], totals[seen].astype(np.float32), kinds[seen].astype(np.float32)

    @staticmethod
    def opened(plain: dict) -> Class:
        """Of an instance's attributes, with the tables that find ids."""
        out = object.__new__(Class)
        out.discount, out.grams, out.contexts = plain["discount"], _Table(plain["grams"]), _Table(plain["contexts"])
        out.counts, out.totals, out.kinds = (_end(plain[x], 0) for x in ("counts", "totals", "kinds"))
        return out

    def prob(self, gram: np.ndarray, context: np.ndarray, lower: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Of each gram; ``own`` has the document of each whose counts are to be left out, -1 for none."""
        count, at = self.counts[self.grams.find(gram)], self.contexts.find(context)
        total, kinds = self.totals[at], self.kinds[at]
        if own is not None and len(mine := np.flatnonzero(own >= 0)):
            document = _spread(own[mine] + 1)
            _, first, of = np.unique(_spread(gram[mine]) ^ document, return_index=True, return_inverse=True)
            count[mine] = np.maximum(count[mine] - np.bincount(of)[of], 0)
            gone = np.zeros(len(mine), bool)  # grams that no other document has
            gone[first] = True
            _, of = np.unique(_spread(context[mine]) ^ document, return_inverse=True)
            kinds[mine] = np.maximum(kinds[mine] - np.bincount(of, gone & (count[mine] <= 0))[of], 0)
            total[mine] = np.maximum(total[mine] - np.bincount(of)[of], 0)
        share = np.maximum(count - self.discount, 0) / np.maximum(total, 1)
        return np.where(total > 0, np.minimum(share, 1) + np.minimum(self.discount * kinds / np.maximum(total, 1), 1) * lower, lower)


class Models:
    """The two classes' models over the shared lower orders, as arrays on the driver."""

    def __init__(self, counts: DataFrame):
        c = _gathered(counts, ["t", "o"])
        seen = lambda x: F.when(F.col(x) > 0, 1).otherwise(0)
        h = _gathered(counts.groupBy(*_context()).agg(*[F.sum(x).alias(x) for x in ("t", "o")], *[F.sum(seen(x)).alias(f"k_{x}") for x in ("t", "o")]), ["t", "o", "k_t", "k_o"])
        self.classes = tuple(Class(c["id"], c[x], h["id"], h[x], h[f"k_{x}"]) for x in ("t", "o"))
        del c, h
        self.shared, below = [], counts
        for order in range(ORDER - 1, 0, -1):  # each gram counts the different characters before it
            last = (1 << BITS * order) - 1
            below = below.groupBy(*[F.col(k).bitwiseAND(last).alias(k) for k in ("key", "high")]).agg(F.count("*").alias("n"))
            g = _gathered(below, ["n"])
            k = _gathered(below.groupBy(*_context()).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), ["n", "kinds"])
            self.shared.append(_level(g["id"], g["n"], k["id"], k["n"], k["kinds"]))

    def plain(self) -> tuple[list[dict], list[Thin]]:
        """As arrays alone, which tasks can read without this module."""
        return [vars(c) for c in self.classes], self.shared


def _context() -> list[Column]:
    return [F.shiftright(k, BITS).alias(k) for k in ("key", "high")]


class Judge:
    """Evidence of words by the models, in a task."""

    def __init__(self, plain: tuple[list[dict], list[Thin]]):
        classes, shared = plain
        self.classes = [Class.opened(c) for c in classes]
        self.shared = [(_Table(g), _end(less, 0), _Table(h), _end(by, 0), _end(back, 1)) for g, less, h, by, back in shared]

    def __call__(self, words: list[str], docs: np.ndarray | None = None, toxic: np.ndarray | None = None) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word by its length; where ``docs`` and ``toxic`` tell the document
        of each word and its class, without what that document added to its class."""
        (keys, n), (high, _) = grams(words), grams(words, True)
        if not len(keys):
            return np.zeros(len(words))
        p = np.full(len(keys), 1 / SIGNS)
        for order, level in zip(range(1, ORDER), self.shared[::-1]):
            key, up = (x & ((1 << BITS * order) - 1) for x in (keys, high))
            p = _prob(level, _ids(key, up), _ids(key >> BITS, up >> BITS), p)
        gram, context = _ids(keys, high), _ids(keys >> BITS, high >> BITS)
        own = lambda k: None if docs is None else np.repeat(np.where(toxic == k, docs, -1), n)
        a, b = (c.prob(gram, context, p, own(k)) for c, k in zip(self.classes, (True, False)))
        return np.clip(np.add.reduceat(np.log(a) - np.log(b), np.cumsum(n) - n) / n, -LIMIT, LIMIT)


FEATURES = 6 + len(LEVELS)


def document_evidence(values: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Of a document's words, by their evidence and length: two and four most telling words, mean by length, share and
    number of telling words, length, and the share of words over each of LEVELS, drawn to half a percent by 100 words."""
    n, total = len(values), values * sizes
    if not n:
        return [0.0] * FEATURES
    top = np.sort(np.partition(values, max(0, n - 4))[-4:])[::-1]
    sums = np.partition(total, max(0, n - 4))[-4:]
    telling = int((total > TELLING).sum())
    over = n - np.searchsorted(np.sort(total), LEVELS, "right")
    shares = np.log((over + 0.5) / (n + 100) * 100)
    return [top[:2].sum() / 2, sums.sum() / 4, total.sum() / sizes.sum() * 10, telling / n * 30, np.log1p(telling), np.log1p(n) / 3, *shares]


class Reader:
    """Evidence of documents, each different word judged once while it is held."""

    def __init__(self, judge: Judge, limit: int = 300_000):
        self.judge, self.limit = judge, limit
        self._clear()

    def _clear(self) -> None:
        self.index, self.known, self.sizes = _Index(), np.zeros(0), np.zeros(0)

    def read(self, texts: list[str]) -> np.ndarray:
        """A row of FEATURES for each text."""
        if len(self.index) > self.limit:
            self._clear()
        words = [words_of(t) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if new := self.index.new:
            self.known = np.concatenate([self.known, self.judge(new)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), float, len(new)) + 1])
            self.index.new = []
        return _by_document(self.known[at], self.sizes[at], n)


def _by_document(values: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.array([document_evidence(values[a:b], sizes[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]).reshape(-1, FEATURES)


def read_labelled(judge: Judge, texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text that the models were made with, as if they were made without it."""
    words = [Counter(words_of(t)) for t in texts]
    n, flat = np.fromiter(map(len, words), np.int64, len(words)), list(chain.from_iterable(words))
    doc, times = np.repeat(np.arange(len(words)), n), np.fromiter(chain.from_iterable(c.values() for c in words), np.int64, len(flat))
    values, sizes = judge(flat, doc, toxic[doc]), np.fromiter(map(len, flat), float, len(flat)) + 1
    return _by_document(np.repeat(values, times), np.repeat(sizes, times), np.bincount(doc, times, len(words)).astype(np.int64))


def evidence_of_labelled(judge: Judge, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label and x, the row of FEATURES, of tables with text; a few texts at a time."""
    for part, texts in chunks(batches, most=FIT_CHARS):
        x = read_labelled(judge, texts, part.column("label").to_numpy() == 1)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic curve, by damped Newton steps with a small ridge on the weights."""
    one = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(one.shape[1]), np.array([1e-4] * x.shape[1] + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        g = one.T @ (p - y) / len(y) + ridge * w
        h = (one * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ one / len(y) + np.diag(ridge)
        move = np.clip(np.linalg.solve(h, g), -3, 3)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


class Scorer:
    """The models as they were sent to all tasks, and the curve."""

    def __init__(self, sent: Broadcast | None, curve: tuple[np.ndarray, float] | None = None):
        self.sent, self.curve = sent, curve


def on_curve(evidence: np.ndarray, curve: tuple[np.ndarray, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence @ curve[0] + curve[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, column: str = "toxic", modulus: int = 5, held_out: int = 0) -> Scorer:
    known = labelled(labels, column, modulus, held_out)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    # Always the same join: labels grow with the corpus and are no table to broadcast.
    counts = stage(count_grams(text.join(known.hint("shuffle_hash"), "doc_id")), "grams")
    ends = counts.agg(F.sum("t"), F.sum("o")).first()
    if not ends[0] or not ends[1]:
        return Scorer(None)
    sent = docs.sparkSession.sparkContext.broadcast(Models(counts).plain())  # an entry for each different gram of the labelled rows
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from evidence_of_labelled(Judge(sent.value), batches)

    marked = text.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most fit_rows
    got = marked.mapInArrow(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    return Scorer(sent, fit_curve(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["label"].to_numpy().astype(float)))


def score(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the input and __score of each document."""
    rows, body, types = _with_body(docs, keep), "text" if "text" in keep else "__text", dict(docs.dtypes)
    if scorer.sent is None:
        return rows.select(*keep, F.lit(0.0).alias("__score"))
    sent, curve = scorer.sent, scorer.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Judge(sent.value))
        for part, texts in chunks(batches, body):
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(on_curve(reader.read(texts), curve))], [*keep, "__score"])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "__score double"]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(ids, fit(docs, labels, fit_rows), ["doc_id"])
    held = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))

"""Byte-level BPE by recursive queries in an embedded DuckDB, one database a Python worker.

Words are token-position rows, at first one row a byte. A round joins neighbouring rows with the merge table and
contracts in each word the leftmost pair of least rank, and in the same round its other occurrences that do not
overlap. Rounds go on until no pair of any word is in the table. Ordered aggregation of the tokens' bytes
decodes. A word that is a token itself is not contracted, as in the library that the ranks are made for.

Each different word is encoded once a worker while it is held. A query runs at most ``ROUNDS`` rounds over at most
``ROWS`` rows and is then started again on what is not yet done, so its memory is bounded for words of any length.

Defined results: null text is empty; an empty text has no ids and decodes to nothing; repeated rows are encoded each
for itself; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_chunks, groups, held_by_worker, text_or_empty
from .tokens import WordEncoder, spaced_words

ROUNDS = 64
ROWS = 400_000

CONTRACT = """
WITH RECURSIVE step(round, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM start
    UNION ALL
    SELECT round + 1, word, pos, CASE WHEN {hit} THEN m ELSE tok END
    FROM (
        SELECT p.*, g.m, min(g.m::BIGINT << 32 | pos) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
               lag(g.m) OVER in_order AS m_before, lag(tok) OVER in_order AS tok_before, lag(pos) OVER in_order AS pos_before
        FROM (
            SELECT *, lead(tok) OVER in_order AS nxt{stretch}
            FROM step WHERE round < {rounds} WINDOW in_order AS (PARTITION BY word ORDER BY pos)
        ) p LEFT JOIN merges g ON g.pair = (p.tok::BIGINT << 20) | p.nxt
        WINDOW in_order AS (PARTITION BY word ORDER BY pos)
    )
    WHERE best IS NOT NULL AND NOT coalesce({hit_before}, false)
)
SELECT round, word, pos, tok FROM step
"""
#: Pairs of equal tokens can overlap. In short words only the leftmost of them is contracted in a round; in long ones
#: every second of a stretch of equal tokens, from its first on.
SHORT = {
    "hit": "m = best >> 32 AND (tok <> nxt OR pos = best & 4294967295)",
    "hit_before": "m_before = best >> 32 AND (tok_before <> tok OR pos_before = best & 4294967295)",
    "stretch": "",
}
LONG = {
    "hit": "m = best >> 32 AND (tok <> nxt OR nth % 2 = 1)",
    "hit_before": "m_before = best >> 32 AND (tok_before <> tok OR nth % 2 = 0)",
    "stretch": """, row_number() OVER (PARTITION BY word, tok, stretch ORDER BY pos) AS nth
            FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, tok ORDER BY pos) AS stretch FROM step) step""",
}
LONG_WORD = 256
DECODE = "SELECT word, string_agg(bytes, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY word"


class DuckBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.findall = regex.compile(pattern).findall
        pairs = [(self.ranks[t[:k]] << 20 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "800MB"})
        self.con.register("m", pa.table({"pair": pa.array([p[0] for p in pairs], pa.int64()), "m": pa.array([p[1] for p in pairs], pa.int32())}))
        self.con.register("v", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.hex() for t in self.ranks]}))
        self.con.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM v")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words = WordEncoder(lambda words: [self.encode_words(words.to_pylist())], self.findall, limit=1_000_000, held=40_000_000)
        self.chunks = WordEncoder(self._encode_chunks, spaced_words, True, 1_000_000, 40_000_000)

    def _contract(self, word: np.ndarray, pos: np.ndarray, tok: np.ndarray, rounds: int, long: bool) -> tuple[np.ndarray, ...]:
        self.con.register("start", pa.table({"word": word, "pos": pos, "tok": tok}))
        query = CONTRACT.format(rounds=rounds, **(LONG if long else SHORT))
        if long:
            query = query.replace("FROM step WHERE", "WHERE", 1)
        got = self.con.execute(query).fetchnumpy()
        rounds_, word, pos, tok = (np.asarray(got[c]) for c in ("round", "word", "pos", "tok"))
        order = np.argsort(rounds_, kind="stable")
        last = np.zeros(int(word.max()) + 1, np.int32)
        last[word[order]] = rounds_[order]  # of equal places the last is kept
        end = rounds_ == last[word]
        return rounds_[end], word[end], pos[end], tok[end]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, of whole matches of the pattern."""
        data = [w.encode() for w in words]
        whole = [self.ranks.get(w, -1) for w in data]
        todo = [i for i, t in enumerate(whole) if t < 0]
        out: list[tuple[np.ndarray, ...]] = [(np.flatnonzero(np.array(whole, np.int64) >= 0), np.array([t for t in whole if t >= 0], np.int64))]
        out[0] = (out[0][0], np.zeros(len(out[0][0]), np.int64), out[0][1])
        sizes = np.array([len(data[i]) for i in todo], np.int64)
        ends = np.cumsum(sizes)
        for lo, hi in groups(sizes, ROWS):
            n, ids = sizes[lo:hi], np.array(todo[lo:hi], np.int64)
            flat = self.byte[np.frombuffer(b"".join(data[i] for i in todo[lo:hi]), np.uint8)]
            word = np.repeat(ids, n).astype(np.int32)
            pos = (np.arange(len(flat)) - np.repeat(ends[lo:hi] - n - (ends[lo] - n[0]), n)).astype(np.int32)
            while len(word):
                rounds = max(1, min(ROUNDS, 40 * ROWS // len(word)))
                r, word, pos, tok = self._contract(word, pos, flat, rounds, bool(n.max() > LONG_WORD))
                open_ = r == rounds
                out.append((word[~open_], pos[~open_], tok[~open_].astype(np.int64)))
                word, pos, flat = word[open_], pos[open_], tok[open_]
        word, pos, tok = (np.concatenate([x[k] for x in out]) for k in range(3))
        order = np.lexsort((pos, word))
        return tok[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _encode_chunks(self, chunks: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, and the bytes that they decode to."""
        ids, sizes = self.words.encode(chunks.to_pylist())
        back = self.decode(ids, sizes)
        return [(ids, sizes), (np.frombuffer(b"".join(back), np.uint8), np.array([len(x) for x in back], np.int64))]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each stretch of ids."""
        out = [b""] * len(sizes)
        ends = np.cumsum(sizes)
        for lo, hi in groups(sizes, ROWS):
            n = sizes[lo:hi]
            first = ends[lo] - n[0]
            word = np.repeat(np.arange(lo, hi), n)
            self.con.register("ids", pa.table({"word": word, "pos": np.arange(len(word)), "tok": ids[first : ends[hi - 1]].astype(np.int32)}))
            for w, h in self.con.execute(DECODE).fetchall():
                out[w] = bytes.fromhex(h)
        return out

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and decoded bytes of each text."""
        (ids, n), (back, size) = self.chunks.encode_all(texts)
        ids, ends, bounds = ids.astype("<u4"), np.cumsum(n).tolist(), np.cumsum(size).tolist()
        for i, j, a, b in zip([0, *ends], ends, [0, *bounds], bounds):
            yield ids[i:j], back[a:b].tobytes()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held_by_worker(("bpe", ranks_path, pattern), lambda: DuckBpe(ranks_path, pattern))
        for part, texts in arrow_chunks(batches):
            rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()) for ids, back in bpe.read(texts)]
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

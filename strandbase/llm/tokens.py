"""Token-ID output: encode, pack each id in the fewest bits, write shards, read them back.

A shard is one file of one range of doc_ids:

    magic "SBTOK1\\0\\0" | u32 bits | u32 ids a block | u64 documents | u64 ids
    | i64 doc_id[documents] | u32 ids[documents] | u64 block offset[blocks + 1] | payload

Each block holds the same number of ids (the last may hold fewer), packed big-endian at ``bits`` bits an id
and padded to whole bytes, so that any id range is read from its blocks alone.

Defined results: null text is empty; an empty document holds the end id alone; a null doc_id sorts first and
comes back as null; repeated doc_ids stay separate documents; an empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_chunks, commit_file, held_by_worker, new_path, small_batches, text_or_empty

MAGIC = b"SBTOK1\0\0"
HEAD = "<8sIIQQ"
BLOCK = 65_536
NULL_ID = -(2**63)
#: White space as the tokenizers' expressions have it (str.isspace has U+001C to U+001F besides).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile("[\x1c-\x1f]")
_BARE = re.compile(rf"[^{SPACE}]+")
_LEADING = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Fixed value: how byte-level tokenizers of this kind cut a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are encoded many in one string: spaced ones of letters whose kinds no Unicode version disputes, bare ones
#: of Latin letters with punctuation after them (no letter of these is changed by normalisation but to lower case).
_JOINED_SPACED = r"^ ?[!-~\x{a1}-\x{24f}\x{400}-\x{523}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]+$"
_MARKS = ".,;:!?*$%&#|"
_JOINED_BARE = rf"^[A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{ff}}]+[{_MARKS}]*$"


def bare_words(text: str) -> list[str]:
    """Runs without white space, for tokenizers that drop white space."""
    return _BARE.findall(text) if _ODD.search(text) else text.split()


def spaced_words(text: str) -> list[str]:
    """Runs with the space before them, for byte-level tokenizers: their matches never cross these borders."""
    return _LEADING.findall(text)


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class WordEncoder:
    """Encodes texts word by word. Words that were met before are looked up by Arrow; it holds at most ``limit`` words
    and ``held`` bytes of them, and lets the least used go.

    ``split`` cuts one text into words. Most texts are cut by Arrow instead: for bare words at ASCII white space
    (what other white space is left in a word, the tokenizer drops itself), for spaced words before each space,
    which is right where no two spaces meet and none ends the text. ``encode_new`` has of different words the ids one
    after another and the number of each word's; more such pairs may follow, and are kept beside the ids.
    """

    def __init__(self, encode_new: Callable[[pa.Array], list[tuple[np.ndarray, np.ndarray]]], split, spaced: bool = False, limit: int = 400_000, held: int = 16_000_000):
        self.encode_new, self.split, self.spaced, self.limit, self.held = encode_new, split, spaced, limit, held
        self.words, self.hits = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.kept: list[list[np.ndarray]] = []  # starts, sizes and values of the words

    def _trim(self) -> None:
        """Keep the half that was met most often."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: min(len(self.hits), self.limit) // 2])
        if self.words.nbytes > 4 * self.held:  # very long words
            keep = keep[:0]
        for k in self.kept:
            starts, sizes, values = k
            k[:] = np.cumsum(sizes[keep]) - sizes[keep], sizes[keep], values[_ranges(starts[keep], sizes[keep])]
        self.words, self.hits = self.words.take(pa.array(keep)), self.hits[keep] // 2

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where what is kept of different words lies."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = at < 0
        if unknown.any() or not self.kept:
            new = words.filter(pa.array(unknown))
            for i, (values, sizes) in enumerate(self.encode_new(new)):
                if i == len(self.kept):
                    self.kept.append([np.zeros(0, np.int64), np.zeros(0, np.int64), values[:0]])
                k = self.kept[i]
                k[:] = np.concatenate([k[0], len(k[2]) + np.cumsum(sizes) - sizes]), np.concatenate([k[1], sizes]), np.concatenate([k[2], values])
            at[unknown] = len(self.words) + np.arange(len(new))
            self.words, self.hits = pa.concat_arrays([self.words, new]), np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.hits[at] += 1
        return at

    def _by_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        coded, per_text = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.spaced:
            return self._places(coded.dictionary)[coded.indices.to_numpy()], per_text
        # The first word of a text has no space before it.
        first = pc.list_element(lists, 0).dictionary_encode() if len(lists) else coded.slice(0, 0)
        places = self._places(pa.concat_arrays([pc.binary_join_element_wise("", coded.dictionary, " "), first.dictionary]))
        at = places[coded.indices.to_numpy()]
        if len(at):
            at[np.cumsum(per_text) - per_text] = places[len(coded.dictionary) :][first.indices.to_numpy()]
        return at, per_text

    def _by_split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.split(t) for t in texts]
        coded = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        return self._places(coded.dictionary)[coded.indices.to_numpy()], np.fromiter(map(len, words), np.int64, len(words))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text."""
        return self.encode_all(texts)[0]

    def encode_all(self, texts: pa.Array | list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of everything that is kept."""
        if len(self.words) > self.limit or self.words.nbytes > self.held:
            self._trim()
        if isinstance(texts, list):
            at, per_text = self._by_split(texts)
        elif self.spaced and (odd := pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)).any():
            (at_a, n_a), (at_b, n_b) = self._by_arrow(texts.filter(pa.array(~odd))), self._by_split(texts.filter(pa.array(odd)).to_pylist())
            per_text = np.zeros(len(odd), np.int64)
            per_text[~odd], per_text[odd] = n_a, n_b
            at, of_odd = np.zeros(per_text.sum(), np.int64), np.repeat(odd, per_text)
            at[~of_odd], at[of_odd] = at_a, at_b
        else:
            at, per_text = self._by_arrow(texts)
        out, edges = [], np.concatenate([[0], np.cumsum(per_text)])
        for starts, sizes, values in self.kept:
            n = sizes[at]
            out.append((values[_ranges(starts[at], n)], np.diff(np.concatenate([[0], np.cumsum(n)])[edges])))
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _line(pieces: pa.Array) -> str:
    """All pieces, a line feed after each."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), "\n")[0].as_py() + "\n"


def _bytes_of_letters() -> dict[str, int]:
    """How vocabulary files of this kind write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _merger(model: dict, spaced: bool):
    """The library's merges by rank over one long string: of a byte-level vocabulary as it is; of one with word ends
    with a line feed for each end. Ids must rise with the order of the merges, which is checked."""
    import tiktoken

    letters, end = _bytes_of_letters(), model.get("end_of_word_suffix") or None
    raw = lambda t: bytes(map(letters.__getitem__, t.removesuffix(end) if end else t)) + (b"\n" if end and t.endswith(end) else b"")
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])) or spaced == bool(end):
        raise ValueError("a vocabulary of another kind")
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL if spaced else r"[^\n]+\n", mergeable_ranks={raw(t): i for t, i in model["vocab"].items()}, special_tokens={})


def word_encoder(path: str, spaced: bool) -> WordEncoder:
    """Of a tokenizer file; special tokens' strings in a text are ordinary text.

    Most new words are encoded many in one string by the file's vocabulary: spaced ones with a line feed between them,
    which is a token of its own; bare ones as their letters in lower case and the punctuation after these, each up to
    a word end. Other words go one by one through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merger, fits = _merger(model, spaced), _JOINED_SPACED if spaced else _JOINED_BARE
    end = model.get("end_of_word_suffix") or "\0"
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[merger.encode_ordinary("\n") if spaced else [i for w, i in model["vocab"].items() if w.endswith(end)]] = True

    def joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if spaced:
            line = merger.encode_to_numpy(_line(words), disallowed_special=())
            return line[~ends[line]], np.diff(np.flatnonzero(ends[line]), prepend=-1) - 1
        low = pc.utf8_lower(words)
        two = pc.match_substring_regex(low, f"[{_MARKS}]$").to_numpy(zero_copy_only=False)
        line = merger.encode_to_numpy(_line(pc.replace_substring_regex(low, f"^([^{_MARKS}]+)([{_MARKS}]+)$", "\\1\n\\2")), disallowed_special=())
        return line, np.diff(np.flatnonzero(ends[line])[np.cumsum(1 + two) - 1], prepend=-1)

    def encode_new(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        good = pc.match_substring_regex(words, fits).to_numpy(zero_copy_only=False)
        line, sizes = joined(words.filter(pa.array(good))) if good.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if good.all():
            return [(line, sizes)]
        single = [e.ids for e in t.encode_batch_fast(words.filter(pa.array(~good)).to_pylist(), add_special_tokens=False)]
        both = np.zeros(len(words), np.int64)
        both[good], both[~good] = sizes, [len(x) for x in single]
        whole, of_good = np.zeros(both.sum(), np.uint32), np.repeat(good, both)
        whole[of_good], whole[~of_good] = line, list(chain.from_iterable(single))
        return [(whole, both)]

    return WordEncoder(encode_new, spaced_words if spaced else bare_words, spaced)


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, high bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids[:, None] >> shifts & 1).astype(np.uint8)).tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return rows @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def shard_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int) -> list[bytes]:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return [struct.pack(HEAD, MAGIC, bits, BLOCK, len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), offsets.tobytes(), *blocks]


class Shard:
    """A shard's bytes, with random access."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_docs, self.n_ids = struct.unpack_from(HEAD, self.data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        self.counts = np.frombuffer(self.data, "<u4", self.n_docs, at := at + 8 * self.n_docs).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at := at + 4 * self.n_docs).astype(np.int64)
        self.at = at + 8 * (n_blocks + 1)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``, from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        parts = [unpack(self.data[self.at + self.offsets[k] : self.at + self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block :][:n]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, spaced: bool = False) -> list[tuple[int, int, int]]:
    """Write the shards of a table with doc_id and text; (shard, documents, ids) of each in ascending doc_id order.

    The list has one small row a shard; a shard is a range of doc_ids and so has no more than a partition's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder, task = held_by_worker(("words", tokenizer, spaced), lambda: word_encoder(tokenizer, spaced)), TaskContext.get()
        bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
        doc_ids, counts, ids = [], [], []
        for part, texts in arrow_chunks(batches):
            got, n = encoder.encode(texts)
            ids.append(np.insert(got, np.cumsum(n), end_id).astype(np.uint16 if bits <= 16 else np.uint32))
            counts.append(n + 1)
            doc_ids.append(part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if doc_ids:
            all_ids, all_docs, k = np.concatenate(ids), np.concatenate(doc_ids), task.partitionId()
            commit_file(f"{folder}/shard-{k:06d}.sbtok", task.taskAttemptId(), shard_bytes(all_docs, np.concatenate(counts), all_ids, bits))
            yield pa.RecordBatch.from_pydict({"shard": [k], "documents": [len(all_docs)], "ids": [len(all_ids)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    with small_batches(docs.sparkSession):
        return sorted(tuple(r) for r in rows.mapInArrow(run, "shard long, documents long, ids long").collect())


def read_shards(docs: DataFrame, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards."""
    starts = dict(zip([s[0] for s in shards], np.cumsum([0, *(s[2] for s in shards)]).tolist()))
    spark, schema = docs.sparkSession, "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_buffer())
                base, at, crc = starts[int(re.search(r"shard-(\d+)\.", path)[1])], 0, []
                edges = np.concatenate([[0], np.cumsum(shard.counts)])
                for lo in range(0, shard.n_docs, 4096):
                    hi = min(shard.n_docs, lo + 4096)
                    ids, e = shard.read(int(edges[lo]), int(edges[hi] - edges[lo])).astype("<u4"), edges[lo : hi + 1] - edges[lo]
                    crc += [zlib.crc32(ids[a:b]) for a, b in zip(e[:-1].tolist(), e[1:].tolist())]
                docs_ = pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([docs_, pa.array(base + edges[:-1]), pa.array(shard.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sbtok").load(folder).select("path", "content")
    return files.mapInArrow(run, schema)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, spaced: bool = False) -> DataFrame:
    """Write shards in the shared folder and return what reading them back gives."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_shards(docs, folder, write_shards(docs, folder, tokenizer, end_id, spaced))

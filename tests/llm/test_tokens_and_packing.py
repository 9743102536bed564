import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandbase.llm import packing, tokens

from .conftest import TEXTS


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing_bits_and_back(bits, ids):
    ids = np.array(ids, np.uint64).astype(np.uint32) & np.uint32((1 << bits) - 1)
    assert tokens.unpack(tokens.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()


def test_fewest_bits():
    assert [tokens.bits_for(v) for v in (2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 3 * tokens.BLOCK + 17).astype(np.uint32)
    shard = tokens.Shard(b"".join(tokens.shard_bytes(np.arange(2), np.array([5, len(ids) - 5]), ids, bits)))
    for start, n in ((0, 1), (tokens.BLOCK - 1, 2), (tokens.BLOCK * 3, 17), (100, tokens.BLOCK * 2), (5, 0)):
        assert (shard.read(start, n) == ids[start : start + n]).all()


@cache
def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@cache
def encoder(name, spaced):
    return tokens.word_encoder(P.path(name), spaced)


ODD = ["", " ", "  a", "a  b", "a   b ", "it's we'll ''s", "x\n\ny\n z", "\ta\r\nb", "a\x85b\xa0c", "\x1ca \x1f", "ÀÉ ßẞ İi Σς", "<|endoftext|> <|startoftext|>", "a.b,c!d", "1234 5.6", "é" * 300, "🙂 🙂🙂", "ends ", "ü̈ ", "a　b ", "_x_ #y$", "a \tb", "\t b", "x \r y", "a\x0b c"]


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.sampled_from(ODD), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_the_library(name, spaced, texts):
    ids, n = encoder(name, spaced).encode(pa.array(texts))
    expected = [library(name)(t) for t in texts]
    assert n.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_encoder_forgets_without_harm():
    e = tokens.word_encoder(P.path("byte_bpe_50k.json"), True)
    e.limit = 3
    encode = library("byte_bpe_50k.json")
    for text in ("one two three four", "five six", "one seven eight nine ten"):
        assert e.encode(pa.array([text]))[0].tolist() == encode(text)


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_the_library_on_whole_documents(name, spaced, documents):
    texts = [r.text for r in documents.select("text").collect()]
    e, encode = tokens.word_encoder(P.path(name), spaced), library(name)
    e.limit = 20_000  # words are let go between the batches
    for i in range(0, len(texts), 100):
        ids, n = e.encode(pa.array(texts[i : i + 100]))
        expected = [encode(t) for t in texts[i : i + 100]]
        assert n.tolist() == [len(x) for x in expected] and ids.tolist() == [x for y in expected for x in y]


def test_documents_by_file(spark, awkward):
    rows = {r.doc_id: r for r in tokens.token_ids(awkward, P.path("word_bpe_49k.json")).collect()}
    encode, start = library("word_bpe_49k.json"), 0
    for i, text, *_ in sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0)):
        ids = np.array([*encode(text or ""), 1], "<u4")
        if i != 11:
            assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_kept_encoders_work_in_later_tasks(spark, documents):
    """Many partitions on few workers: what a worker keeps from one task must serve the next."""
    rows = packing.pieces(documents.limit(300).repartition(24), P.path("byte_bpe_50k.json")).groupBy("doc_id").sum("length").collect()
    text, encode = {r.doc_id: r.text for r in documents.limit(300).collect()}, library("byte_bpe_50k.json")
    got = {r[0]: r[1] for r in rows}
    assert all(got[i] == len(encode(text[i])) + 1 for i in got)


def fewest(items, capacity):
    """The fewest bins, by trying all."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_keeps_an_optimum(items):
    items = sorted(items, reverse=True)
    counts = {x: items.count(x) for x in items}
    fixed, rest = packing.reduce_dominated(counts, 20)
    left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + (fewest(left, 20) if left else 0) == fewest(items, 20)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_solution_holds_every_item_once(counts):
    patterns = packing.solve(dict(counts), 64)
    used = {}
    for pattern, n in patterns:
        assert sum(x * c for x, c in pattern) <= 64 and n > 0
        for x, c in pattern:
            used[x] = used.get(x, 0) + c * n
    assert used == counts


def one_by_one(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_best_fit_is_best_fit(counts):
    items = [x for x, n in counts.items() for _ in range(n)]
    assert sum(n for _, n in packing.best_fit(counts, 40)) == one_by_one(items, 40)


def test_sequences_are_gapless(awkward):
    sequences = {}
    for r in packing.pack_documents(awkward, P.path("byte_bpe_50k.json")).collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_small_pairs_are_combined():
    assert packing.solve({1500: 2, 548: 2}, 2048) == [(((1500, 1), (548, 1)), 2)]

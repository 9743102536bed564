import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandbase.llm import bpe

from .conftest import TEXTS

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.DuckBpe(RANKS, P.PATTERN)


def same(ours, library, texts):
    for text, (ids, back) in zip(texts, ours.read(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and back == text.encode()


def test_tricky_texts(ours, library):
    same(ours, library, ["", " ", "a  b ", "rrrr rrrrr", "=" * 300, "a" * 700, "ab" * 400, "abcabc" * 100, "it's we'll'", "\x1c\x85 \t\n", "中文字符测试" * 60, "<|endoftext|>", "0" * 999, "🙂" * 50])


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("abr ", max_size=40) | st.text("ab", min_size=250, max_size=320), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_any_text(ours, library, texts):
    same(ours, library, texts)


def test_rounds_are_taken_up_again(ours, library, monkeypatch):
    monkeypatch.setattr(bpe, "ROUNDS", 2)
    monkeypatch.setattr(bpe, "ROWS", 40)
    words = ["antidisestablishmentarianism" * k for k in (1, 2, 15)] + ["x" * 333]
    ids, sizes = ours.encode_words(words)
    at = np.cumsum(sizes) - sizes
    assert [ids[a : a + n].tolist() for a, n in zip(at, sizes)] == [library.encode_ordinary(w) for w in words]


def test_decoding(ours, library):
    texts = ["some text", "", "ünï"]
    ids = [library.encode_ordinary(t) for t in texts]
    assert ours.decode(np.array(sum(ids, []), np.uint32), np.array([len(i) for i in ids])) == [t.encode() for t in texts]


def test_table(spark, awkward, library):
    text = {i: t or "" for i, t, *_ in TEXTS}
    for r in bpe.encode_decode(awkward, RANKS, P.PATTERN).collect():
        ids = np.array(library.encode_ordinary(text[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_kept_encoders_work_in_later_tasks(spark, documents, library):
    some = documents.limit(120)
    text = {r.doc_id: r.text for r in some.collect()}
    for r in bpe.encode_decode(some.repartition(24), RANKS, P.PATTERN).collect():
        assert r.n_tokens == len(library.encode_ordinary(text[r.doc_id]))

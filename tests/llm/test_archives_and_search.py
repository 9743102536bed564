import gzip
import hashlib
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandbase.llm import mih, warc

RECORDS = [("http://a/", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nwith\n\nlines"), ("http://b/", "0.0.0.0", "2001", "text/plain", b""), ("dns:c", "0.0.0.0", "20010203", "text/dns", b"no head")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    found = list(warc.parse_arc(warc.write_arc(version, RECORDS)))
    assert [(r.fields["URL"], r.fields["Archive-date"], r.block) for r in found] == [(u, d, b) for u, _, d, _, b in RECORDS]
    assert [r.payload for r in found] == [b"body\nwith\n\nlines", b"", b"no head"]
    assert len(found[0].fields) == len(warc.ARC_FIELDS[version].split())


def test_broken_arcs():
    good = warc.write_arc(1, RECORDS)
    with pytest.raises(ValueError):
        list(warc.parse_arc(good[:-20]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(good.replace(b"\n1 0", b"\n7 0")))
    assert list(warc.parse_arc(b"")) == []


def test_dates():
    assert [warc.iso_date(x) for x in ("20010203040506", "200102030405", "2001", "200102")] == ["2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-01-01T00:00:00Z", "2001-02-01T00:00:00Z"]


@given(st.lists(st.binary(max_size=200), max_size=6), st.sampled_from([1, 2]))
@settings(max_examples=60, deadline=None)
def test_records_come_back(blocks, version):
    arcs = list(warc.parse_arc(warc.write_arc(version, [("u", "0.0.0.0", "2001", "x/y", b) for b in blocks])))
    assert [a.block for a in arcs] == blocks
    data = b"".join(warc.warc_record(a, str(i)) for i, a in enumerate(arcs))
    back = list(warc.read_warc(memoryview(data)))
    assert [b for _, b in back] == blocks and [f["X-Row"] for f, _ in back] == [str(i) for i in range(len(blocks))]


def test_revisits_refer_to_the_largest(spark):
    rows = [(i, f"http://x/{i % 3}", ["same" * 10, "same" * 10, "other", "x"][i % 4]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    html = {i: h for i, _, h in rows}
    last = {h: i for i, h in html.items()}
    for r in warc.archive_pages(pages).collect():
        h = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h), warc.base32_sha1(h.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if last[h] == r.page_id else ("revisit", last[h]))
    small = {r.page_id: r.record_type for r in warc.archive_pages(pages, least_bytes=5).collect()}
    assert all(small[i] == "response" for i, h in html.items() if len(h) < 5) and "revisit" in small.values()


def test_record_ids_are_the_same_when_made_again():
    arc = next(warc.parse_arc(warc.write_arc(1, RECORDS)))
    assert warc.warc_record(arc, "1") == warc.warc_record(arc, "1") != warc.warc_record(arc, "2")
    assert warc.base32_sha1(b"abc") == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"
    assert len(hashlib.sha1(b"").hexdigest()) == 40


def test_archive_files_are_converted(spark, tmp_path):
    (tmp_path / "one.arc").write_bytes(warc.write_arc(1, RECORDS))
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(warc.write_arc(2, RECORDS[:2])))
    done = warc.convert_files(spark, f"file://{tmp_path}/*.arc*", f"file://{tmp_path}/out").collect()
    assert sorted(r.records for r in done) == [2, 3]
    found = [list(warc.read_warc(memoryview(f.read_bytes()))) for f in sorted((tmp_path / "out").glob("*.warc.gz"))]
    assert [[b for _, b in x] for x in found] == [[r[4] for r in RECORDS], [r[4] for r in RECORDS[:2]]]
    assert found[0][0][0]["X-ARC-Version"] == "1" and found[1][0][0]["X-ARC-Version"] == "2"


def brute(codes, queries, k):
    d = np.bitwise_count(codes[None, :] ^ queries[:, None]).astype(int)
    out = []
    for row in d:
        last = np.sort(row)[min(k, len(codes)) - 1]
        out.append(sorted((int(x), int(i)) for i, x in enumerate(row) if x <= last))
    return out


@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 400))
@settings(max_examples=40, deadline=None)
def test_block_search_is_exact(seed, k, n):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, 5).astype(np.uint64)
    codes = np.unique(centre[rng.integers(0, 5, n)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for _ in range(n)], np.uint64))
    queries = np.concatenate([codes[:5], rng.integers(0, 2**63, 3).astype(np.uint64)])
    who, what, d, radius = mih.search_block(codes, queries, k)
    got = [sorted((int(x), int(c)) for x, c in zip(d[who == q], what[who == q])) for q in range(len(queries))]
    assert got == brute(codes, queries, k)
    # Each code is found by a segment within the radius, and a smaller radius would not have covered the kth.
    for q in range(len(queries)):
        own = [x for x, _ in got[q]]
        assert mih.SEGMENTS * (radius[q] + 1) > sorted(np.bitwise_count(codes ^ queries[q]))[min(k, len(codes)) - 1] or radius[q] == 16
        assert radius[q] == 0 or mih.SEGMENTS * radius[q] - 1 < max(own)


def test_radii_grow_on_large_blocks():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**63, 60_000).astype(np.uint64) << np.uint64(1))
    queries = codes[:40]
    who, what, d, _ = mih.search_block(codes, queries, 5)
    assert [sorted((int(x), int(c)) for x, c in zip(d[who == q], what[who == q])) for q in range(40)] == brute(codes, queries, 5)


def test_many_blocks_and_a_common_code(spark, monkeypatch):
    monkeypatch.setattr(mih, "BLOCK_CODES", 50)
    monkeypatch.setattr(mih, "QUERIES_A_TASK", 4)
    rng = np.random.default_rng(9)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)] + [12345] * 200
    codes = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, code long")
    out = mih.top_k(codes, codes.filter(F.col("id") % 50 == 0), 7).collect()
    c = np.array(values, np.int64).view(np.uint64)
    for q in range(0, 500, 50):
        d = np.bitwise_count(c ^ c[q]).astype(int)
        expected = [(int(i), int(d[i])) for i in np.lexsort((np.arange(500), d)) if i != q][:7]
        assert [(r.id, r.distance) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == expected


def test_a_search_holds_only_what_may_be_nearest():
    """On random codes a third of the block is looked at for each query; it must not be kept."""
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**63, 100_000).astype(np.uint64) << np.uint64(1))
    tracemalloc.start()
    mih.search_block(codes, codes[:300], 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


@pytest.mark.parametrize("at_once", [500_000, 50])
def test_nearest_rows_break_ties_by_id(monkeypatch, at_once):
    """Codes that nearly all tie, some with several ids, in small parts and whole."""
    monkeypatch.setattr(mih, "AT_ONCE", at_once)
    monkeypatch.setattr(mih, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    codes = rng.permutation(np.array([1 << a | 1 << b for a in range(24) for b in range(a)], np.uint64))
    many = rng.integers(1, 4, len(codes))
    ids = rng.permutation(10 * many.sum())[: many.sum()]
    ends = np.cumsum(many)
    for end, n in zip(ends, many):
        ids[end - n : end].sort()
    row_codes = np.repeat(codes, many)
    asked = np.arange(0, len(ids), 20)
    got = mih.nearest_rows(codes, ids, ends, row_codes[asked], ids[asked], 5)
    for a in asked:
        d = np.bitwise_count(row_codes ^ row_codes[a]).astype(int)
        expected = [(int(ids[i]), int(d[i])) for i in np.lexsort((ids, d)) if i != a][:5]
        mine = got[0] == ids[a]
        assert list(zip(got[1][mine].tolist(), got[2][mine].tolist())) == expected

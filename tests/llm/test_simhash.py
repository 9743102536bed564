from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandbase.llm import simhash


def plain_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "ÀB c d e f", "a b c a b c a b c", "a\x0bb\x1cc d\x85e"])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == plain_fingerprint(text)


def plain_components(fps, linked=lambda a, b: (a ^ b).bit_count() <= 3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in parent}


def crowded(rng, n):
    """Chains and clusters of fingerprints a few bits apart, with some at random."""
    fps = {0, 2**64 - 1}
    for _ in range(n):
        at = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 12))):
            fps.add(at)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                at ^= 1 << b
    return sorted(fps)


@pytest.mark.parametrize("split_above", [50_000, 3])
def test_links_keep_all_components(spark, monkeypatch, split_above):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split_above)
    fps = crowded(np.random.default_rng(5), 120)
    # One leading quarter holds a third of them, so that it is dealt out.
    fps = sorted({*fps, *[(0xABCD << 48) | (f >> 16) for f in fps[::2]]})
    df = spark.createDataFrame([(i, int(np.array([f], np.uint64).view(np.int64)[0])) for i, f in enumerate(fps)], "id long, fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df.selectExpr("fp as node", "fp as f0")).collect()]
    assert len(edges) <= 4 * len(fps) * (1 if split_above > 3 else 42)
    expected = plain_components(fps)
    assert all(expected[a] == expected[b] for a, b in edges)
    roots = {r.node % 2**64: r.root for r in simhash.components(spark.createDataFrame([(np.array([a], np.uint64).view(np.int64)[0].item(), np.array([b], np.uint64).view(np.int64)[0].item()) for a, b in edges], "a long, b long")).collect()}
    groups, wanted = {}, {}
    for f in fps:
        groups.setdefault(roots.get(f, f), set()).add(f)
        wanted.setdefault(expected[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@given(st.integers(0, 2**32))
@settings(max_examples=15, deadline=None)
def test_trie_join_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    keys = np.array(sorted({*crowded(rng, 12), *[int(x) for x in rng.integers(0, 200, 150)]}), np.uint64)
    forest, n = simhash._Forest(len(keys)), np.array([len(keys)])
    zero = np.array([0])
    simhash.trie_join(keys, [zero, n, zero, n, zero], 0, 3, forest)
    expected = plain_components([int(k) for k in keys])
    labels = {}
    for k, x in zip(keys.tolist(), forest.label.tolist()):
        assert labels.setdefault(x, expected[k]) == expected[k]
    assert len(labels) == len(set(expected.values()))


@pytest.mark.parametrize("budget", [3, 7])
def test_turned_tries_find_every_link_from_the_root(spark, budget):
    """On the documents' fingerprints and crowded ones: the joins go down from the root, and no link is lost."""
    rng = np.random.default_rng(budget)
    fps = crowded(rng, 60) + [plain_fingerprint(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    keys, opened, segment = np.array(sorted(set(fps)), np.uint64), 0, 64 // (budget + 1)
    forest, n, zero = simhash._Forest(len(keys)), np.array([len(keys)]), np.array([0])
    for q in range(budget + 1):
        turn = np.uint64(q * segment)
        turned = keys if not q else (keys << turn) | (keys >> (np.uint64(64) - turn))
        order = np.argsort(turned)
        own = simhash._Forest(len(keys))
        opened += simhash.trie_join(turned[order], [zero, n, zero, n, zero], 0, budget, own, None, segment)
        forest.link(order, order[own.label])
    expected = plain_components([int(k) for k in keys], lambda a, b: (a ^ b).bit_count() <= budget)
    labels = {}
    for k, x in zip(keys.tolist(), forest.label.tolist()):
        assert labels.setdefault(x, expected[k]) == expected[k]
    assert len(labels) == len(set(expected.values()))
    assert opened > len(keys) / 2 and simhash.LEAF <= 16


def plain_several(text):
    """Four fingerprints of shingles of five words, by hashes of the hashes."""
    h = np.array(simhash.shingle_hashes(text, 5), np.uint64)
    bits = lambda x: sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > len(x))
    return tuple(bits(simhash._mixed(h, k)) for k in range(4))


def near_by_several(a, b):
    d = [(x ^ y).bit_count() for x, y in zip(a, b)]
    return min(d) <= 7 and sum(d) <= 39


def test_first_of_each_against_brute_force(spark, documents):
    rng = np.random.default_rng(9)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(150).collect()]
    for i, t in rows[:40]:
        w = t.split()
        if len(w) > 60:
            for _ in range(len(w) // 100 + 1):
                w[int(rng.integers(len(w)))] = "changed"
            rows.append((5000 + i, " ".join(w)))
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], "another text under the same id, which nothing else here is like"), (None, rows[2][1]), (None, "a text of its own without an id")]
    got = sorted(((r.doc_id, r.text) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    known = [(i, t) for i, t in rows if i is not None]
    of = plain_components({plain_several(t) for _, t in known}, near_by_several)
    least = {}
    for i, t in known:
        root = of[plain_several(t)]
        least[root] = min(least.get(root, i), i)
    assert sorted(i for i, _ in got if i is not None) == sorted(least.values()) and len(least) < len(known) - 10
    assert sorted(t for i, t in got if i is None) == sorted(t for i, t in rows if i is None)


def test_long_chain(spark):
    rows = [(i, i + 1) for i in range(200)]
    out = simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.root for r in out} == {0} and len({r.node for r in out}) == 201


def test_near_copies_share_a_component(spark, documents):
    rows = documents.select("doc_id", "text").limit(200).collect()
    long = [r for r in rows if len(r.text.split()) > 400][:10]
    copies = [(10_000 + r.doc_id, r.text + " extra") for r in long] + [(20_000 + r.doc_id, r.text.upper()) for r in long]
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + copies, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash_digest(df).collect()}
    text = {**{r.doc_id: r.text for r in rows}, **dict(copies)}
    fps = {i: plain_fingerprint(t) for i, t in text.items()}
    expected = plain_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[expected[f]] = min(least.get(expected[f], i), i)
    assert all(got[i].fingerprint == f"{f:016x}" and got[i].component_id == least[expected[f]] for i, f in fps.items())
    assert all(got[10_000 + r.doc_id].component_id <= r.doc_id for r in long)


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    """However many partitions shuffles have, the tables of each round are as few files as there are cores."""
    from strandbase.llm import common

    paths, fresh, old = [], common.new_path, {}
    monkeypatch.setattr(common, "new_path", lambda *a: paths.append(fresh(*a)) or paths[-1])
    for key, value in (("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        rows = [(i, f"text {i // 3} of {i // 3} in words of its own {i // 3}") for i in range(300)]
        out = simhash.simhash_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert len(out) == 300 and all(r.component_id <= r.doc_id - r.doc_id % 3 for r in out)
    files = [len(list(Path(p.removeprefix("file://")).glob("part-*"))) for p in paths]
    assert len(files) >= 6 and max(files) <= spark.sparkContext.defaultParallelism


def test_more_rows_are_written_in_more_files(spark, monkeypatch):
    from strandbase.llm import common

    monkeypatch.setattr(common, "ROWS_A_FILE", 10)
    table = common.stage(spark.range(0, 150, 1, 60), "many", 150)
    assert table.count() == 150 and len(table.inputFiles()) == 15

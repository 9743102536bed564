import numpy as np
import pyarrow as pa
import pytest

from strandbase.llm import quality, toxicity
from strandbase.llm.common import spread

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spread(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxicity_rows(larger):
    return toxicity.toxicity_scores(*larger).collect()


def rates(rows, labels, held=True):
    pairs = [(labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels and r.held_out == held]
    hit = lambda k: np.mean([p == k for y, p in pairs if y == k])
    return hit(0), hit(1)


def test_quality_on_held_out_documents(larger):
    docs, labels = larger
    rows = quality.quality_scores(docs, labels).collect()
    bad, good = rates(rows, {r.doc_id: r.quality for r in labels.collect()})
    assert len(rows) == 10_000 and bad >= 0.97 and good >= 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_on_held_out_documents(larger, toxicity_rows):
    """Some labels of these tables have nothing in the text that tells; ordinary documents must be left alone."""
    rows = toxicity_rows
    ordinary, toxic = rates(rows, {r.doc_id: r.toxic for r in larger[1].collect()})
    assert len(rows) == 10_000 and ordinary >= 0.99 and toxic >= 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_repeated_stems_tell_on_held_out_documents(larger, toxicity_rows):
    """The stems of other languages are held by ordinary documents too, but once; toxic documents repeat them."""
    docs, labels = larger
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = toxicity_rows
    y = {r.doc_id: r.toxic for r in labels.collect()}
    ordinary, toxic = rates(rows, y)
    other = rates([r for r in rows if langs[r.doc_id] != "en"], y)[1]
    assert ordinary >= 0.99 and toxic >= 0.9 and other >= 0.87


def test_labels_of_held_out_documents_are_not_read(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    import pyspark.sql.functions as F

    for module, column, modulus, held, run in ((quality, "quality", 4, 2, quality.quality_scores), (toxicity, "toxic", 5, 0, toxicity.toxicity_scores)):
        fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held
        turned = labels.withColumn(column, F.when(fold, 1 - F.col(column)).otherwise(F.col(column)))
        a, b = (sorted((r.doc_id, round(r.score, 9)) for r in run(documents, x).collect()) for x in (labels, turned))
        assert a == b


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(2)
    better, worse = rng.normal(1, 1, (500, 3)), rng.normal(0, 1, (500, 3))
    better[:, 2], worse[:, 2] = rng.normal(0, 1, 500), rng.normal(0, 1, 500)
    w = quality.fit_bradley_terry(better, worse)
    assert w[0] > 0.5 and w[1] > 0.5 and abs(w[2]) < 0.3
    loss = lambda v: np.log1p(np.exp(-(better - worse) @ v)).mean()
    assert all(loss(w) <= loss(w + d) + 0.01 for d in 0.3 * np.eye(3))


def test_weights_are_those_of_plain_descent():
    """Newton's method against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(6)
    better, worse = rng.normal(0.7, 1, (40, 4)), rng.normal(0, 1, (50, 4))
    again = np.random.default_rng(7)
    x = better[again.integers(0, 40, 3000)] - worse[again.integers(0, 50, 3000)]
    w = np.zeros(4)
    for _ in range(4000):
        w += 0.2 * ((x / (1 + np.exp(x @ w))[:, None]).mean(axis=0) - 1e-3 * w)
    assert quality.fit_bradley_terry(better, worse, pairs=3000) == pytest.approx(w, abs=1e-3)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_do_not_depend_on_how_the_table_is_dealt_out(spark, documents, module):
    labels, run = spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), quality.quality_scores if module is quality else toxicity.toxicity_scores
    a, b = (sorted((r.doc_id, r.score) for r in run(df, labels).collect()) for df in (documents, documents.repartition(7)))
    assert [x for x, _ in a] == [x for x, _ in b] and np.allclose([x for _, x in a], [x for _, x in b], atol=1e-6)


def test_threshold_is_the_best_cut():
    rng = np.random.default_rng(4)
    s, good = rng.normal(size=60), rng.random(60) < 0.7
    quantile = quality.best_quantile(s, good, np.ones(60))
    cut = quality.at_quantile(s, np.ones(60), quantile)
    right = lambda c: ((s > c) == good).sum()
    assert right(cut) == max(right(c) for c in [*(s + 1e-9), -9]) and quantile == pytest.approx((s <= cut).mean())


def test_grams_by_hand():
    keys, n = toxicity.grams(["ab", "c"])
    assert n.tolist() == [3, 2] and len(keys) == 5
    code = lambda *cs: sum(c << toxicity.BITS * i for i, c in enumerate(reversed(cs)))
    a, b, c = 97, 98, 99
    assert keys[0] == code(1, 1, 1, 1, 1, 1, a) and keys[2] == code(1, 1, 1, 1, a, b, 2) and keys[4] == code(1, 1, 1, 1, 1, c, 2)
    assert keys[1] == code(1, 1, 1, 1, 1, a, b)


def test_probabilities_sum_to_one(spark):
    """Over all characters after a context, with every order's counts from a few words."""
    words = ["aba", "abc", "bca", "aab", "cab", "abb"]
    df = spark.createDataFrame([(i, " ".join(words[: i + 1]), i % 2) for i in range(6)], "doc_id long, text string, label int")
    judge = toxicity.Judge(toxicity.Models(toxicity.count_grams(df)).plain())
    for prefix in ("", "a", "ab", "zz"):
        codes = [1] * toxicity.ORDER + [ord(c) for c in prefix]
        context = 0
        for c in codes[-(toxicity.ORDER - 1) :]:
            context = context << toxicity.BITS | c
        keys = context << toxicity.BITS | np.arange(1 << toxicity.BITS, dtype=np.int64)
        p = np.full(len(keys), 1 / len(keys))
        for order, level in zip(range(1, toxicity.ORDER), judge.shared[::-1]):
            key = keys & ((1 << toxicity.BITS * order) - 1)
            p = toxicity._prob(level, key, key >> toxicity.BITS, p)
            assert p.sum() == pytest.approx(1, abs=1e-4)
        for c in judge.classes:
            assert c.prob(keys, keys >> toxicity.BITS, p).sum() == pytest.approx(1, abs=1e-4)


def test_every_gram_is_counted_by_itself(spark):
    """Letters that agree in their low bits are different letters, and no two grams share a count."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.choice([*range(97, 123), *range(0x4E00, 0x9000), *range(0xAC00, 0xD7A0), *range(0x20000, 0x2A6D0)], 6)))
    words = [word() for _ in range(3000)] + ["\u4e2d\u6587", "\u502d\u6787"]
    assert ord("\u4e2d") & 511 == ord("\u502d") & 511
    df = spark.createDataFrame([(i, " ".join(words[i::4]), i % 2) for i in range(4)], "doc_id long, text string, label int")
    got = {(r.key, r.high): (r.t, r.o) for r in toxicity.count_grams(df).collect()}
    right: dict = {}
    for i in range(4):
        for w in {x for x in toxicity.words_of(" ".join(words[i::4]))}:
            line = "\1" * 6 + w + "\2"
            for k in range(len(w) + 1):
                right.setdefault(line[k : k + 7], [0] * 2)[0 if i % 2 else 1] += 1
    assert sorted(got.values()) == sorted(map(tuple, right.values()))
    table, ids = toxicity.Models(toxicity.count_grams(df)).classes[0].grams, {toxicity._ids(np.array([k]), np.array([h]))[0] for k, h in got}
    assert len(ids) == len(right) and set(table) == {toxicity._ids(np.array([k]), np.array([h]))[0] for (k, h), n in got.items() if n[0]}
    at = toxicity._Table(table).find(np.append(table, [12345]))
    assert at.tolist() == [*range(len(table)), -1]


def test_unknown_spellings_say_nothing(spark):
    df = spark.createDataFrame([(1, "vile rotten vile", 1), (2, "fair kind words", 0), (3, "vile rotten", 1), (4, "fair kind", 0)], "doc_id long, text string, label int")
    judge = toxicity.Judge(toxicity.Models(toxicity.count_grams(df)).plain())
    vile, fair, new = judge(["vile", "fair", "zzqq"])
    assert vile > 0.5 > -0.3 > fair and abs(new) < 0.3


def test_own_counts_are_taken_off(spark):
    """What a document says of itself is what its class says when made without it (lower orders and discounts aside)."""
    texts = [("abab abc", 1), ("abc abd bb", 1), ("bb cab", 0), ("cab abab abc", 0), ("abd", 0)]
    schema = "doc_id long, text string, label int"
    made = lambda rows: toxicity.Judge(toxicity.Models(toxicity.count_grams(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema))).plain())
    judge = made(texts)
    lower = 1e-3
    for left_out, (text, label) in enumerate(texts):
        without, words = made(texts[:left_out] + texts[left_out + 1 :]), text.split()
        keys, n = toxicity.grams(words)
        k, p = 0 if label else 1, np.full(len(keys), lower)
        other = without.classes[k]
        other.discount = judge.classes[k].discount
        got = judge.classes[k].prob(keys, keys >> toxicity.BITS, p, np.zeros(len(keys), np.int64))
        assert got == pytest.approx(other.prob(keys, keys >> toxicity.BITS, p), abs=1e-6)


def test_words_keep_digits_and_single_letters():
    assert toxicity.words_of("An id1ot, a_b & x 42!") == ["an", "id1ot", "a_b", "x", "42"]


def test_few_texts_are_read_at_once_without_their_own_counts():
    """One batch of two million characters is read in short parts, with the evidence of one reading."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(4000)]
    texts, seen = [" ".join(rng.choice(words, 500)) for _ in range(600)], []

    def judge(words, docs=None, toxic=None):
        seen.append(sum(map(len, words)) + len(words))
        return np.array([ord(w[0]) % 7 - 3 for w in words], float)

    batch = pa.RecordBatch.from_pydict({"doc_id": range(600), "text": texts, "label": [i % 2 for i in range(600)]})
    got = pa.Table.from_batches(toxicity.evidence_of_labelled(judge, iter([batch])))
    assert got.num_rows == 600 and max(seen) < toxicity.FIT_CHARS + 4000 and sum(seen) > 1_900_000
    assert np.allclose(np.array(got["x"].to_pylist()), toxicity.read_labelled(judge, texts, np.arange(600) % 2 == 1))


def quality_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.8
    f = rng.normal(0, 1, (n, quality.N_FEATURES)) * np.arange(1, 13) + good[:, None] * np.linspace(0.5, 2, 12)
    return f, good, spark.createDataFrame([(int(g), x.tolist()) for g, x in zip(good, f)], "label int, f array<double>").repartition(5)


def test_weights_are_those_of_all_pairs(spark):
    """Against Newton's method on every pair of a good and a bad row."""
    f, good, rows = quality_rows(spark, 600, 1)
    mean, std, w = quality.fit_all_pairs(rows)
    assert np.allclose(mean, f.mean(axis=0)) and np.allclose(std, f.std(axis=0) + 1e-3)
    z = (f - f.mean(axis=0)) / (f.std(axis=0) + 1e-3)
    x, plain = (z[good][:, None] - z[~good]).reshape(-1, quality.N_FEATURES), np.zeros(quality.N_FEATURES)
    for _ in range(20):
        p = 1 / (1 + np.exp(x @ plain))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-3 * np.eye(len(plain))
        plain -= np.linalg.solve(hessian, -(x * p[:, None]).mean(axis=0) + 1e-3 * plain)
    assert w == pytest.approx(plain, abs=1e-3)


@pytest.mark.parametrize("seed, step", [(2, 0.0), (3, 0.25)])
def test_cut_counts_all_rows(spark, seed, step):
    rng = np.random.default_rng(seed)
    good = rng.random(3000) < 0.7
    s = rng.normal(good * 1.5, 1)
    s = np.round(s / step) * step if step else s  # many equal ones
    at, apart = quality.cut(spark.createDataFrame([(float(x), int(g)) for x, g in zip(s, good)], "s double, good long"))
    quantile = quality.best_quantile(s, good, np.ones(len(s)))
    assert at == pytest.approx(quality.at_quantile(s, np.ones(len(s)), quantile))
    assert apart == pytest.approx(np.median(s[good]) - np.median(s[~good]))


def test_quality_learns_from_every_labelled_row(spark):
    """Of 30,000 labelled rows no part is left out: the statistics of the features are those of all."""
    rows = [(i, "good words here " * (1 + i % 3) if i % 4 else f"!!! ### {i % 7} $$") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality")
    import zlib

    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learnt) > 20_000
    of = {t: quality.text_features(t) for t in set(learnt)}
    ranker = quality.fit(docs, labels)
    assert ranker.mean == pytest.approx(np.mean([of[t] for t in learnt], axis=0), abs=1e-9)


def test_steps_end_when_only_bins_change(spark, monkeypatch):
    seen, plain = [], quality._by_strength
    monkeypatch.setattr(quality, "_by_strength", lambda *a: seen.append(1) or plain(*a))
    quality.fit_all_pairs(quality_rows(spark, 2000, 5)[2])
    assert len(seen) < 20

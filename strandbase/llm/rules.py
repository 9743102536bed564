"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Statistics of each text come from array functions on the row itself. Per language and source a minimum covariance
determinant estimate is made of the transformed statistics: from several starts (deviations from the median; the
covariances of spatial signs and of hyperbolic tangents), concentration steps keep the share of rows with the smallest
distances and take mean and covariance of these, until no determinant falls any more; the least determinant wins.
Texts beyond the estimate by Mahalanobis distance are rejected, at a quantile of the chi-square distribution. Groups
are only ever aggregated, so a group of any size is fine. An estimate of n rows is drawn towards that of all rows
together, as if PRIOR rows of that were among them: one rule for groups of any size.

Defined results: null text has no words; a text that fails the base rules takes no part in estimates; repeated rows count each for itself; a null language or source is a group
of its own; an empty table gives no row; window equality is that of 64-bit hashes within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics, and the least standard deviation of each: a spread below it is no reason to reject.
FEATURES = {
    "f_word": ("ln((word_chars + 1000) / (n_words + 200))", 0.08),
    "f_symbol": ("ln(1 + 100 * n_symbols / (n_words + 200))", 0.4),
    "f_line": ("ln(1 + 100 * n_dup_lines / (n_words + 200))", 0.4),
    "f_repeat": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.08),
}
KEEP = 0.75  # share of rows in a concentration step
STARTS = ("median", "sign", "tanh")
FALLS = 1e-3  # a determinant that falls by less has converged
MOST_STEPS = 30  # never met on any table so far; each step lowers every determinant
PRIOR = 30
CUT = 23.51  # squared distance; the share of a normal sample beyond it is 1e-4 in four dimensions
POOLED = "\x1fall"
D = len(FEATURES)
LOWER = [(i, j) for i in range(D) for j in range(i + 1)]
SALTS = 32


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The five counts of each text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, body.alias("__t"))
    rows = rows.select(*keep, "__t", F.filter(F.split("__t", SPACES, -1), lambda w: w != "").alias("__w"))
    n = F.size("__w")
    third = lambda k: F.slice("__w", k, F.greatest(n - 2, F.lit(0)))
    windows = F.transform(F.arrays_zip(third(1).alias("a"), third(2).alias("b"), third(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("__s"),
    )
    # Equal windows stand side by side once sorted: the places of those that have an equal neighbour.
    size = F.size("__s")
    empty = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    nothing = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))
    before = F.when(size > 0, F.concat(nothing, F.slice("__s", 1, F.greatest(size - 1, F.lit(0))))).otherwise(empty)
    after = F.when(size > 0, F.concat(F.slice("__s", 2, F.greatest(size - 1, F.lit(0))), nothing)).otherwise(empty)
    beside = F.arrays_zip(F.col("__s").alias("x"), before.alias("b"), after.alias("c"))
    twice = F.filter(beside, lambda z: F.coalesce(z["x"]["h"] == z["b"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["c"]["h"], F.lit(False)))
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.array_sort(F.transform(twice, lambda z: z["x"]["i"])).alias("__p"))
    # Words in those windows: each adds the words from the end of the one before it.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    covered = F.aggregate("__p", zero, lambda acc, p: F.struct((p + 3).alias("end"), (acc["words"] + p + 3 - F.greatest(p, acc["end"])).alias("words")))["words"]
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance: forward substitution with the Cholesky factor in columns l_<i>_<j>."""
    y: list[Column] = []
    for i in range(D):
        rest = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{j}") * y[j] for j in range(i)], F.lit(0.0))
        y.append((F.col(names[i]) - F.col(f"m_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _factor(est: DataFrame, floors: list[float]) -> DataFrame:
    """Adds det and the Cholesky factor l_<i>_<j> of the covariances c_<i>_<j> with the floors added to the diagonal."""
    for j in range(D):
        below = reduce(lambda a, b: a + b, [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
        est = est.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") + floors[j] ** 2 - below, F.lit(1e-9))))
        for i in range(j + 1, D):
            mixed = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            est = est.withColumn(f"l_{i}_{j}", (F.col(f"c_{i}_{j}") - mixed) / F.col(f"l_{j}_{j}"))
    return est.withColumn("det", reduce(lambda a, b: a * b, [F.col(f"l_{i}_{i}") * F.col(f"l_{i}_{i}") for i in range(D)]))


def _beside(rows: DataFrame, small: DataFrame, how: str = "inner", by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Rows with what ``small`` (a few rows a group) has for their group; by group and salt, so a group of any size is
    spread over tasks and later groupings by group start from partial results."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(copies, [*by, "__salt"], how).drop("__salt")


def _starts(rows: DataFrame) -> DataFrame:
    """grp, start, m_<i> and c_<i>_<j> of every start."""
    names, floors = list(FEATURES), [x[1] for x in FEATURES.values()]
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"m_{i}") for i, c in enumerate(names)])
    off = _beside(rows, middle).groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"d_{i}") for i, c in enumerate(names)])
    scale = [F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(floors[i])).alias(f"s_{i}") for i in range(D)]
    base = stage(middle.join(off, "grp").select("grp", *[f"m_{i}" for i in range(D)], *scale), "middle")
    z = _beside(rows, base).select("grp", *[((F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, c in enumerate(names)])
    long = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(D)]))
    z = z.withColumn("far", F.greatest(long, F.lit(1e-9)))
    sign = [(D * F.avg(F.col(f"z_{i}") / F.col("far") * F.col(f"z_{j}") / F.col("far"))).alias(f"sign_{i}_{j}") for i, j in LOWER]
    tanh = [F.covar_pop(F.tanh(f"z_{i}"), F.tanh(f"z_{j}")).alias(f"tanh_{i}_{j}") for i, j in LOWER]
    wide = base.join(z.groupBy("grp").agg(*sign, *tanh), "grp")

    def one(kind: str) -> Column:
        of = lambda i, j: F.lit(float(i == j)) if kind == "median" else F.col(f"{kind}_{i}_{j}")
        return F.struct(F.lit(kind).alias("start"), *[(of(i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in LOWER])

    return wide.select("grp", *[f"m_{i}" for i in range(D)], F.explode(F.array(*[one(k) for k in STARTS])).alias("of")).select("grp", *[f"m_{i}" for i in range(D)], "of.*")


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """For each value of ``grp`` the estimate of least determinant over the columns of FEATURES: n (rows it is of), m_<i>,
    c_<i>_<j>, det and its Cholesky factor l_<i>_<j>. doc_id only spreads."""
    names, floors = list(FEATURES), [x[1] for x in FEATURES.values()]
    by, moments = ("grp", "start"), [F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)]
    # 1.86: the covariance of the nearest 75 % of a normal sample in four dimensions is smaller by this
    moments += [(1.86 * F.covar_pop(names[i], names[j])).alias(f"c_{i}_{j}") for i, j in LOWER]
    est, steps = stage(_factor(_starts(rows), floors), "mcd"), []
    for _ in range(MOST_STEPS):
        near = _beside(rows, est).select("doc_id", *by, *names, _distance(names).alias("d2"))
        cut = near.groupBy(*by).agg(F.percentile_approx("d2", KEEP, 10_000).alias("cut"))
        half = _beside(near, cut, by=by).filter(F.col("d2") <= F.col("cut"))
        est = stage(_factor(half.groupBy(*by).agg(*moments, F.count("*").alias("n")), floors), "mcd")
        steps.append(est)
        if len(steps) > 1:
            before = steps[-2].select(*by, F.col("det").alias("before"))
            if not est.join(before, list(by)).filter(F.col("det") < (1 - FALLS) * F.col("before")).limit(1).count():
                break
    everything = reduce(DataFrame.unionByName, [e.withColumn("step", F.lit(k)) for k, e in enumerate(steps)])
    values = ["n", *[f"m_{i}" for i in range(D)], *[f"c_{i}_{j}" for i, j in LOWER], *[f"l_{i}_{j}" for i, j in LOWER]]
    best = everything.groupBy("grp").agg(F.min(F.struct("det", "start", "step", *values)).alias("best"))
    return best.select("grp", "best.det", *[f"best.{v}" for v in values])


def drawn_together(est: DataFrame, pooled: DataFrame) -> DataFrame:
    """Each estimate mixed with the pooled one by the numbers of rows; the factor of the mixture's covariance."""
    p = pooled.select(*[F.col(f"m_{i}").alias(f"pm_{i}") for i in range(D)], *[F.col(f"c_{i}_{j}").alias(f"pc_{i}_{j}") for i, j in LOWER])
    both = est.join(F.broadcast(p), F.lit(True))  # one row
    w = F.col("n") / (F.col("n") + PRIOR)
    apart = [F.col(f"m_{i}") - F.col(f"pm_{i}") for i in range(D)]
    c = [(w * F.col(f"c_{i}_{j}") + (1 - w) * F.col(f"pc_{i}_{j}") + w * (1 - w) * apart[i] * apart[j]).alias(f"c_{i}_{j}") for i, j in LOWER]
    m = [(w * F.col(f"m_{i}") + (1 - w) * F.col(f"pm_{i}")).alias(f"m_{i}") for i in range(D)]
    return _factor(both.select("grp", *m, *c), [x[1] for x in FEATURES.values()]).select("grp", *[f"m_{i}" for i in range(D)], *[f"l_{i}_{j}" for i, j in LOWER])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, distance2 and kept of each document."""
    stats = text_stats(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns({k: F.expr(v[0]) for k, v in FEATURES.items()})
    named = stage(stats.withColumn("grp", F.concat_ws("\x1f", F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00")))), "stats")
    passed = named.filter(~F.col("base_failed")).select("doc_id", "grp", *FEATURES)
    est = stage(mcd_estimates(passed.withColumn("grp", F.explode(F.array(F.col("grp"), F.lit(POOLED))))), "mcd")
    mixed = drawn_together(est.filter(F.col("grp") != POOLED), est.filter(F.col("grp") == POOLED))
    out = _beside(named, mixed, "left").withColumn("distance2", _distance(list(FEATURES)))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUT)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *STATS, "base_failed", kept.alias("kept"), "distance2")

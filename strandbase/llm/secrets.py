"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned by a rule at one version
once: pairs that the ledger has are skipped, new findings are added, and findings go back to all paths that hold
the blob. The text moves only once, to one row a blob; the rows that go back hold addresses, not text.

Defined results: null text is empty; a text without findings has empty spans; equal texts share their findings;
an empty table gives no row; other columns of the input are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class Rule:
    """``pattern``'s matches, leftmost and non-overlapping, whose ``group`` has at least ``least`` code points."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The patterns of the contract, in its order. A run of one character class that is too short has no
# longer match inside it, so there the least length stands in the pattern.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
FINDING = "array<struct<start:int,rule:int,kind:string,end:int>>"
LEDGER = f"blob string, kind string, version int, findings {FINDING}"
#: Copies of each finding in the join back to paths, so that a blob that many paths hold is spread.
SALTS = 32
#: Items of an array that are gone through one after another.
BLOCK = 128


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: what a lambda refers to by its expression is computed for each element."""
    return F.transform(F.array(value), body)[0]


def before_each(items: Column, zero: int, step) -> Column:
    """What ``step`` (a running sum or maximum) has come to before each of ``items`` (a bound array), in time linear in the
    items: blocks first, then the items of each, as appending to one long array would copy it each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def run(of: Column, first: Column, one) -> Column:
        start = F.struct(first.alias("now"), F.expr("cast(array() as array<int>)").alias("seen"))
        return F.aggregate(of, start, lambda acc, x: F.struct(one(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")))["seen"]

    def inside(of: Column) -> Column:
        begin = run(of, F.lit(zero), lambda now, block: F.aggregate(block, now, step))
        return F.flatten(F.transform(F.arrays_zip(of.alias("block"), begin.alias("begin")), lambda z: run(z["block"], z["begin"], step)))

    return bound(blocks, inside)


def find(text: Column, rule: Rule, order: int) -> Column:
    """The rule's findings: matches with the lengths of the pieces between them give the places."""
    nothing = F.expr(f"cast(array() as {FINDING})")
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    # The piece after the last match has none to go with it.
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value")), lambda x: x["size"].isNotNull())

    def hit(z: Column) -> Column:
        begin = z["at"] + z["x"]["gap"]
        return F.struct(begin.alias("start"), F.lit(order).alias("rule"), F.lit(rule.kind).alias("kind"), (begin + z["x"]["size"]).alias("end"))

    def inside(of: Column) -> Column:
        placed = F.arrays_zip(of.alias("x"), before_each(of, 0, lambda at, x: at + x["gap"] + x["size"]).alias("at"))
        return F.transform(F.filter(placed, lambda z: z["x"]["value"] >= rule.least), hit)

    return F.when(text.rlike(rule.pattern), bound(steps, inside).cast(FINDING)).otherwise(nothing)


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """One row a different text: its address and itself."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.select(F.sha2(body, 256).alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs that ``ledger`` lacks; pairs without a finding are rows too."""
    new, seen = blobs(versions, text), None
    if ledger is not None:
        pairs = [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules]
        seen = ledger.groupBy("blob").agg(*[F.max(p).alias(f"seen_{i}") for i, p in enumerate(pairs)])
        new = new.join(seen, "blob", "left")
    out = []
    for i, r in enumerate(rules):
        todo = F.lit(True) if seen is None else ~F.coalesce(f"seen_{i}", F.lit(False))
        out.append(F.when(todo, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find(F.col("body"), r, i).alias("findings"))))
    rows = new.select("blob", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("row"))
    return rows.select("blob", "row.kind", "row.version", "row.findings")


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its findings under the given rule versions, in order; only blobs that have any."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    rows = ledger.filter(current & (F.size("findings") > 0))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))  # at most one row a rule


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", path: str = "doc_id", batches: int = 1) -> tuple[DataFrame, DataFrame]:
    """(every version's ``path`` with its findings, the rows to add to the ledger).

    The versions come in ``batches``, dealt out by path: what an earlier one added is not scanned again by a later one.
    """
    whole, added = ledger, []
    batch_of = F.pmod(F.xxhash64(F.col(path), F.lit("batch")), F.lit(batches))
    for i in range(batches):
        added.append(stage(scan_unseen(versions.filter(batch_of == i) if batches > 1 else versions, whole, rules, text), "ledger"))
        whole = added[-1] if whole is None else whole.select(*added[-1].columns).unionByName(added[-1])
    found = findings_by_blob(whole, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    address = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    paths = versions.select(F.col(path), address.alias("blob")).withColumn("salt", F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int"))
    out = paths.join(found, ["blob", "salt"], "left")
    return out.select(path, "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDING})")).alias("findings")), reduce(DataFrame.unionByName, added)


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, findings: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each stretch of findings (overlapping ones together) replaced by ``mark``."""
    end = F.coalesce(F.array_max(F.transform(findings, lambda x: x["end"])), F.lit(0))

    def inside(letters: Column) -> Column:
        cut = lambda a, n: F.array_join(F.slice(letters, a + 1, F.greatest(n, F.lit(0))), "")
        placed = F.arrays_zip(findings.alias("x"), before_each(findings, 0, lambda at, x: F.greatest(at, x["end"])).alias("at"))
        parts = F.transform(placed, lambda z: F.when(z["x"]["start"] < z["at"], "").otherwise(F.concat(cut(z["at"], z["x"]["start"] - z["at"]), F.lit(mark))))
        return F.concat(F.array_join(parts, ""), bound(end, lambda e: cut(e, F.size(letters) - e)))

    # Code points; a place in a string would be looked for from its start.
    return bound(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), inside)


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets redacted; n_chars, where there is one, counts the new text."""
    added = stage(scan_unseen(docs, ledger, RULES, text), "ledger")
    whole = added if ledger is None else added.unionByName(ledger.select(*added.columns))
    found = findings_by_blob(whole).select(F.col("blob").alias("__blob"), F.col("findings").alias("__found"))
    found = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumn("__blob", F.sha2(body, 256)).withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(found, ["__blob", "__salt"], "left")
    clean = F.when(F.col("__found").isNotNull(), redact(F.col(text), F.col("__found"))).otherwise(F.col(text))
    columns = [F.col(c) for c in docs.columns]
    joined = joined.withColumn("__clean", clean)
    for i, c in enumerate(docs.columns):
        if c == text:
            columns[i] = F.col("__clean").alias(c)
        elif c == "n_chars":
            columns[i] = F.when(F.col("__found").isNotNull(), F.length("__clean").cast(dict(docs.dtypes)[c])).otherwise(F.col(c)).alias(c)
    return joined.select(*columns)


def secret_digest(docs: DataFrame, ledger: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """doc_id, the number of findings by kind, their digest and themselves."""
    rows, _ = scan(docs, ledger, batches=batches)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    spans = span_text(F.col("findings"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "blob")

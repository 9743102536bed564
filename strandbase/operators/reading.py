"""FETCH and its joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQuery
from ..functions.predicates import condition
from ..functions.temporal import valid
from ..language import nodes as n

#: Columns of a collection that no result shows.
HIDDEN = ("_dirty", "_tier", "_cold")


def plain(ref: n.Ref, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    return (F.col(f"`{ref.name}`"), schema[ref.name].dataType) if ref.name in schema.names else None


def resolver(schema: T.StructType):
    """Of fields of one collection; an ordering of ids holds for no row."""
    return lambda ref: plain(ref, schema)


def unordered_ids(tree):
    """The condition with orderings of ``id`` made false: ids are names, not values."""
    if isinstance(tree, n.Not):
        return n.Not(unordered_ids(tree.of))
    if isinstance(tree, n.Both):
        return n.Both(tree.op, unordered_ids(tree.left), unordered_ids(tree.right))
    if tree.ref.name == "id" and tree.op in (">", "<", ">=", "<="):
        return n.Compare(tree.ref, "IN", ())
    return tree


def temporal_filter(df: DataFrame, t: n.Temporal | None) -> DataFrame:
    if t is None:
        return df
    of = lambda name: F.col(name) if name in df.columns else None
    return df.filter(valid(t, of("valid_from"), of("valid_to"), of("tx_time")))


def sort_columns(order: Sequence[n.Order], resolve) -> list[Column]:
    """NULL last when ascending, first when descending; orders by what is not there are left out."""
    found = [(resolve(o.ref), o.descending) for o in order]
    return [c[0].desc_nulls_first() if down else c[0].asc_nulls_last() for c, down in found if c is not None]


def fetch(df: DataFrame, s: n.Fetch, strict: bool = False) -> DataFrame:
    """Filter, validity, sort, limit, projection: id first, fields that are not there as NULL."""
    if s.where is not None:
        df = df.filter(condition(unordered_ids(s.where), resolver(df.schema), strict))
    df = temporal_filter(df, s.temporal)
    keys = sort_columns(s.order, resolver(df.schema))
    if keys:
        df = df.orderBy(*keys, F.col("id").asc())
    if s.limit is not None:
        df = df.limit(s.limit)
    if s.fields is None:
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in HIDDEN])
    names = list(dict.fromkeys(["id", *s.fields]))
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first by ``order``, with partial sums before the shuffle instead of a window."""
    rows = df.filter(F.col(key).isNotNull())
    picked = rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("__row"))
    return picked.select("__row.*")


def strongest_edges(edges: DataFrame, at_least: float) -> DataFrame:
    """src, dst and confidence of each src's strongest edge; of equal ones to the least dst."""
    rows = edges.filter(F.col("confidence") >= at_least)
    best = rows.groupBy("src").agg(F.min(F.struct((-F.col("confidence")).alias("less"), F.col("dst"))).alias("e"))
    return best.select("src", F.col("e.dst").alias("dst"), (-F.col("e.less")).alias("confidence"))


def fetch_join(frames: dict[str, DataFrame], edges_between, s: n.FetchJoin, separator: str = ".", strict: bool = False) -> DataFrame:
    """Joins that look up at most one row of the right side for each left row.

    ``frames``: by collection; ``edges_between``: the edges from one collection to another, for joins by confidence.
    """
    collections = {s.alias: s.collection}
    prefix = lambda df, alias: df.select(*[F.col(f"`{c}`").alias(f"{alias}\x00{c}") for c in df.columns if c not in HIDDEN])
    out = prefix(frames[s.collection], s.alias)
    extra: list[str] = []
    for j in s.joins:
        if j.left.alias not in collections or j.right.alias != j.alias:
            raise InvalidQuery(f"ON {j.left.text} = {j.right.text} joins {j.alias} to an alias before it")
        right = frames[j.collection]
        collections[j.alias] = j.collection
        if j.confidence is not None:
            if j.how not in ("inner", "left"):
                raise InvalidQuery("a join by confidence is INNER or LEFT")
            best = strongest_edges(edges_between(collections[j.left.alias], j.collection), j.confidence)
            found = prefix(right, j.alias).join(best, F.col(f"`{j.alias}\x00id`") == F.col("dst")).drop("dst")
            name = f"_edge{separator}confidence"
            found = found.withColumnRenamed("confidence", name).withColumnRenamed("src", "__src")
            out = out.drop(name).join(found, F.col(f"`{j.left.alias}\x00id`") == F.col("__src"), j.how).drop("__src")
            extra = [name]
            continue
        for alias, ref, df in ((j.left.alias, j.left, frames[collections[j.left.alias]]), (j.alias, j.right, right)):
            if ref.name not in df.columns:
                raise InvalidQuery(f"{alias} has no field {ref.name}")
        on = F.col(f"`{j.left.alias}\x00{j.left.name}`") == F.col(f"`{j.alias}\x00{j.right.name}`")
        if j.right.name == "id" or j.how in ("inner", "left"):
            one = right if j.right.name == "id" else first_by(right, j.right.name, "id")
            out = out.join(prefix(one, j.alias), on, j.how)
        else:
            # Every right row takes part, but only the first of a key can match: the others come out unmatched.
            firsts = right.filter(F.col(f"`{j.right.name}`").isNotNull()).groupBy(F.col(f"`{j.right.name}`").alias("__key")).agg(F.min("id").alias("__first")).drop("__key")
            marked = prefix(right, j.alias).join(firsts, F.col(f"`{j.alias}\x00id`") == F.col("__first"), "left")
            out = out.join(marked, on & F.col("__first").isNotNull(), j.how).drop("__first")

    def resolve(ref: n.Ref):
        name = f"{ref.alias}\x00{ref.name}"
        return (F.col(f"`{name}`"), out.schema[name].dataType) if ref.alias and name in out.columns else None

    if s.where is not None:
        out = out.filter(condition(s.where, resolve, strict))
    keys = sort_columns(s.order, resolve)
    if keys:
        out = out.orderBy(*keys, *[F.col(f"`{a}\x00id`").asc_nulls_last() for a in collections])
    if s.limit is not None:
        out = out.limit(s.limit)
    if s.fields is None:
        names = [c for c in out.columns if "\x00" in c]
    else:
        names = list(dict.fromkeys(f"{r.alias}\x00{r.name}" for r in s.fields))
    shown = [(F.col(f"`{c}`") if c in out.columns else F.lit(None).cast("string")).alias(c.replace("\x00", separator)) for c in names]
    return out.select(*shown, *[F.col(f"`{c}`") for c in extra])

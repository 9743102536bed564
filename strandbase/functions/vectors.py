"""Vector columns: similarity, fusion of ranks, quantisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidQuery

RRF_K = 60


def array_of(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed query; NULL where the vector has no length."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if not length:
        raise InvalidQuery("the query vector is zero")
    unit = array_of([float(x) / length for x in query])
    own = norm(vector)
    return F.when(own > 0, dot(vector, unit) / own)


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best by score, ties by key."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def postings(df: DataFrame, key: str, sparse: str, least: float = 0.001) -> DataFrame:
    """key, dim, weight of a column of array<struct<dim, weight>>; weights near zero are left out."""
    return df.select(key, F.explode(sparse).alias("p")).select(key, F.col("p.dim").alias("dim"), F.col("p.weight").cast("double").alias("weight")).filter(F.abs("weight") >= least)


def sparse_scores(rows: DataFrame, key: str, query: Sequence[tuple[object, float]]) -> DataFrame:
    """key and _score: the dot product over shared dimensions, of rows that share one."""
    weight = F.create_map(*[F.lit(x) for dim, w in query for x in (dim, float(w))])
    shared = rows.filter(F.col("dim").isin([dim for dim, _ in query]))
    return shared.groupBy(key).agg(F.sum(F.col("weight") * weight[F.col("dim")]).alias("_score"))


def sparse_score(vector: Column, query: Sequence[tuple[object, float]], least: float = 0.001) -> Column:
    """The dot product of a row's own postings with a fixed query, without weights near zero; NULL where no dimension is
    shared. No shuffle: all postings of a row lie in it."""
    weight = F.create_map(*[F.lit(x) for dim, w in query for x in (dim, float(w))])
    shared = F.filter(vector, lambda p: p["dim"].isin([dim for dim, _ in query]) & (F.abs(p["weight"]) >= least))
    total = F.aggregate(shared, F.lit(0.0), lambda s, p: s + p["weight"].cast("double") * weight[p["dim"]])
    return F.when(F.size(shared) > 0, total)


def fuse_ranks(lists: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of lists with key and _score that each hold a few best rows."""
    ranked = None
    for one in lists:
        r = one.select(key, (1.0 / (RRF_K + F.row_number().over(Window.orderBy(F.col("_score").desc(), F.col(key))))).alias("_part"))
        ranked = r if ranked is None else ranked.unionByName(r)
    return top(ranked.groupBy(key).agg(F.sum("_part").alias("_score")), "_score", key, k)


def quantise_int8(vector: Column) -> Column:
    """struct<low, high, codes>: 255 steps between the least and greatest element; a constant vector has codes of zero."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    codes = F.transform(vector, lambda x: F.when(high > low, F.round((x.cast("double") - low) / (high - low) * 255)).otherwise(0.0).cast("int"))
    return F.struct(low.alias("low"), high.alias("high"), codes.alias("codes"))


def dequantise_int8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + c / 255.0 * (q["high"] - q["low"]))


def quantise_binary(vector: Column) -> Column:
    """A string of bits, set where an element is not below zero."""
    return F.array_join(F.transform(vector, lambda x: F.when(x >= 0, "1").otherwise("0")), "")

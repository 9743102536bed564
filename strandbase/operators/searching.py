"""SEARCH: exact top-k by dense, sparse, fused or text similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans import lineage
from .reading import HIDDEN

#: Hits that are named in a filter; more are joined.
NAMED = 1000


def is_clean(df: DataFrame, representation: str) -> Column:
    if "_dirty" not in df.columns:
        return F.lit(True)
    return ~F.coalesce(F.array_contains("_dirty", representation), F.lit(False))


def clean_only(df: DataFrame, representation: str) -> DataFrame:
    """Without rows whose representation waits to be computed anew."""
    return df.filter(is_clean(df, representation)) if "_dirty" in df.columns else df


def dense_score(vector: str, query: Sequence[float], metric: str = "COSINE") -> Column:
    return V.cosine_to(F.col(vector), query) if metric == "COSINE" else V.dot(F.col(vector), V.array_of(query))


def dense_scores(df: DataFrame, vector: str, query: Sequence[float], metric: str = "COSINE") -> DataFrame:
    return df.withColumn("_score", dense_score(vector, query, metric)).filter(F.col("_score").isNotNull())


def search_dense(df: DataFrame, vector: str, query: Sequence[float], k: int, at_least: float = 0.0, metric: str = "COSINE") -> DataFrame:
    scored = dense_scores(clean_only(df, vector), vector, query, metric)
    if at_least > 0:
        scored = scored.filter(F.col("_score") >= at_least)
    return V.top(scored, "_score", "id", k)


def sparse_score(vector: str, query: Sequence[tuple[object, float]]) -> Column:
    """NULL where no dimension is shared; of dimensions named twice the last weight counts."""
    return V.sparse_score(F.col(vector), list(dict(query).items()))


def sparse_scores(df: DataFrame, vector: str, query: Sequence[tuple[object, float]]) -> DataFrame:
    """Rows that share a dimension with the query, with _score."""
    return clean_only(df, vector).withColumn("_score", sparse_score(vector, query)).filter(F.col("_score").isNotNull())


def with_rows(hits: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """The rows of at most ``k`` hits, in the hits' order. A few are named in the filter, so that scans and joins of
    ``df`` see only them."""
    if k <= NAMED:
        few = hits.collect()  # at most NAMED
        hits, df = df.sparkSession.createDataFrame(few, hits.schema), df.filter(F.col("id").isin([r["id"] for r in few]))
    rows = df.join(F.broadcast(hits), "id")  # at most k hits
    return rows.orderBy(F.col("_score").desc(), F.col("id").asc())


def search_sparse(df: DataFrame, vector: str, query: Sequence[tuple[object, float]], k: int, at_least: float = 0.0) -> DataFrame:
    hits = sparse_scores(df, vector, query)
    if at_least > 0:
        hits = hits.filter(F.col("_score") >= at_least)
    return V.top(hits, "_score", "id", k)


def search_hybrid(df: DataFrame, dense: str, query: Sequence[float], sparse: str, words: Sequence[tuple[object, float]], k: int, depth: int) -> DataFrame:
    """Fusion by rank of the ``depth`` best of either kind; both scores are taken in one pass over the rows."""
    scores = F.when(is_clean(df, dense), dense_score(dense, query)).alias("_dense"), F.when(is_clean(df, sparse), sparse_score(sparse, words)).alias("_sparse")
    both = lineage.cut(df.select("id", *scores))
    lists = [V.top(both.select("id", F.col(x).alias("_score")).filter(F.col("_score").isNotNull()), "_score", "id", depth) for x in ("_dense", "_sparse")]
    return with_rows(V.fuse_ranks(lists, "id", k), df, k)


def search_two_pass(df: DataFrame, vector: str, query: Sequence[float], k: int, factor: int = 3) -> DataFrame:
    """A shortlist of ``factor`` * k by vectors quantised to 8 bits, scored again exactly."""
    coarse = df.withColumn("_near", V.dequantise_int8(V.quantise_int8(F.col(vector))))
    short = V.top(dense_scores(coarse, "_near", query), "_score", "id", factor * k)
    return search_dense(short.drop("_near", "_score"), vector, query, k)


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in HIDDEN])

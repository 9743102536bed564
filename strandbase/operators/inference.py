"""Proposing edges by similarity, keeping and pruning them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decayed
from ..language import nodes as n
from . import neighbours
from .searching import clean_only, dense_scores

#: Sources that nearest_targets scores at once; the side that goes to every task has at most so many vectors.
BATCH = 1000


def proposals(targets: DataFrame, vector: str, query: Sequence[float], source_id: str, existing: DataFrame, edge_type: str, at_least: float = 0.0) -> DataFrame:
    """from_id, to_id, edge_type, confidence of the targets that source_id has no such edge to."""
    scored = dense_scores(clean_only(targets, vector), vector, query).filter((F.col("id") != source_id) & (F.col("_score") >= at_least))
    known = existing.filter(F.col("src") == source_id).select(F.col("dst").alias("id"))
    rows = scored.join(known, "id", "left_anti")
    return rows.select(F.lit(source_id).alias("from_id"), F.col("id").alias("to_id"), F.lit(edge_type).alias("edge_type"), F.col("_score").alias("confidence"))


def best(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.col("confidence").desc(), F.col("to_id"), F.col("edge_type")).limit(k)


def nearest_targets(sources: Sequence[tuple[str, Sequence[float]]], targets: DataFrame, vector: str, existing: DataFrame, limit: int, at_least: float) -> DataFrame:
    """src, dst, confidence: up to ``limit`` new targets of each source, cosine at least ``at_least``.

    Sources are a bounded batch; targets are scored where they lie, a matrix product a batch of rows, and only each
    task's few best of a source are shuffled.
    """
    if len(sources) > BATCH:
        raise ValueError(f"at most {BATCH} sources at once")
    names = np.array([s[0] for s in sources], object)
    matrix = np.array([s[1] for s in sources], float).reshape(len(sources), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
    spark = targets.sparkSession
    known = existing.select("src", "dst").filter(F.col("src").isin([str(x) for x in names])).groupBy("dst").agg(F.collect_set("src").alias("have"))  # at most BATCH a dst
    rows = clean_only(targets, vector).select(F.col("id").alias("dst"), F.col(vector).alias("v")).filter(F.col("v").isNotNull()).join(known, "dst", "left")
    schema = "src string, dst string, confidence double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.array(batch["v"].tolist(), float)
            size = np.linalg.norm(v, axis=1)
            s = (v @ matrix.T) / np.where(size > 0, size, 1)[:, None]
            ids = batch["dst"].to_numpy(object)
            s[(size == 0)[:, None] | (ids[:, None] == names[None, :])] = -np.inf
            for i, have in enumerate(batch["have"]):
                if have is not None:
                    s[i, np.isin(names, list(have))] = -np.inf
            for j in range(len(names)):
                good = np.flatnonzero((s[:, j] >= at_least) & np.isfinite(s[:, j]))
                top = good[np.lexsort((ids[good].astype(str), -s[good, j]))][:limit]
                if len(top):
                    yield pd.DataFrame({"src": names[j], "dst": ids[top], "confidence": s[top, j]})

    if not len(names):
        return spark.createDataFrame([], schema)
    near = rows.mapInPandas(score, schema)
    order = Window.partitionBy("src").orderBy(F.col("confidence").desc(), F.col("dst"))
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def sweep(sources: DataFrame, targets: DataFrame, vector: str, existing: DataFrame, limit: int, at_least: float) -> DataFrame:
    """nearest_targets of every row of ``sources``, however many: blocks of both sides meet in the tasks."""
    given = clean_only(targets, vector)
    return neighbours.all_pairs(given if sources is targets else clean_only(sources, vector), given, vector, existing, limit, at_least)


def decay_sweep(edges: DataFrame, decay: n.DecayDecl | None, now_ms: int) -> DataFrame:
    """The edges that stay: inferred ones go once their decayed confidence is below the prune threshold."""
    if decay is None or decay.prune is None:
        return edges
    now = decayed(F.col("confidence"), F.col("created_at"), now_ms, decay.function, decay.rate, decay.floor)
    return edges.filter(~F.coalesce((F.col("source") == "Inferred") & (now < decay.prune), F.lit(False)))

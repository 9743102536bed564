"""Breadth-first traversal over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decayed
from ..functions.temporal import valid
from ..language import nodes as n
from ..plans.lineage import cut

MAX_HOPS = 10


def effective(edges: DataFrame, decay: n.DecayDecl | None, now_ms: int) -> DataFrame:
    """confidence as it is now."""
    if decay is None:
        return edges
    return edges.withColumn("confidence", decayed(F.col("confidence"), F.col("created_at"), now_ms, decay.function, decay.rate, decay.floor))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """src, dst, confidence, type in the direction of travel."""
    columns = ["src", "dst", "confidence", "edge_type"]
    along = edges.select(*columns)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "edge_type")
    return {"forward": lambda: along, "backward": lambda: against, "both": lambda: along.unionByName(against)}[direction]()


def reach(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """id, _depth, _edge_confidence, _edge_type of every node within ``hops`` of the ids in ``start``, each once.

    A node's edge is that of its least depth with the most confidence, of equal ones the least type. A hop is one
    join, one grouping and an anti-join with the nodes seen. Where more hops follow, its few new nodes are written
    out, so that no hop is computed twice and the next join knows their size; without new nodes the walk ends.
    """
    hops = min(hops, MAX_HOPS)
    none = F.lit(None)
    seen = start.select("id", F.lit(0).alias("_depth"), none.cast("double").alias("_edge_confidence"), none.cast("string").alias("_edge_type"))
    found, frontier = [], start.select("id")
    for depth in range(1, hops + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).groupBy("dst").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "edge_type")).alias("e"))
        step = step.select(F.col("dst").alias("id"), F.lit(depth).alias("_depth"), (-F.col("e.less")).alias("_edge_confidence"), F.col("e.edge_type").alias("_edge_type"))
        step = step.join(reduce(DataFrame.unionByName, [seen, *found]).select("id"), "id", "left_anti")
        if depth < hops:
            step = cut(step)
        found.append(step)
        frontier = step.select("id")
        if depth < hops and frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else seen.limit(0)


def usable(edges: DataFrame, at_least: float | None = None, temporal: n.Temporal | None = None) -> DataFrame:
    if at_least is not None:
        edges = edges.filter(F.col("confidence") >= at_least)
    if temporal is not None:
        edges = edges.filter(valid(temporal, F.col("valid_from"), F.col("valid_to")))
    return edges


def match_edges(typed: list[tuple[str, DataFrame, n.DecayDecl | None]], s: n.Match, now_ms: int) -> DataFrame:
    rows = [usable(effective(df, decay, now_ms), s.confidence, s.temporal).withColumn("edge_type", F.lit(name)) for name, df, decay in typed]
    columns = ["src", "dst", "confidence", "edge_type"]
    return oriented(reduce(DataFrame.unionByName, [r.select(*columns) for r in rows]), s.direction)

"""Tiers, affinity and eviction as plans over metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ClusterOverloaded, NoCandidates
from ..functions import scalars

TIERS = ("Hot", "Warm", "Archive")
DAY_MS = 86_400_000
#: Rows of sets that one task makes pairs of.
ROWS_A_TASK = 400_000


def tier_counts(tiers: DataFrame, column: str = "_tier") -> DataFrame:
    """tier and n for each of the three, zero where there is none."""
    names = tiers.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    counts = tiers.groupBy(F.initcap(F.coalesce(F.col(column), F.lit("hot"))).alias("tier")).agg(F.count("*").alias("n"))
    return names.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def parts_for(rows: DataFrame) -> int:
    """Tasks that sets of so many rows are dealt to: a few, or as many as ROWS_A_TASK asks for."""
    return max(-(-rows.count() // ROWS_A_TASK), min(rows.sparkSession.sparkContext.defaultParallelism, 16))


def sets_by(rows: DataFrame, key: str, member: str, parts: int) -> DataFrame:
    """part and members: the different members of each key, dealt out to ``parts`` tasks; rows without a key are in no set."""
    dealt = rows.select(key, member).filter(F.col(key).isNotNull()).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartitionById(parts, "part")
    return dealt.groupBy("part", key).agg(F.collect_set(member).alias("members")).select("part", "members")


def cooccurrence(sets: DataFrame, members: str, parts: int | None = None) -> DataFrame:
    """a, b, score of unordered pairs: the sum of 1 / (n - 1) over the sets of n that hold both.

    Sets are what one statement named together, a few ids; the pairs of one set are made from its own row. With
    ``parts``, sets are those of ``sets_by``: pairs are summed in their tasks first and then dealt out to as many tasks
    again, so that no task holds more than its share of the pairs.
    """
    own = ["part"] if parts else []
    s = sets.select(*own, F.array_sort(F.array_distinct(members)).alias("s")).filter(F.size("s") > 1)
    pairs = s.select(*own, (1.0 / (F.size("s") - 1)).alias("w"), F.posexplode("s").alias("i", "a"), "s")
    pairs = pairs.select(*own, "w", "a", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("b"))
    if parts:
        pairs = pairs.groupBy("part", "a", "b").agg(F.sum("w").alias("w")).repartition(parts, "a", "b")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("score"))


def promote_and_decay(scores: DataFrame, factor: float = 0.95, drop_below: float = 0.01, promote_at: float = 0.70) -> DataFrame:
    """Scores after one round, with whether the pair's group is promoted; faded pairs go."""
    now = scores.withColumn("score", F.col("score") * factor).filter(F.col("score") >= drop_below)
    return now.withColumn("promoted", F.col("score") >= promote_at)


def eviction_order(entities: DataFrame) -> DataFrame:
    """Of columns id, membership (ungrouped, implicit, explicit) and last_access: who goes first."""
    rank = F.when(F.col("membership") == "explicit", 2).when(F.col("membership") == "implicit", 1).otherwise(0)
    return entities.withColumn("priority", rank).orderBy("priority", "last_access", "id")


def migration_action(source_has: str, target_has: str):
    """What a migration found half done needs: of two columns of whether source and target hold the row."""
    s, t = F.col(source_has), F.col(target_has)
    return F.when(s & t, "CleanupSource").when(s, "ReExecute").when(t, "AlreadyComplete").otherwise("NoAction")


def tier_cycle(entities: DataFrame, now_ms: int, warm_after: int = DAY_MS, archive_after: int = 7 * DAY_MS, batch: int = 100) -> DataFrame:
    """id, from_tier, to_tier of one round of moves, of columns id, _tier, membership and last_access (ms).

    Hot rows that were idle for longer than ``warm_after`` go to warm, by eviction order, warm ones idle for longer than
    ``archive_after`` to the archive, the longest idle first; ``batch`` of either in a round, the rest in the next ones.
    """
    tier, idle = F.coalesce("_tier", F.lit("hot")), F.lit(now_ms) - F.col("last_access")
    hot = eviction_order(entities.filter((tier == "hot") & (idle > warm_after))).limit(batch)
    warm = entities.filter((tier == "warm") & (idle > archive_after)).orderBy("last_access", "id").limit(batch)
    moves = [rows.select("id", F.lit(a).alias("from_tier"), F.lit(b).alias("to_tier")) for rows, a, b in ((hot, "hot", "warm"), (warm, "warm", "archive"))]
    return moves[0].unionByName(moves[1])


def route(nodes: DataFrame, shed_at: float = 0.85, stale_ms: int = 600) -> DataFrame:
    """node and score of the nodes that may take a statement, the best first, ties by name.

    Of columns node, status, silent_ms, load, verb_fit and locality. Faulted and stale nodes don't count; with none left
    there is no candidate, with only loaded ones the cluster is overloaded. One pass over a row a node.
    """
    alive = nodes.filter((F.col("status") != "faulted") & (F.col("silent_ms") <= stale_ms))
    free = alive.filter(F.col("load") < shed_at)
    if free.isEmpty():
        raise NoCandidates() if alive.isEmpty() else ClusterOverloaded()
    return free.select("node", scalars.routing_score().alias("score")).orderBy(F.col("score").desc(), "node")

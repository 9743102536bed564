"""Decay of confidence, recipe hashes, routing and affinity scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decayed(confidence: Column, created_at: Column, now_ms: int | Column, function: str | None, rate: float | None = None, floor: float | None = None) -> Column:
    """Confidence after the seconds since ``created_at`` (ms); unchanged without a function, a creation time or elapsed time."""
    if function is None:
        return confidence
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    seconds = (now - created_at) / 1000.0
    rate, floor = float(rate or 0.0), float(floor or 0.0)
    if function == "exponential":
        value = confidence * F.exp(-rate * seconds)
    elif function == "linear":
        value = confidence * (1.0 - rate * seconds)
    elif function == "step":
        value = F.when(seconds > rate, F.lit(floor)).otherwise(confidence)
    else:
        raise ValueError(f"no such decay: {function}")
    bounded = F.greatest(F.least(value, F.lit(1.0)), F.lit(floor))
    return F.when((created_at > 0) & (seconds > 0), bounded).otherwise(confidence)


def recipe_hash(model: Column, fields: Column) -> Column:
    """SHA-256 of a representation's recipe: its model and its sorted fields."""
    return F.sha2(F.concat(F.lit("recipe:v1:"), model, F.lit(":"), F.array_join(F.array_sort(fields), ",")), 256)


# The weights of load and routing scores.
LOAD_WEIGHTS = {"ram": 0.35, "queue": 0.30, "cpu": 0.20, "hnsw": 0.10, "lag": 0.05}
ROUTE_WEIGHTS = {"headroom": 0.40, "verb_fit": 0.30, "locality": 0.30}


def weighted(weights: dict[str, float], columns: dict[str, Column] | None = None) -> Column:
    parts = [F.lit(w) * (columns or {}).get(k, F.col(k)) for k, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def load_score() -> Column:
    """Of columns ram, queue, cpu, hnsw, lag, each a share of its capacity."""
    return weighted(LOAD_WEIGHTS)


def routing_score() -> Column:
    """Of columns load, verb_fit and locality."""
    return weighted(ROUTE_WEIGHTS, {"headroom": 1.0 - F.col("load")})


def node_status(load: Column, cpu: Column, ram: Column, queue: Column, p99_ms: Column, silent_ms: Column) -> Column:
    """faulted, overloaded, degraded or healthy."""
    degraded = (cpu >= 0.75) | (ram >= 0.85) | (queue >= 500) | (p99_ms >= 20)
    return F.when(silent_ms > 5000, "faulted").when(load >= 0.85, "overloaded").when(degraded, "degraded").otherwise("healthy")


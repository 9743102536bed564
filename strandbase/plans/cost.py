"""Cost units of statements: a model for EXPLAIN and budgets, not a measure."""

from __future__ import annotations

from dataclasses import dataclass

from ..language import nodes as n


@dataclass(frozen=True)
class UnitCosts:
    # The units of the cost model.
    scan: float = 0.5
    index: float = 2.0
    dense: float = 50.0
    sparse: float = 20.0
    hybrid: float = 75.0
    text: float = 80.0
    prefilter: float = 5.0
    two_pass: float = 15.0
    row: float = 1.0
    hop: float = 3.0
    infer: float = 60.0
    promotion: float = 30.0
    write: float = 5.0


TWO_PASS_FROM = 50
WARN_SCAN, WARN_HOPS, WARN_K, WARN_CONFIDENCE = 100.0, 5, 50, 0.9


def strategy(s: n.Search) -> str:
    if s.text is not None:
        return "text"
    if s.dense is not None and s.sparse is not None:
        return "hybrid"
    return "dense" if s.dense is not None else "sparse"


def parts(statement, rows: int = 0, indexed: bool = False, units: UnitCosts = UnitCosts()) -> list[tuple[str, float]]:
    """What a statement's estimate is made of. ``rows``: of the collection it reads from."""
    if isinstance(statement, n.Fetch):
        return [("index", units.index)] if indexed else [("scan", units.scan * rows)]
    if isinstance(statement, n.FetchJoin):
        return [("scan", units.scan * rows * (1 + len(statement.joins)))]
    if isinstance(statement, n.Search):
        out = [(strategy(statement), getattr(units, strategy(statement)))]
        if statement.where is not None:
            out.append(("prefilter", units.prefilter))
        if statement.limit >= TWO_PASS_FROM:
            out.append(("two_pass", units.two_pass))
        return [*out, ("rows", units.row * statement.limit)]
    if isinstance(statement, n.Traverse):
        return [("hops", units.hop * statement.depth)]
    if isinstance(statement, n.Match):
        return [("hops", units.hop * statement.high)]
    if isinstance(statement, n.Infer):
        return [("infer", units.infer)]
    if isinstance(statement, n.Promote):
        return [("promotion", units.promotion)]
    if isinstance(statement, (n.Checkpoint, n.Restore, n.Explain, n.ExplainTiers, n.ExplainHistory)):
        return []
    return [("write", units.write)]


def warnings(statement, cost: float, indexed: bool = False) -> list[str]:
    out, hints = [], getattr(statement, "hints", ())
    if isinstance(statement, n.Fetch) and not indexed and cost > WARN_SCAN:
        out.append(f"ScalarPreFilter: a full scan of {cost:.0f} units")
    if getattr(statement, "confidence", None) is not None and getattr(statement, "confidence") > WARN_CONFIDENCE:
        out.append(f"ConfidencePushdown: a threshold of {statement.confidence} leaves few rows")
    depth = {n.Traverse: "depth", n.Match: "high"}.get(type(statement))
    if depth and getattr(statement, depth) > WARN_HOPS:
        out.append(f"TraverseHopReorder: {getattr(statement, depth)} hops")
    if "NO_PROMOTE" in hints:
        out.append("OnDemandPromotion: off by hint")
    if isinstance(statement, n.Search) and statement.limit > WARN_K:
        out.append(f"BatchedFetchAfterSearch: {statement.limit} rows")
    return out

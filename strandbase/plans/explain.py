"""EXPLAIN: what a statement would do, as properties and values."""

from __future__ import annotations

from typing import Any

from ..language import nodes as n
from . import cost

STRATEGIES = {"dense": "DenseSearch", "sparse": "SparseSearch", "hybrid": "HybridSearch", "text": "NaturalLanguageSearch"}
ARROWS = {"forward": "->", "backward": "<-", "both": "-"}


def _temporal(t: n.Temporal) -> str:
    if t.kind == "AS_OF":
        return f"AS OF '{t.start}'"
    return f"VALID DURING '{t.start}'..'{t.end}'" if t.kind == "DURING" else f"AS OF TRANSACTION {t.start}"


def _order(order) -> str:
    return ", ".join(f"{o.ref.text} {'DESC' if o.descending else 'ASC'}" for o in order)


def properties(engine, s: Any) -> list[tuple[str, str]]:
    index = engine._index(s)
    rows: list[tuple[str, str]] = [("mode", "Probabilistic" if isinstance(s, (n.Search, n.Infer)) else "Deterministic")]
    if isinstance(s, n.Fetch):
        engine.catalog.collection(s.collection)
        ranged = index and not (isinstance(s.where, n.Compare) and s.where.op == "=")
        kind = f"FieldIndex{'Range' if ranged else 'Lookup'} ({index})" if index else "FullScan"
        rows += [("verb", "FETCH"), ("collection", s.collection), ("strategy", kind), ("tier", "FieldIndex" if index else "Fjall")]
        rows += [("order_by", _order(s.order))] if s.order else []
        rows += [("limit", str(s.limit))] if s.limit is not None else []
        rows += [("hints", ", ".join(s.hints))] if s.hints else []
        rows += [("temporal", _temporal(s.temporal))] if s.temporal else []
    elif isinstance(s, n.Search):
        engine.catalog.collection(s.collection)
        rows += [("verb", "SEARCH"), ("collection", s.collection), ("tier", "Ram"), ("strategy", STRATEGIES[cost.strategy(s)]), ("k", str(s.limit)), ("confidence_threshold", f"{s.confidence:g}")]
        rows += [("pre_filter", f"ScalarPreFilter ({index or 'scan'})")] if s.where is not None else []
        rows += [("two_pass", f"first_pass_k={3 * s.limit}")] if s.limit >= cost.TWO_PASS_FROM else []
        rows += [("hints", ", ".join(s.hints))] if s.hints else []
        if w := s.within:
            rows.append(("within", f"TRAVERSE FROM '{w.start}' -[:{w.edge_type or '*'}]{ARROWS[w.direction]} DEPTH {w.low}..{w.high}"))
    elif isinstance(s, n.FetchJoin):
        joins = ", ".join(f"{j.how.upper()} JOIN {j.collection} AS {j.alias} ON {j.left.text} = {j.right.text}" + (f" CONFIDENCE > {j.confidence:g}" if j.confidence is not None else "") for j in s.joins)
        rows += [("verb", "FETCH JOIN"), ("from_collection", s.collection), ("from_alias", s.alias), ("joins", joins)]
    elif isinstance(s, n.Match):
        rows += [("verb", "TRAVERSE MATCH"), ("from_id", s.start), ("edge_type", s.edge_type or "*"), ("direction", s.direction), ("depth", f"{s.low}..{s.high}")]
        rows += [("confidence_threshold", f"{s.confidence:g}")] if s.confidence is not None else []
        rows += [("temporal", _temporal(s.temporal))] if s.temporal else []
    elif isinstance(s, n.Traverse):
        rows += [("verb", "TRAVERSE"), ("edge_type", s.edge_type), ("from_id", s.start), ("depth", str(s.depth))]
    elif isinstance(s, n.Infer):
        rows += [("verb", "INFER"), ("from_id", s.start)]
    else:
        rows.append(("verb", type(s).__name__))
        rows += [(k, str(getattr(s, k))) for k in ("name", "collection", "edge_type", "id", "path") if hasattr(s, k)]
    known = engine.catalog.collections.get(getattr(s, "collection", ""))
    parts = cost.parts(s, known.rows if known else 0, index is not None)
    total = sum(x for _, x in parts)
    rows += [("estimated_acu", f"{total:.1f}"), ("cost_breakdown", ", ".join(f"{k}={x:.1f}" for k, x in parts))]
    warned = cost.warnings(s, total, index is not None)
    if warned:
        rows += [("rules_applied", ", ".join(w.split(":")[0] for w in warned)), ("warnings", "; ".join(warned))]
    return rows

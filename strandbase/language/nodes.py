"""Statements and their parts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


def plain(x: Any) -> Any:
    """A node as what JSON can hold."""
    if is_dataclass(x):
        return {"node": type(x).__name__, **{f.name: plain(getattr(x, f.name)) for f in fields(x)}}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def node(x: Any) -> Any:
    """The node that ``plain`` was given."""
    if isinstance(x, dict) and "node" in x:
        return globals()[x["node"]](**{k: node(v) for k, v in x.items() if k != "node"})
    return tuple(node(v) for v in x) if isinstance(x, list) else x


@dataclass(frozen=True)
class Ref:
    """A field, with the alias before it where one was written."""

    name: str
    alias: str | None = None

    @property
    def text(self) -> str:
        return f"{self.alias}.{self.name}" if self.alias else self.name


@dataclass(frozen=True)
class Compare:
    ref: Ref
    op: str  # = != > < >= <= IN LIKE ISNULL NOTNULL
    value: Any = None


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Both:
    """AND or OR of two conditions."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Temporal:
    kind: str  # AS_OF, DURING, TRANSACTION
    start: Any
    end: Any = None


@dataclass(frozen=True)
class Order:
    ref: Ref
    descending: bool = False


@dataclass(frozen=True)
class RepresentationDecl:
    name: str
    model: str | None = None
    dimensions: int | None = None
    metric: str = "COSINE"
    sparse: bool = False
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class FieldDecl:
    name: str
    kind: str
    target: str | None = None


@dataclass(frozen=True)
class IndexDecl:
    name: str
    fields: tuple[str, ...]
    where: Any = None


@dataclass(frozen=True)
class CreateCollection:
    name: str
    settings: dict[str, str] = field(default_factory=dict)
    representations: tuple[RepresentationDecl, ...] = ()
    fields: tuple[FieldDecl, ...] = ()
    indexes: tuple[IndexDecl, ...] = ()


@dataclass(frozen=True)
class DecayDecl:
    function: str
    rate: float | None = None
    floor: float | None = None
    prune: float | None = None


@dataclass(frozen=True)
class InferenceDecl:
    auto: bool = False
    confidence: float = 0.5
    limit: int = 10


@dataclass(frozen=True)
class CreateEdge:
    name: str
    source: str
    target: str
    decay: DecayDecl | None = None
    inference: InferenceDecl | None = None


@dataclass(frozen=True)
class CreateAffinityGroup:
    name: str


@dataclass(frozen=True)
class Insert:
    collection: str
    fields: tuple[str, ...]
    values: tuple[Any, ...]
    dense: dict[str, list[float]] = field(default_factory=dict)
    sparse: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    collocate: tuple[str, ...] = ()
    group: str | None = None
    valid_from: Any = None
    valid_to: Any = None
    replace: bool = False


@dataclass(frozen=True)
class InsertEdge:
    edge_type: str
    src: str
    dst: str
    metadata: dict[str, Any] = field(default_factory=dict)
    valid_from: Any = None
    valid_to: Any = None


@dataclass(frozen=True)
class Update:
    id: str
    collection: str
    values: dict[str, Any]


@dataclass(frozen=True)
class Delete:
    id: str
    collection: str


@dataclass(frozen=True)
class DeleteEdge:
    edge_type: str
    src: str
    dst: str


@dataclass(frozen=True)
class Fetch:
    collection: str
    fields: tuple[str, ...] | None = None
    where: Any = None
    temporal: Temporal | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Join:
    how: str  # inner, left, right, full
    collection: str
    alias: str
    left: Ref
    right: Ref
    confidence: float | None = None


@dataclass(frozen=True)
class FetchJoin:
    collection: str
    alias: str
    joins: tuple[Join, ...]
    fields: tuple[Ref, ...] | None = None
    where: Any = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Traverse:
    edge_type: str
    start: str
    depth: int = 1
    limit: int | None = None


@dataclass(frozen=True)
class Match:
    start: str
    edge_type: str | None = None
    direction: str = "forward"  # forward, backward, both
    low: int = 1
    high: int = 1
    confidence: float | None = None
    temporal: Temporal | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Search:
    collection: str
    where: Any = None
    dense: tuple[float, ...] | None = None
    sparse: tuple[tuple[Any, float], ...] | None = None
    text: str | None = None
    using: str | None = None
    confidence: float = 0.0
    within: Match | None = None
    limit: int = 10
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Infer:
    start: str
    via: tuple[str, ...] = ()
    limit: int | None = None  # None: RETURNING ALL
    confidence: float = 0.0


@dataclass(frozen=True)
class Confirm:
    edge_type: str
    src: str
    dst: str
    confidence: float


@dataclass(frozen=True)
class Explain:
    of: Any


@dataclass(frozen=True)
class ExplainTiers:
    collection: str


@dataclass(frozen=True)
class ExplainHistory:
    id: str
    limit: int | None = None


@dataclass(frozen=True)
class Promote:
    id: str
    collection: str


@dataclass(frozen=True)
class Demote:
    id: str
    collection: str
    tier: str


@dataclass(frozen=True)
class AlterCollection:
    collection: str
    op: str  # RENAME_FIELD, DROP_FIELD, SET_MODEL, SET_FIELDS, SET_REPR_MODEL, ADD_REPR
    args: dict[str, Any]


@dataclass(frozen=True)
class AlterEntityDropGroup:
    id: str


@dataclass(frozen=True)
class DropCollection:
    name: str


@dataclass(frozen=True)
class DropEdgeType:
    name: str


@dataclass(frozen=True)
class Checkpoint:
    pass


@dataclass(frozen=True)
class Backup:
    path: str


@dataclass(frozen=True)
class Restore:
    path: str


@dataclass(frozen=True)
class Import:
    collection: str
    path: str

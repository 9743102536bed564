"""Recursive descent over the tokens of one statement.

Keywords are told by their place, in any case, so every word can be a name. AND and OR have equal precedence and
associate to the left; there are no parentheses around conditions.
"""

from __future__ import annotations

from typing import Any

from ..errors import ParseError
from . import nodes as n
from .lexer import Token, tokens

HINTS = ("NO_PROMOTE", "NO_PREFILTER", "FORCE_FULL_SCAN", "MAX_ACU", "TIMEOUT")
KINDS = ("TEXT", "DATETIME", "BOOL", "INT", "FLOAT", "ENTITY_REF")
SETTINGS = ("MODEL", "MODEL_PATH", "DEVICE", "VECTORISER", "ENDPOINT", "AUTH")


def parse(text: str) -> Any:
    """The statement of a text that holds one and its semicolon."""
    p = _Parser(tokens(text))
    out = p.statement()
    p.mark(";")
    if p.now.kind != "end":
        p.fail("one statement")
    return out


class _Parser:
    def __init__(self, found: list[Token]):
        self.found, self.at = found, 0

    # Tokens

    @property
    def now(self) -> Token:
        return self.found[self.at]

    def fail(self, expected: str) -> None:
        raise ParseError(f"expected {expected} at {self.now.at}, got {self.now}")

    def take(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.found[min(self.at + ahead, len(self.found) - 1)]
        return t.kind == "name" and str(t.value).upper() in words

    def is_mark(self, value: str) -> bool:
        return self.now.kind == "mark" and self.now.value == value

    def maybe(self, *words: str) -> bool:
        """The words one after another, if they are next."""
        if all(self.is_word(w, ahead=i) for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def word(self, *words: str) -> None:
        for w in words:
            if not self.maybe(w):
                self.fail(w)

    def maybe_mark(self, value: str) -> bool:
        if self.is_mark(value):
            self.at += 1
            return True
        return False

    def mark(self, value: str) -> None:
        if not self.maybe_mark(value):
            self.fail(repr(value))

    def of_kind(self, kind: str, what: str) -> Any:
        if self.now.kind != kind:
            self.fail(what)
        return self.take().value

    def name(self) -> str:
        return self.of_kind("name", "a name")

    def string(self) -> str:
        return self.of_kind("string", "a string")

    def name_or_string(self) -> str:
        return self.take().value if self.now.kind == "string" else self.name()

    def int(self) -> int:
        return self.of_kind("int", "a whole number")

    def number(self) -> float:
        if self.now.kind not in ("int", "float"):
            self.fail("a number")
        return float(self.take().value)

    def list_of(self, item, open_: str = "(", close: str = ")") -> list:
        self.mark(open_)
        out = [item()]
        while self.maybe_mark(","):
            out.append(item())
        self.mark(close)
        return out

    def literal(self) -> Any:
        if self.now.kind in ("string", "int", "float"):
            return self.take().value
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.maybe(word):
                return value
        self.fail("a literal")

    # Statements

    def statement(self) -> Any:
        for words, rule in (
            (("CREATE", "COLLECTION"), self.create_collection),
            (("CREATE", "EDGE"), self.create_edge),
            (("CREATE", "AFFINITY", "GROUP"), lambda: n.CreateAffinityGroup(self.string())),
            (("INSERT", "OR", "UPDATE", "INTO"), lambda: self.insert(True)),
            (("INSERT", "EDGE"), self.insert_edge),
            (("INSERT", "INTO"), self.insert),
            (("UPDATE",), self.update),
            (("DELETE", "EDGE"), lambda: n.DeleteEdge(self.name_or_string(), *self.ends())),
            (("DELETE",), self.delete),
            (("FETCH",), self.fetch),
            (("SEARCH",), self.search),
            (("TRAVERSE",), self.traverse),
            (("INFER", "EDGES"), self.infer),
            (("CONFIRM", "EDGE"), self.confirm),
            (("EXPLAIN", "TIERS"), lambda: n.ExplainTiers(self.name())),
            (("EXPLAIN", "HISTORY"), lambda: n.ExplainHistory(self.string(), self.int() if self.maybe("LIMIT") else None)),
            (("EXPLAIN",), lambda: n.Explain(self.statement())),
            (("PROMOTE",), lambda: n.Promote(*self.id_from())),
            (("DEMOTE",), self.demote),
            (("ALTER", "COLLECTION"), self.alter),
            (("ALTER", "ENTITY"), self.alter_entity),
            (("DROP", "COLLECTION"), lambda: n.DropCollection(self.name())),
            (("DROP", "EDGE", "TYPE"), lambda: n.DropEdgeType(self.name_or_string())),
            (("CHECKPOINT",), n.Checkpoint),
            (("BACKUP", "TO"), lambda: n.Backup(self.string())),
            (("RESTORE", "FROM"), lambda: n.Restore(self.string())),
            (("IMPORT", "INTO"), self.import_),
        ):
            if self.maybe(*words):
                return rule()
        self.fail("a statement")

    def create_collection(self) -> n.CreateCollection:
        name, settings, reprs, fields, indexes = self.name(), {}, [], [], []
        self.mark("(")
        while not self.maybe_mark(")"):
            if self.maybe("REPRESENTATION"):
                reprs.append(self.representation())
            elif self.maybe("FIELD"):
                fields.append(self.field())
            elif self.maybe("INDEX"):
                index, _ = self.name(), self.word("ON")
                indexes.append(n.IndexDecl(index, tuple(self.list_of(self.name)), self.condition() if self.maybe("WHERE") else None))
            elif self.is_word(*SETTINGS) and self.found[self.at + 1].kind == "string":
                key = str(self.take().value).lower()
                settings[key] = self.string()
            else:
                self.fail("REPRESENTATION, FIELD, INDEX or a setting")
            self.maybe_mark(",")
        return n.CreateCollection(name, settings, tuple(reprs), tuple(fields), tuple(indexes))

    def representation(self) -> n.RepresentationDecl:
        out: dict[str, Any] = {"name": self.name()}
        while True:
            if self.maybe("MODEL"):
                out["model"] = self.string()
            elif self.maybe("DIMENSIONS"):
                out["dimensions"] = self.int()
            elif self.maybe("METRIC"):
                out["metric"] = self.metric()
            elif self.maybe("SPARSE"):
                out["sparse"] = self.bool()
            elif self.maybe("FIELDS"):
                out["fields"] = tuple(self.list_of(self.name))
            else:
                return n.RepresentationDecl(**out)

    def metric(self) -> str:
        if not self.is_word("COSINE", "INNER_PRODUCT"):
            self.fail("COSINE or INNER_PRODUCT")
        return str(self.take().value).upper()

    def bool(self) -> bool:
        if not self.is_word("TRUE", "FALSE"):
            self.fail("true or false")
        return str(self.take().value).upper() == "TRUE"

    def field(self) -> n.FieldDecl:
        name = self.name()
        if not self.is_word(*KINDS):
            self.fail("a field type")
        kind = str(self.take().value).upper()
        return n.FieldDecl(name, kind, self.list_of(self.name)[0] if kind == "ENTITY_REF" else None)

    def create_edge(self) -> n.CreateEdge:
        self.maybe("TYPE")
        name, _, source, _, target = self.name_or_string(), self.word("FROM"), self.name_or_string(), self.word("TO"), self.name_or_string()
        decay = inference = None
        if self.maybe("DECAY"):
            if not self.is_word("EXPONENTIAL", "LINEAR", "STEP"):
                self.fail("EXPONENTIAL, LINEAR or STEP")
            parts: dict[str, Any] = {"function": str(self.take().value).lower()}
            while self.is_word("RATE", "FLOOR", "PRUNE"):
                key = str(self.take().value).lower()
                parts[key] = self.number()
            decay = n.DecayDecl(**parts)
        if self.maybe("INFER", "AUTO"):
            parts = {"auto": True}
            while True:
                if self.maybe("CONFIDENCE"):
                    self.mark(">")
                    parts["confidence"] = self.number()
                elif self.maybe("LIMIT"):
                    parts["limit"] = self.int()
                else:
                    break
            inference = n.InferenceDecl(**parts)
        return n.CreateEdge(name, source, target, decay, inference)

    def validity(self) -> tuple[Any, Any]:
        """VALID FROM t [TO t]."""
        if not self.maybe("VALID", "FROM"):
            return None, None
        start = self.literal()
        return start, self.literal() if self.maybe("TO") else None

    def insert(self, replace: bool = False) -> n.Insert:
        collection, fields = self.name(), self.list_of(self.name)
        self.word("VALUES")
        values, dense, sparse = self.list_of(self.literal), {}, {}
        while self.maybe("REPRESENTATION"):
            name = self.name()
            if self.maybe("VECTOR"):
                dense[name] = self.list_of(self.number, "[", "]")
            else:
                self.word("SPARSE")
                sparse[name] = self.list_of(self.weight, "[", "]")
        collocate, group = (), None
        if self.maybe("COLLOCATE", "WITH"):
            collocate = tuple(self.list_of(self.string))
        elif self.maybe("AFFINITY", "GROUP"):
            group = self.string()
        start, end = self.validity()
        return n.Insert(collection, tuple(fields), tuple(values), dense, sparse, collocate, group, start, end, replace)

    def weight(self) -> tuple[Any, float]:
        """dim:weight or (dim, weight)."""
        if self.maybe_mark("("):
            dim, _, w = self.literal(), self.mark(","), self.number()
            self.mark(")")
            return dim, w
        dim = self.literal()
        self.mark(":")
        return dim, self.number()

    def ends(self) -> tuple[str, str]:
        self.word("FROM")
        src = self.string()
        self.word("TO")
        return src, self.string()

    def pair(self) -> tuple[str, Any]:
        name = self.name()
        self.mark("=")
        return name, self.literal()

    def insert_edge(self) -> n.InsertEdge:
        kind = self.name_or_string()
        src, dst = self.ends()
        metadata = dict(self.list_of(self.pair)) if self.maybe("WITH") else {}
        return n.InsertEdge(kind, src, dst, metadata, *self.validity())

    def update(self) -> n.Update:
        id_, _, collection, _ = self.string(), self.word("IN"), self.name(), self.word("SET")
        values = [self.pair()]
        while self.maybe_mark(","):
            values.append(self.pair())
        if any(v is None for _, v in values):
            raise ParseError("UPDATE can't set NULL")
        return n.Update(id_, collection, dict(values))

    def id_from(self) -> tuple[str, str]:
        id_ = self.string()
        self.word("FROM")
        return id_, self.name()

    def delete(self) -> n.Delete:
        return n.Delete(*self.id_from())

    def hints(self) -> tuple[str, ...]:
        out = []
        while self.now.kind == "hint":
            hint = str(self.take().value)
            if hint.split("(")[0].strip() in HINTS:
                out.append(hint)
        return tuple(out)

    def ref(self) -> n.Ref:
        name = self.name()
        return n.Ref(self.name(), name) if self.maybe_mark(".") else n.Ref(name)

    def fetch(self) -> n.Fetch | n.FetchJoin:
        hints, refs = self.hints(), None
        if not self.maybe_mark("*"):
            refs = [self.ref()]
            while self.maybe_mark(","):
                refs.append(self.ref())
        self.word("FROM")
        collection = self.name()
        if self.maybe("AS") if not self.is_word("OF", ahead=1) else False:
            return self.fetch_join(refs, collection, hints)
        temporal = self.temporal()
        where, order, limit = self.tail()
        return n.Fetch(collection, None if refs is None else tuple(r.name for r in refs), where, temporal, order, limit, hints)

    def tail(self) -> tuple[Any, tuple[n.Order, ...], int | None]:
        where, order = self.condition() if self.maybe("WHERE") else None, []
        if self.maybe("ORDER", "BY"):
            while True:
                ref = self.ref()
                order.append(n.Order(ref, self.maybe("DESC") or (self.maybe("ASC") and False)))
                if not self.maybe_mark(","):
                    break
        return where, tuple(order), self.int() if self.maybe("LIMIT") else None

    def fetch_join(self, refs, collection: str, hints) -> n.FetchJoin:
        alias, joins = self.name(), []
        while self.is_word("INNER", "LEFT", "RIGHT", "FULL", "JOIN"):
            how = "inner" if self.is_word("JOIN") else str(self.take().value).lower()
            self.word("JOIN")
            right, _, name, _ = self.name(), self.word("AS"), self.name(), self.word("ON")
            a, _, b = self.ref(), self.mark("="), self.ref()
            if not a.alias or not b.alias:
                raise ParseError("both sides of ON need an alias")
            at_least = None
            if self.maybe("CONFIDENCE"):
                self.mark(">")
                at_least = self.number()
            joins.append(n.Join(how, right, name, a, b, at_least))
        if not joins:
            self.fail("a join")
        where, order, limit = self.tail()
        return n.FetchJoin(collection, alias, tuple(joins), None if refs is None else tuple(refs), where, order, limit, hints)

    def temporal(self) -> n.Temporal | None:
        if self.maybe("AS", "OF", "TRANSACTION"):
            return n.Temporal("TRANSACTION", self.int())
        if self.maybe("AS", "OF"):
            return n.Temporal("AS_OF", self.literal())
        if self.maybe("VALID", "DURING"):
            start = self.literal()
            self.mark("..")
            return n.Temporal("DURING", start, self.literal())
        return None

    def condition(self) -> Any:
        left = self.leaf()
        while self.is_word("AND", "OR"):
            op = str(self.take().value).upper()
            left = n.Both(op, left, self.leaf())
        return left

    def leaf(self) -> Any:
        if self.maybe("NOT"):
            return n.Not(self.leaf())
        ref = self.ref()
        if self.maybe("IS", "NOT", "NULL"):
            return n.Compare(ref, "NOTNULL")
        if self.maybe("IS", "NULL"):
            return n.Compare(ref, "ISNULL")
        if self.maybe("IN"):
            return n.Compare(ref, "IN", tuple(self.list_of(self.literal)))
        if self.maybe("LIKE"):
            return n.Compare(ref, "LIKE", self.string())
        for op in ("!=", ">=", "<=", "=", ">", "<"):
            if self.maybe_mark(op):
                return n.Compare(ref, op, self.literal())
        self.fail("a comparison")

    def search(self) -> n.Search:
        hints, collection = self.hints(), self.name()
        parts: dict[str, Any] = {"hints": hints, "where": self.condition() if self.maybe("WHERE") else None}
        if not self.is_word("NEAR"):
            self.fail("NEAR")
        while self.maybe("NEAR"):
            if self.maybe("VECTOR"):
                parts["dense"] = tuple(self.list_of(self.number, "[", "]"))
            elif self.maybe("SPARSE"):
                parts["sparse"] = tuple(self.list_of(self.weight, "[", "]"))
            else:
                parts["text"] = self.string()
        if self.maybe("USING"):
            parts["using"] = self.name()
        if self.maybe("CONFIDENCE"):
            self.mark(">")
            parts["confidence"] = self.number()
        if self.maybe("WITHIN"):
            self.mark("(")
            self.word("TRAVERSE", "FROM")
            parts["within"] = self.match()
            self.mark(")")
        if self.maybe("LIMIT"):
            parts["limit"] = self.int()
        return n.Search(collection, **parts)

    def traverse(self) -> n.Traverse | n.Match:
        if self.maybe("FROM"):
            return self.match()
        if self.now.kind == "string":  # TRAVERSE 'id' VIA t
            start, _, kind = self.string(), self.word("VIA"), self.name_or_string()
        else:
            kind, _, start = self.name(), self.word("FROM"), self.string()
        return n.Traverse(kind, start, self.int() if self.maybe("DEPTH") else 1, self.int() if self.maybe("LIMIT") else None)

    def match(self) -> n.Match:
        start = self.string()
        self.word("MATCH")
        self.list_of(self.name)
        backward = self.maybe_mark("<-")
        if not backward:
            self.mark("-")
        self.mark("[")
        kind = None
        if self.now.kind == "name":
            self.name()
        if self.maybe_mark(":"):
            kind = self.name_or_string()
        self.mark("]")
        forward = self.maybe_mark("->")
        if not forward:
            self.mark("-")
        if backward and forward:
            raise ParseError("an edge pattern has one direction")
        self.list_of(self.name)
        self.word("DEPTH")
        low, _, high = self.int(), self.mark(".."), self.int()
        at_least = None
        if self.maybe("CONFIDENCE"):
            self.mark(">")
            at_least = self.number()
        direction = "backward" if backward else "forward" if forward else "both"
        return n.Match(start, kind, direction, low, high, at_least, self.temporal(), self.int() if self.maybe("LIMIT") else None)

    def infer(self) -> n.Infer:
        self.word("FROM")
        start, via = self.string(), []
        if self.maybe("VIA"):
            via.append(self.name_or_string())
            while self.maybe_mark(","):
                via.append(self.name_or_string())
        self.word("RETURNING")
        limit = self.int() if self.maybe("TOP") else self.word("ALL")
        floor = 0.0
        if self.maybe("CONFIDENCE"):
            self.mark(">")
            floor = self.number()
        return n.Infer(start, tuple(via), limit, floor)

    def confirm(self) -> n.Confirm:
        src, dst = self.ends()
        self.word("TYPE")
        kind = self.name_or_string()
        self.word("CONFIDENCE")
        return n.Confirm(kind, src, dst, self.number())

    def demote(self) -> n.Demote:
        id_, collection = self.id_from()
        self.word("TO")
        if not self.is_word("WARM", "ARCHIVE"):
            self.fail("WARM or ARCHIVE")
        return n.Demote(id_, collection, str(self.take().value).lower())

    def models(self) -> dict[str, str]:
        self.word("MODEL")
        model = self.string()
        self.word("MODEL_PATH")
        return {"model": model, "model_path": self.string()}

    def alter(self) -> n.AlterCollection:
        collection = self.name()
        if self.maybe("RENAME", "FIELD"):
            old, _, new = self.name(), self.word("TO"), self.name()
            return n.AlterCollection(collection, "RENAME_FIELD", {"old": old, "new": new})
        if self.maybe("DROP", "FIELD"):
            return n.AlterCollection(collection, "DROP_FIELD", {"name": self.name()})
        if self.maybe("SET"):
            return n.AlterCollection(collection, "SET_MODEL", self.models())
        if self.maybe("ALTER", "REPRESENTATION"):
            name, _ = self.name(), self.word("SET")
            if self.maybe("FIELDS"):
                return n.AlterCollection(collection, "SET_FIELDS", {"name": name, "fields": tuple(self.list_of(self.name))})
            return n.AlterCollection(collection, "SET_REPR_MODEL", {"name": name, **self.models()})
        self.word("ADD", "REPRESENTATION")
        decl = self.representation_with_metric()
        return n.AlterCollection(collection, "ADD_REPR", {"decl": decl})

    def representation_with_metric(self) -> n.RepresentationDecl:
        at = self.at
        decl = self.representation()
        if not any(t.kind == "name" and str(t.value).upper() == "METRIC" for t in self.found[at : self.at]):
            self.fail("METRIC")
        return decl

    def alter_entity(self) -> n.AlterEntityDropGroup:
        id_ = self.string()
        self.word("DROP", "AFFINITY", "GROUP")
        return n.AlterEntityDropGroup(id_)

    def import_(self) -> n.Import:
        collection = self.name()
        self.word("FROM")
        return n.Import(collection, self.string())

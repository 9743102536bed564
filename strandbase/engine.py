"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import Counter, deque
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E
from .catalog import DENSE, EDGE, SPARSE, SYSTEM, TYPES, Catalog, Collection, EdgeType, Table
from .functions.predicates import condition
from .functions.temporal import millis
from .functions.vectorisers import HashVectoriser, Vectoriser
from .language import nodes as n
from .language import parse
from .operators import graph, inference, placement, reading, searching
from .plans import cost
from .sources import changelog
from .sources.changelog import ChangeLog
from .sources.jsonl import read_jsonl, sidecar_text, write_jsonl

DETERMINISTIC, PROBABILISTIC = "Deterministic", "Probabilistic"


@dataclass
class Result:
    """Rows as a DataFrame; for statements that write, one row of what was done."""

    frame: DataFrame
    mode: str = DETERMINISTIC
    estimate: float = 0.0
    warnings: list[str] = field(default_factory=list)

    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.frame.collect()]


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None, clock=None, strict_types: bool = False, infer_all_is_ten: bool = True, inner_product: bool = False, separator: str = "."):
        self.spark, self.folder, self.strict, self.separator = spark, folder, strict_types, separator
        self.infer_all_is_ten, self.inner_product = infer_all_is_ten, inner_product
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.catalog = Catalog()
        self.log = ChangeLog(spark, f"{folder}/log" if folder else None)
        self.vectorisers: dict[tuple[str, str], Vectoriser] = {}
        self.audit: deque[dict[str, Any]] = deque(maxlen=1000)
        self.groups: dict[str, set[str]] = {}
        self.group_of: dict[str, str] = {}
        self.together: list[list[str]] = []
        self.slow: deque[tuple[str, float]] = deque(maxlen=1000)
        self.hooks: list = []
        self.metrics: Counter[str] = Counter()
        self.queue: dict[tuple[str, str], None] = {}

    # Tables from DataFrames

    def register(self, name: str, df: DataFrame, id: str = "id", representations: tuple[n.RepresentationDecl, ...] = (), indexes: tuple[n.IndexDecl, ...] = (), rows: int = 0) -> Collection:
        """A collection over a DataFrame, which is read where it lies; ``id`` becomes the string key."""
        if name in self.catalog.collections:
            raise E.CollectionExists(name)
        key = F.col(f"`{id}`").cast("string").alias("id")
        df = df.select(key, *[F.col(f"`{c}`") for c in df.columns if c != "id" and not (c == id)], *([F.col(f"`{id}`")] if id != "id" else []))
        c = Collection(name, Table(self.spark, df.schema, base=df), {r.name: r for r in representations}, {}, {i.name: i for i in indexes}, {}, rows)
        self.catalog.collections[name] = c
        return c

    def register_edges(self, name: str, source: str, target: str, df: DataFrame, decay: n.DecayDecl | None = None, inference: n.InferenceDecl | None = None) -> EdgeType:
        """An edge type over a DataFrame with src and dst; other edge columns get their defaults."""
        if name in self.catalog.edges:
            raise E.EdgeTypeExists(name)
        defaults = {"confidence": F.lit(1.0), "source": F.lit("Structural"), "created_at": F.lit(0)}
        columns = [(F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in EDGE]
        e = EdgeType(name, source, target, Table(self.spark, EDGE, ("src", "dst"), df.select(*columns)), decay, inference or n.InferenceDecl())
        self.catalog.edges[name] = e
        return e

    def vectoriser(self, collection: str, representation: str) -> Vectoriser:
        found = self.vectorisers.get((collection, representation))
        if found is None:
            raise E.InvalidQuery(f"no vectoriser for {collection}.{representation}")
        return found

    # Statements

    def execute(self, text: str) -> Result:
        try:
            return self.run(parse(text))
        except E.EngineError:
            self.metrics["errors"] += 1
            raise

    def run(self, s: Any) -> Result:
        rows = self.catalog.collections[s.collection].rows if getattr(s, "collection", None) in self.catalog.collections else 0
        estimate = sum(x for _, x in cost.parts(s, rows, self._index(s) is not None))
        for hint in getattr(s, "hints", ()):
            m = re.fullmatch(r"MAX_ACU\s*\(\s*([\d.]+)\s*\)", hint)
            if m and estimate > float(m[1]):
                raise E.BudgetExceeded(estimate, float(m[1]))
        self.metrics["statements"] += 1
        self.metrics[type(s).__name__] += 1
        frame = getattr(self, "_" + re.sub(r"(?<!^)(?=[A-Z])", "_", type(s).__name__).lower())(s)
        if estimate >= 100:
            self.slow.append((type(s).__name__, estimate))
        mode = PROBABILISTIC if isinstance(s, (n.Search, n.Infer)) else DETERMINISTIC
        return Result(frame, mode, estimate, cost.warnings(s, estimate, self._index(s) is not None))

    def _index(self, s: Any) -> str | None:
        """The index that a FETCH or SEARCH leads with."""
        where = getattr(s, "where", None)
        if where is None or not isinstance(s, (n.Fetch, n.Search)) or "FORCE_FULL_SCAN" in s.hints or s.collection not in self.catalog.collections:
            return None
        if isinstance(where, n.Compare) and where.op not in ("=", ">", "<", ">=", "<=") or isinstance(where, n.Both) and where.op != "AND" or isinstance(where, n.Not):
            return None
        from .functions.predicates import leading_field

        return self.catalog.collection(s.collection).index_of(leading_field(where))

    def _said(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], T.StructType([T.StructField(k, T.LongType() if isinstance(v, int) and not isinstance(v, bool) else T.StringType()) for k, v in values.items()]))

    def _done(self, what: str) -> DataFrame:
        return self._said(result=what)

    # Reads

    def _fetch(self, s: n.Fetch) -> DataFrame:
        return reading.fetch(self.catalog.collection(s.collection).frame, s, self.strict)

    def _fetch_join(self, s: n.FetchJoin) -> DataFrame:
        names = {s.collection, *(j.collection for j in s.joins)}
        frames = {x: self.catalog.collection(x).frame for x in names}

        def between(a: str, b: str) -> DataFrame:
            found = [e.frame.select("src", "dst", "confidence") for e in self.catalog.edges.values() if (e.source, e.target) == (a, b)]
            return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], "src string, dst string, confidence double")

        return reading.fetch_join(frames, between, s, self.separator, self.strict)

    def _search(self, s: n.Search) -> DataFrame:
        c = self.catalog.collection(s.collection)
        df = c.frame
        if s.where is not None:
            df = df.filter(condition(reading.unordered_ids(s.where), reading.resolver(df.schema), self.strict))
        if s.within is not None:
            df = df.join(self._reached(s.within).select("id"), "id", "left_semi")
        kind, depth = cost.strategy(s), s.limit * (4 if s.where is not None or s.within is not None else 1)
        if kind == "text":
            decl = c.representation(False, s.using) if s.using or any(not r.sparse for r in c.representations.values()) else c.representation(True)
            query = self.vectoriser(c.name, decl.name).encode_query(s.text)
            if decl.sparse:
                found = searching.search_sparse(df, decl.name, query, s.limit, s.confidence)
            else:
                found = searching.search_dense(df, decl.name, query, s.limit, s.confidence)
        elif kind == "dense":
            decl = c.representation(False, s.using)
            self._fits(decl, s.dense)
            found = searching.search_dense(df, decl.name, s.dense, s.limit, s.confidence, decl.metric if self.inner_product else "COSINE")
        elif kind == "sparse":
            found = searching.search_sparse(df, c.representation(True, s.using).name, s.sparse, s.limit)
        else:
            dense, sparse = c.representation(False), c.representation(True)
            self._fits(dense, s.dense)
            found = searching.search_hybrid(df, dense.name, s.dense, sparse.name, s.sparse, s.limit, depth)
        return searching.shown(found)

    def _fits(self, decl: n.RepresentationDecl, vector) -> None:
        if decl.dimensions is not None and len(vector) != decl.dimensions:
            raise E.DimensionMismatch(f"{decl.name} has {decl.dimensions} dimensions, the vector {len(vector)}")

    def _start(self, id_: str) -> DataFrame:
        return self.spark.createDataFrame([(id_,)], "id string")

    def _traverse(self, s: n.Traverse) -> DataFrame:
        e = self.catalog.edge(s.edge_type)
        edges = graph.effective(e.frame, e.decay, self.clock())
        if e.decay is not None and e.decay.prune is not None:
            edges = edges.filter(F.col("confidence") >= e.decay.prune)
        edges = edges.withColumn("edge_type", F.lit(e.name))
        found = graph.reach(self._start(s.start), graph.oriented(edges, "forward"), s.depth)
        rows = self.catalog.collection(e.target).frame.join(found.select("id", "_depth"), "id")
        rows = rows.orderBy("_depth", "id")
        return searching.shown((rows.limit(s.limit) if s.limit is not None else rows).drop("_depth"))

    def _reached(self, s: n.Match) -> DataFrame:
        types = [self.catalog.edge(s.edge_type)] if s.edge_type else list(self.catalog.edges.values())
        if not types:
            return self.spark.createDataFrame([], "id string, _depth int, _edge_confidence double, _edge_type string")
        edges = graph.match_edges([(e.name, e.frame, e.decay) for e in types], s, self.clock())
        return graph.reach(self._start(s.start), edges, s.high).filter(F.col("_depth") >= s.low)

    def _match(self, s: n.Match) -> DataFrame:
        types = [self.catalog.edge(s.edge_type)] if s.edge_type else list(self.catalog.edges.values())
        ends = {"forward": lambda e: [e.target], "backward": lambda e: [e.source], "both": lambda e: [e.source, e.target]}[s.direction]
        names = list(dict.fromkeys(x for e in types for x in ends(e)))
        found = self._reached(s)
        if not s.edge_type:
            found = found.drop("_edge_type")
        if not names:
            return found
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [searching.shown(self.catalog.collection(x).frame).join(found, "id") for x in names])
        rows = rows.orderBy("_depth", "id")
        return rows.limit(s.limit) if s.limit is not None else rows

    def _infer(self, s: n.Infer) -> DataFrame:
        home = next((c for c in self.catalog.collections.values() if c.table.get(s.start)), None)
        if home is None:
            raise E.EntityNotFound(s.start)
        for t in s.via:
            if self.catalog.edge(t).source != home.name:
                raise E.InvalidQuery(f"{t} does not start at {home.name}")
        types = [self.catalog.edge(t) for t in s.via] or self.catalog.edges_from(home.name)
        vector = home.table.get(s.start).get(home.representation(False).name)
        if vector is None:
            raise E.InvalidQuery(f"{s.start} has no dense vector")
        lists = []
        for e in types:
            target = self.catalog.collection(e.target)
            lists.append(inference.proposals(target.frame, target.representation(False).name, vector, s.start, e.frame, e.name, s.confidence))
        if not lists:
            raise E.InvalidQuery(f"no edge type starts at {home.name}")
        rows = reduce(DataFrame.unionByName, lists)
        limit = s.limit if s.limit is not None else 10 if self.infer_all_is_ten else None
        rows = inference.best(rows, limit) if limit is not None else rows.orderBy(F.col("confidence").desc(), "to_id", "edge_type")
        self.audit.append({"id": s.start, "edge_type": "all", "trigger": "Explicit", "at": self.clock(), "limit": limit})
        return rows

    # Definitions

    def _create_collection(self, s: n.CreateCollection) -> DataFrame:
        if s.name in self.catalog.collections:
            raise E.CollectionExists(s.name)
        for what, found in (("representation", s.representations), ("field", s.fields), ("index", s.indexes)):
            names = [x.name for x in found]
            if len(set(names)) < len(names):
                raise E.DuplicateName(f"{what} {max(names, key=names.count)}")
        schema = T.StructType([T.StructField("id", T.StringType())])
        for f in s.fields:
            schema = schema.add(f.name, TYPES[f.kind]) if f.name != "id" else schema
        for r in s.representations:
            schema = schema.add(r.name, SPARSE if r.sparse else DENSE)
        for name, kind in SYSTEM.items():
            schema = schema.add(name, kind)
        c = self._define(s.name, schema, s.representations, s.fields, s.indexes, s.settings)
        self.log.commit([("SchemaCreateColl", c.name, c.name, {"definition": c.definition()})], self.clock())
        self._tell("created", s.name)
        return self._done(f"collection {s.name} created")

    def _define(self, name: str, schema: T.StructType, representations, fields, indexes, settings: dict[str, str]) -> Collection:
        table = Table(self.spark, schema, folder=f"{self.folder}/data/{name}" if self.folder else None)
        c = Collection(name, table, {r.name: r for r in representations}, {f.name: f for f in fields}, {i.name: i for i in indexes}, dict(settings))
        self.catalog.collections[name] = c
        for r in representations:
            if r.fields and settings.get("vectoriser", "hash") == "hash" and not r.sparse:
                self.vectorisers.setdefault((name, r.name), HashVectoriser(r.dimensions or 8))
        return c

    def _define_edge(self, name: str, source: str, target: str, decay: n.DecayDecl | None, inference: n.InferenceDecl | None) -> EdgeType:
        table = Table(self.spark, EDGE, ("src", "dst"), folder=f"{self.folder}/edges/{name}" if self.folder else None)
        self.catalog.edges[name] = EdgeType(name, source, target, table, decay, inference or n.InferenceDecl())
        return self.catalog.edges[name]

    def _altered(self, c: Collection, op: str, **args) -> tuple[str, str, str, Any]:
        """The log's record of a collection's definition as it is now."""
        return ("SchemaAlter", c.name, c.name, {"op": op, **args, "definition": c.definition()})

    def _fitted(self, c: Collection, row: dict[str, Any]) -> list[tuple[str, str, str, Any]]:
        """Columns for what a row brings; a record where that changed the table."""
        before = c.table.schema
        for name, value in row.items():
            if not name.startswith("_"):
                c.table._fit(name, value)
        return [self._altered(c, "ADD_FIELD")] if c.table.schema != before else []

    def _tell(self, what: str, name: str) -> None:
        for hook in self.hooks:
            hook(what, name)

    def _create_edge(self, s: n.CreateEdge) -> DataFrame:
        if s.name in self.catalog.edges:
            raise E.EdgeTypeExists(s.name)
        for c in (s.source, s.target):
            self.catalog.collection(c)
        e = self._define_edge(s.name, s.source, s.target, s.decay, s.inference)
        self.log.commit([("SchemaCreateEdgeType", e.name, e.name, {"definition": e.definition()})], self.clock())
        return self._done(f"edge type {s.name} created")

    def _create_affinity_group(self, s: n.CreateAffinityGroup) -> DataFrame:
        self.groups.setdefault(s.name, set())
        return self._done(f"affinity group {s.name} created")

    def _alter_entity_drop_group(self, s: n.AlterEntityDropGroup) -> DataFrame:
        group = self.group_of.pop(s.id, None)
        if group is not None:
            self.groups[group].discard(s.id)
        return self._done(f"{s.id} left {group}")

    def _drop_collection(self, s: n.DropCollection) -> DataFrame:
        self.catalog.collection(s.name)
        del self.catalog.collections[s.name]
        self.log.commit([("SchemaDropColl", s.name, s.name, None)], self.clock())
        self._tell("dropped", s.name)
        return self._done(f"collection {s.name} dropped")

    def _drop_edge_type(self, s: n.DropEdgeType) -> DataFrame:
        self.catalog.edge(s.name)
        del self.catalog.edges[s.name]
        self.log.commit([("SchemaDropEdgeType", s.name, s.name, None)], self.clock())
        return self._done(f"edge type {s.name} dropped")

    def _alter_collection(self, s: n.AlterCollection) -> DataFrame:
        c, a = self.catalog.collection(s.collection), s.args
        if s.op == "RENAME_FIELD":
            if a["old"] not in c.table.schema.names:
                raise E.InvalidQuery(f"{c.name} has no field {a['old']}")
            if a["new"] in c.table.schema.names:
                raise E.DuplicateName(f"field {a['new']}")
            c.table.replace(c.frame.withColumnRenamed(a["old"], a["new"]))
            if a["old"] in c.fields:
                c.fields[a["new"]] = replace(c.fields.pop(a["old"]), name=a["new"])
        elif s.op == "DROP_FIELD":
            c.table.replace(c.frame.drop(a["name"]))
            c.fields.pop(a["name"], None)
        elif s.op == "SET_MODEL":
            c.settings.update(model=a["model"], model_path=a["model_path"])
        elif s.op == "ADD_REPR":
            d = a["decl"]
            if d.name in c.representations:
                raise E.DuplicateName(f"representation {d.name}")
            c.representations[d.name] = d
            c.table.add(d.name, SPARSE if d.sparse else DENSE)
            if d.fields:
                self.vectorisers.setdefault((c.name, d.name), HashVectoriser(d.dimensions or 8))
                self._soil(c, d.name)
        else:
            if a["name"] not in c.representations:
                raise E.InvalidQuery(f"{c.name} has no representation {a['name']}")
            d = c.representations[a["name"]]
            if s.op == "SET_FIELDS":
                c.representations[d.name] = replace(d, fields=a["fields"])
                self._soil(c, d.name)
            else:
                c.representations[d.name] = replace(d, model=a["model"])
        self.log.commit([self._altered(c, s.op, **{k: v for k, v in a.items() if isinstance(v, str)})], self.clock())
        self._tell("altered", c.name)
        return self._done(f"collection {c.name} altered")

    def _soil(self, c: Collection, representation: str) -> None:
        """Mark a representation of every row as due to be computed anew."""
        df = c.frame
        if "_dirty" not in df.columns:
            df = df.withColumn("_dirty", F.lit(None).cast("array<string>"))
        c.table.replace(df.withColumn("_dirty", F.array_union(F.coalesce("_dirty", F.array().cast("array<string>")), F.array(F.lit(representation)))))

    # Writes

    def _insert(self, s: n.Insert) -> DataFrame:
        c = self.catalog.collection(s.collection)
        row: dict[str, Any] = dict(zip(s.fields, s.values))
        if not isinstance(row.get("id"), str):
            row["id"] = str(uuid.uuid4())
        for name, vector in [*s.dense.items(), *s.sparse.items()]:
            if name not in c.representations:
                raise E.InvalidQuery(f"{c.name} has no representation {name}")
            if name in s.dense:
                self._fits(c.representations[name], vector)
                row[name] = [float(x) for x in vector]
            else:
                row[name] = [{"dim": int(d), "weight": float(w)} for d, w in vector]
        for r in c.representations.values():
            if r.fields and r.name not in row:
                given = {f: "NULL" if row[f] is None else str(row[f]) for f in r.fields if f in row}
                if given:
                    row[r.name] = self.vectoriser(c.name, r.name).encode(given)
        if not s.replace:
            row["valid_from"] = None if s.valid_from is None else millis(s.valid_from)
            row["valid_to"] = None if s.valid_to is None else millis(s.valid_to)
        tx = self.log.commit([*self._fitted(c, row), ("EntityWrite", c.name, row["id"], row)], self.clock())
        row["tx_time"], row["_tier"], row["_dirty"] = tx, "hot", []
        for name in ("valid_from", "valid_to", "tx_time"):
            if name not in c.table.schema.names:
                c.table.add(name, T.LongType())
        known = {k: v for k, v in row.items() if k in c.table.schema.names or not k.startswith("_")}
        c.table.put(known)
        c.rows += 1
        if s.collocate:
            self.together.append([row["id"], *s.collocate])
        if s.group is not None:
            if len(self.groups.setdefault(s.group, set())) >= 500:
                raise E.InvalidQuery(f"affinity group {s.group} is full")
            self.groups[s.group].add(row["id"])
            self.group_of[row["id"]] = s.group
        self._enqueue(c.name, row["id"])
        return self._said(id=row["id"])

    def _enqueue(self, collection: str, id_: str) -> None:
        if any(e.inference.auto for e in self.catalog.edges_from(collection)):
            self.queue[(collection, id_)] = None

    def _entity(self, c: Collection, id_: str) -> dict[str, Any]:
        row = c.table.get(id_)
        if row is None:
            raise E.EntityNotFound(id_)
        return row

    def _update(self, s: n.Update) -> DataFrame:
        c = self.catalog.collection(s.collection)
        row = self._entity(c, s.id) | s.values
        due = [r.name for r in c.representations.values() if set(r.fields) & set(s.values)]
        if due:
            if "_dirty" not in c.table.schema.names:
                c.table.add("_dirty", SYSTEM["_dirty"])
            row["_dirty"] = sorted({*(row.get("_dirty") or []), *due})
        self.log.commit([*self._fitted(c, row), ("EntityWrite", c.name, s.id, row), *[("ReprDirty", c.name, s.id, {"representation": r}) for r in due]], self.clock())
        c.table.put(row)
        self._enqueue(c.name, s.id)
        return self._done(f"{s.id} updated")

    def _delete(self, s: n.Delete) -> DataFrame:
        c = self.catalog.collection(s.collection)
        self._entity(c, s.id)
        total = 0
        for e in self.catalog.edges.values():
            ends = [F.col("src") == s.id] * (e.source == c.name) + [F.col("dst") == s.id] * (e.target == c.name)
            if ends:
                where = reduce(lambda a, b: a | b, ends)
                gone = e.frame.filter(where).select(F.concat_ws("\x1f", "src", "dst").alias("key"), F.lit(None).cast("string").alias("payload"))
                lost = gone.count()
                if lost:  # a hub's edges are logged and left out where they lie; none comes to the driver
                    self.log.commit_rows("EdgeDelete", e.name, gone, self.clock())
                    e.table.replace(e.frame.filter(~F.coalesce(where, F.lit(False))))
                    total += lost
        self.log.commit([("EntityDelete", c.name, s.id, None)], self.clock())
        c.table.delete(s.id)
        c.rows = max(0, c.rows - 1)
        return self._done(f"{s.id} deleted with {total} edges")

    def _edge_row(self, src: str, dst: str, confidence: float, source: str, metadata=None, start=None, end=None) -> dict[str, Any]:
        return {"src": src, "dst": dst, "confidence": float(confidence), "source": source, "created_at": self.clock(), "valid_from": start, "valid_to": end, "metadata": {k: str(v) for k, v in (metadata or {}).items()}}

    def _put_edge(self, e: EdgeType, row: dict[str, Any], record: str) -> None:
        self.log.commit([(record, e.name, f"{row['src']}\x1f{row['dst']}", row)], self.clock())
        e.table.put(row)

    def _insert_edge(self, s: n.InsertEdge) -> DataFrame:
        e = self.catalog.edge(s.edge_type)
        self._entity(self.catalog.collection(e.source), s.src)
        self._entity(self.catalog.collection(e.target), s.dst)
        bound = lambda x: None if x is None else millis(x)
        self._put_edge(e, self._edge_row(s.src, s.dst, 1.0, "Structural", s.metadata, bound(s.valid_from), bound(s.valid_to)), "EdgeWrite")
        return self._done(f"{e.name} from {s.src} to {s.dst}")

    def _delete_edge(self, s: n.DeleteEdge) -> DataFrame:
        e = self.catalog.edge(s.edge_type)
        self.log.commit([("EdgeDelete", e.name, f"{s.src}\x1f{s.dst}", None)], self.clock())
        e.table.delete(s.src, s.dst)
        return self._done(f"{e.name} from {s.src} to {s.dst} deleted")

    def _confirm(self, s: n.Confirm) -> DataFrame:
        e = self.catalog.edge(s.edge_type)
        old = e.table.get(s.src, s.dst)
        if old is None:
            self._put_edge(e, self._edge_row(s.src, s.dst, s.confidence, "Confirmed"), "EdgeConfirm")
        elif old["source"] == "Structural":
            raise E.InvalidQuery(f"{e.name} from {s.src} to {s.dst} is structural")
        elif old["source"] == "Confirmed":
            self._put_edge(e, old | {"confidence": s.confidence, "valid_from": None, "valid_to": None}, "EdgeConfidenceUpdate")
        else:
            self._put_edge(e, self._edge_row(s.src, s.dst, s.confidence, "Confirmed", old["metadata"]), "EdgeConfirm")
        return self._done(f"{e.name} from {s.src} to {s.dst} confirmed")

    # Tiers

    def _demote(self, s: n.Demote) -> DataFrame:
        c = self.catalog.collection(s.collection)
        self._move(c, [self._demoted(c, self._entity(c, s.id), s.tier)])
        return self._done(f"{s.id} moved to {s.tier}")

    def _demoted(self, c: Collection, row: dict[str, Any], tier: str) -> dict[str, Any]:
        """A row as it is on a colder tier."""
        order = ["hot", "warm", "archive"]
        now = row.get("_tier") or "hot"
        if order.index(tier) <= order.index(now):
            raise E.InvalidStateTransition(f"{row['id']} is {now} and can't move to {tier}")
        cold = json.loads(row.get("_cold") or "{}")
        for r in c.representations.values():
            vector = row.get(r.name) if not r.sparse else None
            if vector is None and r.name in cold:
                vector = _thaw(cold[r.name])
            if vector is not None:
                cold[r.name] = _freeze(vector, tier)
                row[r.name] = None
        return row | {"_tier": tier, "_cold": json.dumps(cold)}

    def _move(self, c: Collection, rows: list[dict[str, Any]]) -> None:
        """Rows on their new tier, in one transaction."""
        for name in ("_tier", "_cold"):
            if name not in c.table.schema.names:
                c.table.add(name, T.StringType())
        self.log.commit([x for r in rows for x in (("TierMigration", c.name, r["id"], {"to": r["_tier"]}), ("EntityWrite", c.name, r["id"], r))], self.clock())
        for r in rows:
            c.table.put(r)

    def migrate_idle(self, collection: str, access: DataFrame, **rules) -> int:
        """One round of moves to colder tiers by ``access`` (id, membership, last_access in ms); how many rows moved."""
        c = self.catalog.collection(collection)
        tiers = c.frame.select("id", *(["_tier"] if "_tier" in c.table.schema.names else [F.lit("hot").alias("_tier")]))
        due = {r.id: r.to_tier for r in placement.tier_cycle(tiers.join(access, "id"), self.clock(), **rules).collect()}  # two batches at most
        if due:
            found = c.frame.filter(F.col("id").isin(*due)).collect()
            self._move(c, [self._demoted(c, r.asDict(recursive=True), due[r.id]) for r in found])
        return len(due)

    def _promote(self, s: n.Promote) -> DataFrame:
        c = self.catalog.collection(s.collection)
        row = self._entity(c, s.id)
        if (row.get("_tier") or "hot") == "hot":
            raise E.InvalidStateTransition(f"{s.id} is hot")
        cold = json.loads(row.get("_cold") or "{}")
        self._move(c, [row | {k: _thaw(v) for k, v in cold.items()} | {"_tier": "hot", "_cold": None}])
        return self._done(f"{s.id} moved to hot")

    # Operations

    def _checkpoint(self, s: n.Checkpoint) -> DataFrame:
        written = {}
        for t in [*self.catalog.collections.values(), *self.catalog.edges.values()]:
            if t.table.changes or t.table.folder and t.table.written is None:
                t.table.flush()
            if t.table.written:
                written[t.name] = t.table.written
        self.log.commit([("Checkpoint", "", "", written)], self.clock())
        return self._said(lsn=self.log.lsn)

    def _backup(self, s: n.Backup) -> DataFrame:
        total = 0
        schemas = []
        for c in self.catalog.collections.values():
            rows = reading.fetch(c.frame, n.Fetch(c.name))
            write_jsonl(rows, f"{s.path}/{c.name}")
            total += self.spark.read.json(f"{s.path}/{c.name}", schema=rows.schema).count()
            schemas.append(json.dumps({"name": c.name, "fields": [f.name for f in rows.schema], "settings": {k: v for k, v in c.settings.items() if k != "auth"}}))
        sidecar_text(self.spark, f"{s.path}/_schemas", schemas)
        return self._said(schemas=len(schemas), entities=total)

    def _restore(self, s: n.Restore) -> DataFrame:
        return self._done(f"to restore from {s.path}, create the collections and IMPORT each folder")

    def _import(self, s: n.Import) -> DataFrame:
        c = self.catalog.collection(s.collection)
        rows, before = read_jsonl(self.spark, s.path), c.table.schema
        for f in rows.schema.fields:
            if f.name not in c.table.schema.names:
                c.table.add(f.name, f.dataType)
        schema = c.table.schema
        if schema != before:
            self.log.commit([self._altered(c, "ADD_FIELD")], self.clock())
        rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        if "tx_time" in schema.names:
            rows = rows.withColumn("tx_time", F.lit(0).cast("long"))
        rows = rows.dropDuplicates(["id"])
        count = rows.count()
        payload = F.to_json(F.struct(*[F.col(f"`{x}`") for x in rows.columns if not x.startswith("_")]))
        self.log.commit_rows("EntityWrite", c.name, rows.select(F.col("id").alias("key"), payload.alias("payload")), self.clock())
        c.table.replace(c.frame.join(rows.select("id"), "id", "left_anti").select(*schema.names).unionByName(rows))
        c.rows += count
        return self._said(imported=count)

    # Upkeep

    def recover(self) -> int:
        """Definitions and rows from the change log; how many rows. Replaying again changes nothing.

        A table version written at the last checkpoint is the start, where nothing was redefined since. Collections over
        DataFrames of the caller are not in the log: those that it has no definition of are left alone.
        """
        log, total = self.log.frame(), 0
        at, versions = changelog.checkpointed(log)
        found = changelog.definitions(log, changelog.COLLECTIONS)
        for name, d in found.items():
            parts = [[n.node(x) for x in d[k]] for k in ("representations", "fields", "indexes")]
            self._define(name, T.StructType.fromJson(d["schema"]), *parts, d["settings"])
        kinds = changelog.definitions(log, changelog.EDGE_TYPES)
        for name, d in kinds.items():
            self._define_edge(name, d["source"], d["target"], n.node(d["decay"]), n.node(d["inference"]))
        for t in [*(self.catalog.collections[x] for x in found), *(self.catalog.edges[x] for x in kinds)]:
            rows = None
            if t.name in versions:
                rows = changelog.rows_since(log, t.name, t.table.schema, at, self.spark.read.parquet(versions[t.name]), t.table.keys)
            t.table.replace(changelog.rows_of(log, t.name, t.table.schema) if rows is None else rows)
            lines = t.table.base.count()
            total += lines
            if isinstance(t, Collection):
                t.rows = lines
        return total

    def recompute_dirty(self, collection: str) -> int:
        """Encode anew what updates have made stale; one pass over the table. The number of rows that were due."""
        c = self.catalog.collection(collection)
        df = c.frame
        due = df.filter(F.size(F.coalesce("_dirty", F.array().cast("array<string>"))) > 0).count()
        if due:
            for r in c.representations.values():
                if r.fields:
                    fresh = self.vectoriser(c.name, r.name).column([f for f in r.fields if f in df.columns])
                    stale = F.coalesce(F.array_contains("_dirty", r.name), F.lit(False))
                    df = df.withColumn(r.name, F.when(stale, fresh).otherwise(F.col(r.name)))
            made = df.filter(F.size("_dirty") > 0).withColumn("_dirty", F.array().cast("array<string>"))
            self.log.commit_rows("ReprWrite", c.name, made.select(F.col("id").alias("key"), F.to_json(F.struct(*[F.col(f"`{x}`") for x in made.columns])).alias("payload")), self.clock())
            c.table.replace(df.withColumn("_dirty", F.array().cast("array<string>")))
        return due

    def infer_queued(self) -> int:
        """Edges for entities that were written since: one batch for each type that infers by itself."""
        made, ids = 0, list(self.queue)[: inference.BATCH]
        for e in [e for e in self.catalog.edges.values() if e.inference.auto]:
            home, target = self.catalog.collection(e.source), self.catalog.collection(e.target)
            vector = home.representation(False).name
            names = [i for c, i in ids if c == e.source]
            found = searching.clean_only(home.frame.filter(F.col("id").isin(names)), vector).select("id", vector).collect() if names else []  # at most BATCH rows
            sources = [(r[0], r[1]) for r in found if r[1] is not None]
            if not sources:
                continue
            near = inference.nearest_targets(sources, target.frame, target.representation(False).name, e.frame, e.inference.limit, e.inference.confidence)
            rows = [self._edge_row(r.src, r.dst, r.confidence, "Inferred") for r in near.collect()]  # at most BATCH * limit
            if rows:
                self.log.commit([("EdgeInferred", e.name, f"{r['src']}\x1f{r['dst']}", r) for r in rows], self.clock())
            for r in rows:
                e.table.put(r)
            made += len(rows)
        for k in ids:
            self.queue.pop(k, None)
        return made

    def sweep_decayed(self) -> int:
        """Delete inferred edges whose confidence has decayed below the prune threshold; how many."""
        total = 0
        for e in self.catalog.edges.values():
            if e.decay is not None and e.decay.prune is not None:
                before = e.frame
                stay = inference.decay_sweep(before, e.decay, self.clock())
                lost = before.select("src", "dst").join(stay.select("src", "dst"), ["src", "dst"], "left_anti")
                gone = lost.count()
                if gone:
                    self.log.commit_rows("EdgeDelete", e.name, lost.select(F.concat_ws("\x1f", "src", "dst").alias("key"), F.lit(None).cast("string").alias("payload")), self.clock())
                    e.table.replace(stay)
                    total += gone
        return total

    def cooccurrence(self) -> DataFrame:
        return placement.cooccurrence(self.spark.createDataFrame([(x,) for x in self.together], "members array<string>"), "members")

    # Explanations

    def _explain_tiers(self, s: n.ExplainTiers) -> DataFrame:
        df = self.catalog.collection(s.collection).frame
        return placement.tier_counts(df if "_tier" in df.columns else df.withColumn("_tier", F.lit("hot")))

    def _explain_history(self, s: n.ExplainHistory) -> DataFrame:
        rows = [a for a in reversed(self.audit) if a["id"] == s.id][: s.limit]
        return self.spark.createDataFrame([(a["id"], a["edge_type"], a["trigger"], a["at"], a["limit"]) for a in rows], "id string, edge_type string, trigger string, at long, max_rows int")

    def _explain(self, s: n.Explain) -> DataFrame:
        from .plans.explain import properties

        return self.spark.createDataFrame(properties(self, s.of), "property string, value string")


def _freeze(vector, tier: str) -> dict[str, Any]:
    """A vector on a colder tier: 8 bits an element, or one."""
    if tier == "archive":
        return {"bits": "".join("1" if x >= 0 else "0" for x in vector)}
    low, high = min(vector), max(vector)
    step = (high - low) / 255
    return {"low": low, "high": high, "codes": [int((x - low) / step + 0.5) if step else 0 for x in vector]}


def _thaw(q: dict[str, Any]) -> list[float]:
    if "bits" in q:
        return [1.0 if b == "1" else -1.0 for b in q["bits"]]
    return [q["low"] + c / 255 * (q["high"] - q["low"]) for c in q["codes"]]



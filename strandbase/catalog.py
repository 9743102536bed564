"""Collections and edge types: what they are called, what they hold, and their rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CollectionNotFound, EdgeTypeNotFound, InvalidQuery
from .language import nodes as n

TYPES = {"TEXT": T.StringType(), "DATETIME": T.StringType(), "BOOL": T.BooleanType(), "INT": T.LongType(), "FLOAT": T.DoubleType(), "ENTITY_REF": T.StringType()}
DENSE = T.ArrayType(T.FloatType())
SPARSE = T.ArrayType(T.StructType([T.StructField("dim", T.LongType()), T.StructField("weight", T.DoubleType())]))
SYSTEM = {"valid_from": T.LongType(), "valid_to": T.LongType(), "tx_time": T.LongType(), "_dirty": T.ArrayType(T.StringType()), "_tier": T.StringType(), "_cold": T.StringType()}
EDGE = T.StructType().add("src", "string").add("dst", "string").add("confidence", "double").add("source", "string").add("created_at", "long").add("valid_from", "long").add("valid_to", "long").add("metadata", T.MapType(T.StringType(), T.StringType()))


class Table:
    """Rows by key: a DataFrame and the changes since, at most ``flush_rows`` of which the driver holds.

    Reading joins the changes in (a small, bounded side); beyond the bound they are folded in and, where there is a
    folder, written there as a new version.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, keys: tuple[str, ...] = ("id",), base: DataFrame | None = None, folder: str | None = None, flush_rows: int = 5000):
        self.spark, self.keys, self.folder, self.flush_rows = spark, keys, folder, flush_rows
        self.base = base if base is not None else spark.createDataFrame([], schema)
        self.schema = T.StructType(list(self.base.schema.fields))
        self.changes: dict[tuple, dict[str, Any] | None] = {}
        self.version, self.written = 0, None  # the last version, and where it lies

    def frame(self) -> DataFrame:
        if not self.changes:
            return self.base
        key_type = T.StructType([self.schema[k] for k in self.keys])
        gone = self.spark.createDataFrame([tuple(k) for k in self.changes], T.StructType([T.StructField(f.name, f.dataType) for f in key_type]))
        rows = [tuple(r.get(f.name) for f in self.schema) for r in self.changes.values() if r is not None]
        new = self.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]))
        return self.base.join(F.broadcast(gone), list(self.keys), "left_anti").select(self.schema.names).unionByName(new)

    def get(self, *key) -> dict[str, Any] | None:
        if key in self.changes:
            row = self.changes[key]
            return dict(row) if row is not None else None
        found = self.base.filter(_all(F.col(k) == v for k, v in zip(self.keys, key))).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def put(self, row: dict[str, Any]) -> None:
        for name, value in row.items():
            self._fit(name, value)
        self.changes[tuple(row[k] for k in self.keys)] = {f.name: _as(row.get(f.name), f.dataType) for f in self.schema}
        self._bound()

    def delete(self, *key) -> None:
        self.changes[key] = None
        self._bound()

    def _bound(self) -> None:
        if len(self.changes) > self.flush_rows:
            self.flush()

    def flush(self) -> None:
        """Fold the changes in."""
        self.replace(self.frame())

    def replace(self, df: DataFrame) -> None:
        if self.folder:
            path = self._next_path()
            df.write.mode("errorifexists").parquet(path)
            df, self.written = self.spark.read.parquet(path), path
        self.base, self.changes, self.schema = df, {}, T.StructType(list(df.schema.fields))

    def _next_path(self) -> str:
        """The folder of the next version, after those of any process before."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        self.version = max([self.version, *[int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit()]]) + 1
        return f"{self.folder}/v{self.version:06d}"

    def _fit(self, name: str, value: Any) -> None:
        """A column for a field that is not declared; a wider one where whole numbers meet others."""
        if name not in self.schema.names:
            kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value), T.StringType())
            self.add(name, kind)
        elif isinstance(value, float) and isinstance(self.schema[name].dataType, (T.LongType, T.IntegerType)):
            self.replace(self.frame().withColumn(name, F.col(name).cast("double")))

    def add(self, name: str, kind: T.DataType) -> None:
        self.base = self.base.withColumn(name, F.lit(None).cast(kind))
        self.schema = T.StructType([*self.schema.fields, T.StructField(name, kind)])
        for row in self.changes.values():
            if row is not None:
                row[name] = None


def _all(columns):
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _as(value: Any, kind: T.DataType) -> Any:
    if value is None or isinstance(kind, (T.ArrayType, T.MapType)):
        return value
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(kind, T.DoubleType) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    fits = {T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.FloatType: float, T.BooleanType: bool}.get(type(kind))
    if fits and (not isinstance(value, fits) or (fits is int and isinstance(value, bool))):
        raise InvalidQuery(f"{value!r} does not fit a column of {kind.simpleString()}")
    return value


@dataclass
class Collection:
    name: str
    table: Table
    representations: dict[str, n.RepresentationDecl] = field(default_factory=dict)
    fields: dict[str, n.FieldDecl] = field(default_factory=dict)
    indexes: dict[str, n.IndexDecl] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)
    rows: int = 0  # as far as known without counting

    @property
    def frame(self) -> DataFrame:
        return self.table.frame()

    def definition(self) -> dict[str, Any]:
        """All but the rows and the credentials, as what JSON can hold."""
        parts = {k: [n.plain(x) for x in getattr(self, k).values()] for k in ("representations", "fields", "indexes")}
        return parts | {"settings": {k: v for k, v in self.settings.items() if k != "auth"}, "schema": self.table.schema.jsonValue()}

    def representation(self, sparse: bool, using: str | None = None) -> n.RepresentationDecl:
        if using is not None:
            if using not in self.representations:
                raise InvalidQuery(f"{self.name} has no representation {using}")
            return self.representations[using]
        for r in self.representations.values():
            if r.sparse == sparse:
                return r
        raise InvalidQuery(f"{self.name} has no {'sparse' if sparse else 'dense'} representation")

    def index_of(self, name: str | None) -> str | None:
        return next((i.name for i in self.indexes.values() if i.fields[:1] == (name,)), None)


@dataclass
class EdgeType:
    name: str
    source: str
    target: str
    table: Table
    decay: n.DecayDecl | None = None
    inference: n.InferenceDecl = field(default_factory=n.InferenceDecl)

    @property
    def frame(self) -> DataFrame:
        return self.table.frame()

    def definition(self) -> dict[str, Any]:
        return {"source": self.source, "target": self.target, "decay": n.plain(self.decay), "inference": n.plain(self.inference)}


class Catalog:
    def __init__(self):
        self.collections: dict[str, Collection] = {}
        self.edges: dict[str, EdgeType] = {}

    def collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise CollectionNotFound(name)
        return self.collections[name]

    def edge(self, name: str) -> EdgeType:
        if name not in self.edges:
            raise EdgeTypeNotFound(name)
        return self.edges[name]

    def edges_from(self, collection: str) -> list[EdgeType]:
        return [e for e in self.edges.values() if e.source == collection]

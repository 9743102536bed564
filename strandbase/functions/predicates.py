"""Conditions to columns.

Conditions are two-valued: a comparison with a missing value is false, its negation true. A filter drops NULL and
false alike, so a bare comparison is right at the top and under AND and OR, and is what Parquet can be asked; below
NOT every leaf is made true or false.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQuery
from ..language import nodes as n

Resolve = Callable[[n.Ref], tuple[Column, T.DataType] | None]
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "float", str: "string"}[type(value)]


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, WHOLE):
        return "int"
    if isinstance(dtype, NUMBERS):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "string"


def _comparable(column: str, value: str, ordered: bool, strict: bool) -> bool:
    if column == "time":
        return value == "string"
    if column in ("int", "float") and value in ("int", "float"):
        return ordered or not strict or column == value
    return column == value and not (ordered and column == "bool")


def _literal(value: Any, dtype: T.DataType) -> Column:
    return F.to_timestamp(F.lit(value)) if _kind(dtype) == "time" else F.lit(value)


def like(column: Column, pattern: str) -> Column:
    """% and _ only; a backslash is itself."""
    return column.like(pattern.replace("\\", "\\\\"))


def _leaf(c: n.Compare, resolve: Resolve, strict: bool) -> tuple[Column, bool]:
    """The column, and whether it can be NULL."""
    found = resolve(c.ref)
    if c.op in ("ISNULL", "NOTNULL"):
        missing = F.lit(True) if found is None else found[0].isNull()
        return (missing if c.op == "ISNULL" else ~missing), False
    if found is None:
        return F.lit(c.op == "!="), False
    column, dtype = found
    kind = _kind(dtype)
    if c.op == "=" or c.op == "!=":
        if c.value is None:
            return (column.isNull() if c.op == "=" else column.isNotNull()), False
        if not _comparable(kind, kind_of(c.value), False, strict):
            return F.lit(c.op == "!="), False
        same = column == _literal(c.value, dtype)
        return (same, True) if c.op == "=" else (F.coalesce(~same, F.lit(True)), False)
    if c.op == "IN":
        fitting = [v for v in c.value if v is not None and _comparable(kind, kind_of(v), False, strict)]
        some = column.isin([_literal(v, dtype) for v in fitting]) if fitting else F.lit(False)
        return (F.coalesce(some, F.lit(False)) | column.isNull(), False) if None in c.value else (some, bool(fitting))
    if c.op == "LIKE":
        return (like(column, c.value), True) if kind == "string" else (F.lit(False), False)
    if not _comparable(kind, kind_of(c.value), True, strict):
        return F.lit(False), False
    if strict and c.op in (">=", "<=") and not _comparable(kind, kind_of(c.value), False, True):
        c = n.Compare(c.ref, c.op[0], c.value)  # equality never holds between kinds
    value = _literal(c.value, dtype)
    return {">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[c.op], True


def condition(tree: Any, resolve: Resolve, strict: bool = False, exact: bool = False) -> Column:
    """The condition's column. ``exact``: true or false for every row, as NOT needs it."""
    if isinstance(tree, n.Not):
        return ~condition(tree.of, resolve, strict, True)
    if isinstance(tree, n.Both):
        left, right = condition(tree.left, resolve, strict, exact), condition(tree.right, resolve, strict, exact)
        return left & right if tree.op == "AND" else left | right
    if not isinstance(tree, n.Compare):
        raise InvalidQuery(f"not a condition: {tree!r}")
    column, nullable = _leaf(tree, resolve, strict)
    return F.coalesce(column, F.lit(False)) if exact and nullable else column


def leading_field(tree: Any) -> str | None:
    """The field of the leftmost comparison, if it is not negated."""
    while isinstance(tree, n.Both):
        tree = tree.left
    return tree.ref.name if isinstance(tree, n.Compare) else None

"""Validity intervals: half-open, in epoch milliseconds, NULL without bound."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..language.nodes import Temporal


def millis(value: Any) -> int:
    """Of whole milliseconds, YYYY-MM-DD or YYYY-MM-DDTHH:MM:SSZ; anything else is an error."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    text = str(value)
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    for pattern, form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", "%Y-%m-%dT%H:%M:%SZ")):
        if re.fullmatch(pattern, text):
            try:
                return int(datetime.strptime(text, form).replace(tzinfo=timezone.utc).timestamp() * 1000)
            except ValueError as e:
                raise InvalidQuery(f"not a time: {text}") from e
    raise InvalidQuery(f"not a time: {text}")


def valid(t: Temporal, valid_from: Column | None, valid_to: Column | None, tx_time: Column | None = None) -> Column:
    """Rows that hold at the time, in the period or at the transaction; missing columns are without bound."""
    after = lambda bound, x: F.lit(True) if bound is None else bound.isNull() | x(bound)
    if t.kind == "TRANSACTION":
        return F.lit(True) if tx_time is None else F.coalesce(tx_time <= t.start, F.lit(True))
    start = millis(t.start)
    if t.kind == "AS_OF":
        return after(valid_from, lambda b: b <= start) & after(valid_to, lambda b: b > start)
    end = millis(t.end)
    return after(valid_from, lambda b: b < end) & after(valid_to, lambda b: b > start)

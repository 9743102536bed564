"""Encoders from fields or text to vectors."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery


class Vectoriser(ABC):
    """One model: ``encode`` of an entity's fields, ``encode_query`` of a text, both on the driver; ``column`` for tables."""

    model_id = ""
    size = 0
    sparse = False

    @abstractmethod
    def encode(self, fields: Mapping[str, str]) -> list: ...

    @abstractmethod
    def encode_query(self, text: str) -> list: ...

    def encode_batch(self, rows: Sequence[Mapping[str, str]]) -> list[list]:
        return [self.encode(r) for r in rows]

    def column(self, fields: Sequence[str]) -> Column:
        """The vector of each row, from the fields that are not NULL."""
        from pyspark.sql.functions import pandas_udf

        names, encode = sorted(fields), self.encode

        @pandas_udf("array<float>")
        def run(*columns):
            import pandas as pd

            rows = zip(*columns)
            return pd.Series([encode({k: str(v) for k, v in zip(names, r) if v is not None}) for r in rows])

        return run(*[F.col(f).cast("string") for f in names])


class HashVectoriser(Vectoriser):
    """Bytes of a SHA-256 as numbers from -1 to 1, repeated to ``size``; deterministic, without a model."""

    model_id = "hash"

    def __init__(self, size: int = 8):
        self.size = size

    def _spread(self, text: str) -> list[float]:
        digest = hashlib.sha256(text.encode()).digest()
        return [digest[i % 32] / 128.0 - 1.0 for i in range(self.size)]

    def encode(self, fields: Mapping[str, str]) -> list[float]:
        return self._spread("|".join(f"{k}={fields[k]}" for k in sorted(fields)))

    def encode_query(self, text: str) -> list[float]:
        return self._spread(text)

    def text_column(self, text: Column) -> Column:
        digest = F.sha2(text.cast("binary"), 256)
        byte = lambda i: F.conv(F.substring(digest, F.lit(2 * (i % 32) + 1), F.lit(2)), 16, 10).cast("double")
        return F.array(*[(byte(i) / 128.0 - 1.0).cast("float") for i in range(self.size)])

    def column(self, fields: Sequence[str]) -> Column:
        parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in sorted(fields)]
        return self.text_column(F.concat_ws("|", *parts))


class Passthrough(Vectoriser):
    """For vectors that come from outside; encodes nothing."""

    model_id = "passthrough"

    def encode(self, fields: Mapping[str, str]) -> list:
        raise InvalidQuery("this representation takes explicit vectors only")

    encode_query = encode


class HashedTerms(Vectoriser):
    """Sparse weights ln(1 + count) of the words of a text, by hashed dimension."""

    model_id, sparse = "hashed-terms", True

    def __init__(self, size: int = 30_000):
        self.size = size

    def encode_query(self, text: str) -> list[tuple[int, float]]:
        import math
        import re
        import zlib
        from collections import Counter

        counts = Counter(zlib.crc32(w.encode()) % self.size for w in re.findall(r"\w+", text.lower()))
        return [(d, math.log1p(c)) for d, c in sorted(counts.items())]

    def encode(self, fields: Mapping[str, str]) -> list[tuple[int, float]]:
        return self.encode_query(" ".join(str(fields[k]) for k in sorted(fields)))


class CallVectoriser(Vectoriser):
    """Any function from a list of texts to their vectors: a local model or a service."""

    def __init__(self, call: Callable[[list[str]], list], size: int, model_id: str = "external", sparse: bool = False):
        self.call, self.size, self.model_id, self.sparse = call, size, model_id, sparse

    def encode(self, fields: Mapping[str, str]) -> list:
        return self.call([". ".join(f"{k}: {fields[k]}" for k in sorted(fields))])[0]

    def encode_query(self, text: str) -> list:
        return self.call([text])[0]

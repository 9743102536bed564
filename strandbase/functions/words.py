"""Texts as sparse vectors of their own words."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks carry this module's functions themselves, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text whose words are counted at once.
CHUNK = 4 << 20
WORDS = pa.list_(pa.struct([pa.field("dim", pa.string()), pa.field("weight", pa.float64())]))


def counted(text: pa.Array) -> pa.Array:
    """Of each text its different words in order, with ln(1 + how often it holds them)."""
    lists = pc.split_pattern(text, " ")
    words = lists.flatten().dictionary_encode()
    names = words.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = pc.list_parent_indices(lists).to_numpy().astype(np.int64) * max(len(order), 1) + rank[words.indices.to_numpy()]
    keys = keys[pc.not_equal(words.cast(pa.string()), "").to_numpy(zero_copy_only=False)] if len(keys) else keys
    keys, n = np.unique(keys, return_counts=True)
    row, word = np.divmod(keys, max(len(order), 1))
    ends = np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int32)
    parts = [names.take(pa.array(order[word])), pa.array(np.log(1.0 + n))]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(WORDS.value_type)))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(text):
            end = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")), at + 1)
            words = counted(text.slice(at, end - at))
            out = pa.RecordBatch.from_arrays([ids.slice(at, end - at), words], ["id", "words"])
            yield out.filter(pc.greater(pc.list_value_length(words), 0))
            at = end


def word_vectors(df: DataFrame, key: Column, text: str) -> DataFrame:
    """id and words, the sparse vector of each document by its own words, array<struct<dim, weight>>; without words no row.

    Words are counted where the text lies, nothing is shuffled. Only where an id has several rows these are brought
    together; whether there is such an id is looked up first, by the ids alone.
    """
    rows = df.select(key.alias("id"), F.lower(text).alias("text")).filter(F.col("text").isNotNull())
    schema = "id string, words array<struct<dim: string, weight: double>>"
    shared = rows.groupBy(F.col("id").alias("again")).count().filter("count > 1").select("again")
    if shared.isEmpty():
        return rows.mapInArrow(count_words, schema)
    same = F.col("id").eqNullSafe(F.col("again"))
    words = rows.join(shared, same, "left_semi").select("id", F.explode(F.split("text", " ")).alias("dim")).filter("dim <> ''")
    weights = words.groupBy("id", "dim").agg(F.log(F.count("*") + 1.0).alias("weight"))
    merged = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("words"))
    return rows.join(shared, same, "left_anti").mapInArrow(count_words, schema).unionByName(merged)

"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One object a line; nested values as JSON text; an id for rows that have none. A broken line is an error."""
    reader = spark.read.option("mode", "FAILFAST").option("primitivesAsString", "false")
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            df = df.withColumn(f.name, F.to_json(F.col(f"`{f.name}`")))
    if "id" not in df.columns:
        return df.withColumn("id", F.expr("uuid()"))
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.expr("uuid()")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def sidecar_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file beside the data, written by Spark so that any store will do."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("errorifexists").text(path)

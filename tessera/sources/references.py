"""Labelled reference vectors: a (gzipped) JSON array of {vector, label}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.features import indicator, quantized
from tessera.schema import DIMS, LABELLED


def read_references(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(vec_id, label, q0...) in the array's order; vectors of another length are dropped. One array is one task to read, so it is dealt out afterwards."""
    rows = spark.read.schema(LABELLED).option("multiLine", True).json(path)
    rows = rows.where(F.size("vector") == DIMS).select(F.monotonically_increasing_id().alias("vec_id"), indicator(F.col("label")).alias("label"), "vector")
    if partitions:
        rows = rows.repartition(partitions)
    return rows.select("vec_id", "label", *[quantized(F.col("vector")[i]).alias(f"q{i}") for i in range(DIMS)])

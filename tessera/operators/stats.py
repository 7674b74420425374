"""What an index holds: counts, cluster sizes and bytes in the binary layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import offsets
from tessera.schema import DIMS


def index_stats(centroids: DataFrame, postings: DataFrame, dims: int = DIMS) -> DataFrame:
    """One row: n, k, d, padded_n, bytes of each section, and average, largest, smallest and number of non-empty clusters."""
    per = offsets(postings, centroids)
    one = per.agg(
        F.sum("size").alias("n"), F.count("*").alias("k"), F.sum("padded").alias("padded_n"), F.avg("size").alias("avg_size"),
        F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.count_if(F.col("size") > 0).alias("non_empty"),
    )
    k, padded = F.col("k"), F.col("padded_n")
    return one.select(
        "n", "k", F.lit(dims).alias("d"), "padded_n",
        (4 * dims * k).alias("centroid_bytes"), (4 * (k + 1)).alias("offset_bytes"), padded.alias("label_bytes"), (padded * dims * 2).alias("block_bytes"),
        (16 + 4 * dims * k + 4 * (k + 1) + padded + padded * dims * 2).alias("total_bytes"),
        "avg_size", "max_size", "min_size", "non_empty",
    )

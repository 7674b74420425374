"""Approximate against exact search, on queries drawn from the references themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.ranking import systematic
from tessera.schema import DIMS, FRAUD_FROM, NEIGHBOURS


def compare(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row of counters from two tables of (qid, fraud_count); `other` is each mismatch that is no false positive, `fn` those that turn a fraud into an approval."""
    both = approximate.select("qid", F.col("fraud_count").alias("a")).join(exact.select("qid", F.col("fraud_count").alias("e")), "qid")
    differs, raised = F.col("a") != F.col("e"), (F.col("a") >= FRAUD_FROM) & (F.col("e") < FRAUD_FROM)
    counted = both.agg(
        F.count("*").alias("queries"), F.count_if(differs).alias("mismatch"), F.count_if(differs & raised).alias("fp"),
        F.count_if(differs & ~raised).alias("other"), F.count_if((F.col("a") < FRAUD_FROM) & (F.col("e") >= FRAUD_FROM)).alias("fn"),
    )
    return counted.withColumn("mismatch_pct", F.coalesce(F.try_divide(100.0 * F.col("mismatch"), F.col("queries")), F.lit(0.0)))


def accuracy(postings: DataFrame, centroids: DataFrame, nprobe: int = 15, sample: int = 200, k: int = NEIGHBOURS, dims: int = DIMS, exclude_self: bool = False) -> DataFrame:
    refs = postings.select("vec_id", "label", *search.columns(dims))
    queries = systematic(refs, "vec_id", sample).withColumnRenamed("vec_id", "qid").drop("label")
    near = search.ivf_nearest(postings, centroids, queries, nprobe, k + exclude_self, dims)
    if exclude_self:
        near = search.top(near.where("qid <> vec_id").drop("rank"), k)
    return compare(search.score(queries, near, k), search.score(queries, search.nearest(refs, queries, k, dims, exclude_self), k))


def gate(counters: DataFrame) -> bool:
    """Whether no query's count differs."""
    return counters.first()["mismatch"] == 0

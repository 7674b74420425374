"""Global ranks and running sums without a single task: by ranges of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def _ranged(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """Adds _range: rows of equal width of the key, in its order."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    width = 1 if lo is None else max(1, -(-(hi - lo + 1) // ranges))
    return df.withColumn("_range", F.floor((F.col(key) - F.lit(lo or 0)) / width))


def running(df: DataFrame, key: str, amount: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds the sum of amount over all rows up to and with this one, in order of key (unique integers)."""
    rows = _ranged(df, key, ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = rows.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.sum(amount).over(within)).drop("_range", "_start")


def ranked(df: DataFrame, key: str, name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Adds 0, 1, ... in order of key."""
    return running(df, key, F.lit(1).cast("long"), name, ranges).withColumn(name, (F.col(name) - 1).cast("long"))


def systematic(df: DataFrame, key: str, sample: int) -> DataFrame:
    """Every n-th row in order of key, from the first on: `sample` rows, or all there are."""
    step = max(1, df.count() // max(sample, 1))
    return ranked(df, key, "_rank").where((F.col("_rank") % step == 0) & (F.col("_rank") < step * sample)).drop("_rank")


def weighted_pick(df: DataFrame, key: str, weight: str, fraction: float) -> DataFrame:
    """The first row, in order of key, at which the running weight reaches this fraction of the whole."""
    goal = (df.agg(F.sum(weight)).first()[0] or 0) * fraction
    return running(df, key, F.col(weight), "cumulative").where(F.col("cumulative") >= F.lit(float(goal))).orderBy(key).limit(1)

"""The inverted-file index: seeding, assignment, update, training, posting lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.distance import squared_flat
from tessera.operators.ranking import systematic, weighted_pick
from tessera.operators.search import columns, matrix
from tessera.schema import BLOCK, DIMS
from tessera.session import ship, shared_path, stored

# The generator of seeds.
LCG_FACTOR, LCG_TERM, LCG_START = 6364136223846793005, 1442695040888963407, 0xDEADBEEFCAFEBABE
MOST_CLUSTERS = 4096
SAMPLE = 10_000


def centroid_array(centroids: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids as arrays, by cluster id; at most MOST_CLUSTERS of them, which is checked."""
    rows = centroids.select("cluster_id", *columns(dims)).limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    x = np.array(sorted(rows), dtype=np.int64).reshape(-1, dims + 1)
    return x[:, 0], x[:, 1:]


def assign(vectors: DataFrame, centroids: DataFrame, dims: int = DIMS) -> DataFrame:
    """vectors with the cluster_id of the nearest centroid (ties: the smaller), a batch at a time and without a shuffle."""
    ids, c = centroid_array(centroids, dims)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, c.astype(np.float64)))
    rows = vectors.drop("cluster_id")
    rows = rows.select(*columns(dims), *[n for n in rows.columns if n not in columns(dims)])

    ship(vectors.sparkSession)

    def nearest(batches):
        ids, c = shared.value
        norm = (c**2).sum(axis=1)
        for batch in batches:
            found = []
            for s in range(0, batch.num_rows, 4096):
                x = matrix(batch.slice(s, 4096), 0, dims).astype(np.float64)
                found.append(ids[np.argmin(norm[None, :] - 2 * (x @ c.T), axis=1)])
            cluster = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32))], names=[*batch.schema.names, "cluster_id"])

    return rows.mapInArrow(nearest, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cluster_id int")


def update(assigned: DataFrame, centroids: DataFrame, dims: int = DIMS, zero_empty: bool = False) -> DataFrame:
    """(cluster_id, q0...) at the rounded mean of each cluster's vectors; empty ones keep their place, or go to the origin."""
    means = assigned.groupBy("cluster_id").agg(*[F.round(F.sum(c).cast("double") / F.count("*")).cast("int").alias(f"m_{c}") for c in columns(dims)])
    old = (lambda c: F.lit(0)) if zero_empty else F.col
    return centroids.join(F.broadcast(means), "cluster_id", "left").select("cluster_id", *[F.coalesce(f"m_{c}", old(c)).cast("int").alias(c) for c in columns(dims)])


def changed(before: DataFrame, after: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: total, and how many vectors have another cluster."""
    both = before.select(key, F.col("cluster_id").alias("_old")).join(after.select(key, "cluster_id"), key)
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("_old") != F.col("cluster_id")).alias("changed"))


def strided_seeds(vectors: DataFrame, k: int, dims: int = DIMS) -> DataFrame:
    """The first k of every (n / k)-th vector as centroids: deterministic in any engine."""
    seeds = systematic(vectors, "vec_id", k)
    return seeds.withColumn("cluster_id", (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("int")).select("cluster_id", *columns(dims))  # k rows


def plus_plus_seeds(vectors: DataFrame, k: int, dims: int = DIMS, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """k-means++ on a systematic sample of at most `sample` vectors: each next seed with probability by its squared distance to those chosen."""
    rows = systematic(vectors, "vec_id", sample).select(*columns(dims)).collect()  # `sample` rows at most
    x = np.array(rows, dtype=np.float64).reshape(-1, dims)
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    chosen = [int(rng.integers(len(x)))] if k else []
    nearest = ((x - x[chosen[0]]) ** 2).sum(axis=1) if k else np.empty(0)
    while len(chosen) < k:
        mass = np.cumsum(nearest)
        if mass[-1] <= 0:  # only copies of those chosen are left
            there = set(chosen)
            chosen.append(next(i for i in range(len(x)) if i not in there))
        else:
            chosen.append(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    out = [(i, *map(int, x[c])) for i, c in enumerate(chosen)]
    return vectors.sparkSession.createDataFrame(out, "cluster_id int, " + ", ".join(f"{c} int" for c in columns(dims)))


def lcg(state: int) -> int:
    """The next state of the 64-bit generator that draws seeds."""
    return (state * LCG_FACTOR + LCG_TERM) & (1 << 64) - 1


def plus_plus_over_all(vectors: DataFrame, k: int, dims: int = DIMS) -> DataFrame:
    """k-means++ over all vectors (vec_id: 0, 1, ...), by integer distances: two passes a seed, and no vector but the seeds leaves the executors.

    The first seed is a drawn vec_id; each next one is where the running distance, in order of vec_id, reaches a drawn share of the whole.
    """
    rows = stored(vectors.select("vec_id", *columns(dims)).withColumn("mass", F.lit(None).cast("long")), "seeding")
    n, state, seeds = rows.count(), lcg(LCG_START), []
    pick = rows.where(F.col("vec_id") == (state >> 33) % n) if n else rows
    while len(seeds) < min(k, n):
        seed = pick.select(*columns(dims)).first()
        seeds.append((len(seeds), *map(int, seed)))
        if len(seeds) == min(k, n):
            break
        far = squared_flat([F.col(c) for c in columns(dims)], [F.lit(v) for v in seeds[-1][1:]])
        rows = stored(rows.withColumn("mass", F.least("mass", far)), "seeding")
        state = lcg(state)
        pick = weighted_pick(rows, "vec_id", "mass", (state >> 11) / (1 << 53))
    return vectors.sparkSession.createDataFrame(seeds, "cluster_id int, " + ", ".join(f"{c} int" for c in columns(dims)))


def default_clusters(n: int) -> int:
    return max(1, min(MOST_CLUSTERS, math.isqrt(n)))


def lloyd(vectors: DataFrame, centroids: DataFrame, dims: int = DIMS, most: int = 25, tolerance: float = 0.001) -> DataFrame:
    """Centroids after rounds of assignment and update, until fewer than `tolerance` of the vectors move. Each round is written, so its lineage is short."""
    before = None
    centroids = stored(centroids.coalesce(1), "centroids")
    for _ in range(most):
        after = stored(assign(vectors, centroids, dims).select("vec_id", "cluster_id", *columns(dims)), "assigned")
        centroids = stored(update(after, centroids, dims).coalesce(1), "centroids")
        if before is not None:
            total, moved = changed(before, after).first()
            if moved < tolerance * total:
                break
        before = after
    return centroids


def train(vectors: DataFrame, k: int | None = None, dims: int = DIMS, most: int = 25, sample: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(centroids, postings). With `sample`, Lloyd's rounds run on that many vectors only; the posting lists always hold all."""
    k = k or default_clusters(vectors.count())
    base = stored(systematic(vectors, "vec_id", sample), "sample") if sample else vectors
    centroids = lloyd(base, plus_plus_seeds(vectors, k, dims, seed=seed), dims, most)
    return centroids, postings(assign(vectors, centroids, dims))


def postings(assigned: DataFrame) -> DataFrame:
    """Adds pos, a vector's place in its cluster's list."""
    return assigned.withColumn("pos", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("vec_id")) - 1).cast("int"))


def offsets(postings_: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, size, padded, start): sizes, sizes padded to whole blocks, and where padded lists start. A row a cluster."""
    sizes = postings_.groupBy("cluster_id").agg(F.count("*").alias("n"))
    rows = centroids.select("cluster_id").join(F.broadcast(sizes), "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("padded", (F.ceil(F.col("size") / BLOCK) * BLOCK).cast("long"))
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("padded").over(before), F.lit(0)).cast("long"))


def write(centroids: DataFrame, postings_: DataFrame, path: str) -> None:
    """Parquet: centroids, and postings in a folder a cluster, so that probes prune what is read."""
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    postings_.repartition("cluster_id").sortWithinPartitions("cluster_id", "pos").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/postings")

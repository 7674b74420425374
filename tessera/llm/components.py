"""Connected components of an edge table, distributed: local forests, then alternating large and small stars.

No edge list, component or label leaves the executors. Each round's tables are written to
the shared folder, so lineage stays short and a lost executor costs one round at most.
Rounds end as soon as every edge leads to the smallest node of its component, which local
forests alone often bring about, and one last forest where few edges are left. A component's hub may be most of the table: it is joined
by tables that Spark can broadcast or split, and aggregated before it is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blooms import few, matched
from .common import map_arrow, materialise

#: Edges that one local forest is made of: bounds a task's memory.
FOREST_EDGES = 200_000


def _forest(u: list[int], v: list[int]) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _local(batches):
    """Each node of up to FOREST_EDGES edges with the smallest one that these lead to."""
    for u, v in _gathered(batches):
        roots = [(x, r) for x, r in _forest(u, v).items() if x != r]
        x = np.array(roots, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])


def _gathered(batches):
    """Edges of batches, which may be short, in lists of up to FOREST_EDGES."""
    u, v = [], []
    for batch in batches:
        for s in range(0, batch.num_rows, FOREST_EDGES):
            part = batch.slice(s, FOREST_EDGES)
            if len(u) + part.num_rows > FOREST_EDGES:
                yield u, v
                u, v = [], []
            u += part.column(0).to_pylist()
            v += part.column(1).to_pylist()
    yield u, v


def stars(e: DataFrame) -> bool:
    """Whether every node hangs on one other that itself hangs on none."""
    ends = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select("v", F.lit(None).cast("long")))
    odd = ends.groupBy("n").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count_if(F.col("m").isNull()).alias("held"))
    return odd.where("lo is not null and (lo <> hi or held > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (columns a, b, long); component is the smallest node that can be reached. Loops and repeated edges do no harm."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e = materialise(map_arrow(e, _local, "u long, v long").distinct(), "edges")
    whole = few(e, FOREST_EDGES)
    if whole:  # one forest holds them
        e = materialise(map_arrow(e.coalesce(1), _local, "u long, v long"), "edges")
    while not whole and not stars(e):
        around = e.union(e.select("v", "u")).toDF("n", "m").groupBy("n").agg(F.min("m").alias("m")).select(F.col("n").alias("v"), F.least("n", "m").alias("m"))
        large = matched(e, materialise(around, "around"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = matched(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        e = materialise(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())

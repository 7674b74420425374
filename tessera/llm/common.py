"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship, shared_root

#: Texts are worked on in slices of about so many characters, which bounds a Python worker's memory whatever the Arrow batch size.
SLICE_CHARS = 2_000_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while this package writes a table: the default is for short rows.
BATCH_ROWS = 2000
#: Whether a query's shuffle files go when it has ended: by default they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrays up to the first size come from the heap, and the heap keeps so much of what is freed while a task runs: by default
#: arrays of a few hundred kilobytes go back to the machine at once, and each new one costs a page fault a page.
HEAP_ARRAY, HEAP_SLACK = 4 << 20, 16 << 20


def file_system(path: str):
    """(pyarrow file system, path in it) of a folder any Hadoop-style URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


@contextmanager
def while_writing(spark: SparkSession):
    """Short batches and no shuffle files that outlive the write; the session's own settings hold again afterwards."""
    own, cleanup = spark.conf.get(BATCH), spark.conf.get(CLEANUP, "false")
    if not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(BATCH, own)
        spark.conf.set(CLEANUP, cleanup)


def materialise(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    with while_writing(spark):
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts as str) in slices of bounded text size; a text over the size is a slice of its own."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        start, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            text = col[i].as_py() or ""
            if texts and size + len(text) > chars:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(start), texts


class Worker:
    """What a Python worker keeps between tasks: for one owner at a time, so that operators that follow each other don't add up."""

    owner: str | None = None
    kept: dict = {}


def trim() -> None:
    """Gives freed memory back to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def kept(owner: str, key, make: Callable):
    """make()'s value, once a worker; what other owners kept is freed first."""
    if Worker.owner != owner:
        Worker.kept.clear()
        Worker.owner = owner
        gc.collect()
        trim()
    if key not in Worker.kept:
        Worker.kept[key] = make()
    return Worker.kept[key]


def hold() -> None:
    """Has the allocator keep freed arrays for the next ones; trim() gives them back."""
    import ctypes

    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, HEAP_ARRAY)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, HEAP_SLACK)  # M_TRIM_THRESHOLD


def lean(fn: Callable) -> Callable:
    """fn with Arrow's memory from the system's allocator, and what it freed given back when a task ends."""

    def run(batches):
        if pa.default_memory_pool().backend_name != "system":
            pa.set_memory_pool(pa.system_memory_pool())
            hold()
        yield from fn(batches)
        trim()

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(lean(fn), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

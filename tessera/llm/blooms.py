"""Keeping the rows whose id is wanted: by a broadcast Bloom filter up to a checked size, by a semi-join beyond."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BLOCK_BITS = 1 << 18
MOST_BITS = 1 << 27
#: Ids that may be broadcast as such: 32 MB of hashed relation at most.
BROADCAST_ROWS = 1_000_000
#: The same of rows of a few columns of fixed width.
MATCHED_ROWS = 200_000
BITS_A_KEY = 16
#: Streams that the parts of one block are dealt to before their results meet.
MERGED = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: one to one, every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed_one(x: int) -> int:
    """mixed() of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.astype(np.int64).view(np.uint64))
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def bloom(ids: DataFrame) -> np.ndarray | None:
    """The filter of a one-column table of longs as bytes, or None if there are too many for MOST_BITS."""
    n = ids.count()
    bits = max(BLOCK_BITS, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length())
    if bits > MOST_BITS:
        return None

    def fill(batches):
        own = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in places(np.asarray(batch.column(0)), bits):
                at = at.astype(np.int64)
                np.bitwise_or.at(own, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        blocks = own.reshape(-1, BLOCK_BITS // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([blocks[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])

    parts = combined(map_arrow(ids, fill, "block long, bits binary"), "u1", np.bitwise_or).collect()  # bits // BLOCK_BITS rows, MOST_BITS in all
    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), dtype=np.uint8)
    for block, data in parts:
        out[block] = np.frombuffer(bytes(data), dtype=np.uint8)
    return out.reshape(-1)


def combined(parts: DataFrame, dtype: str, both: Callable) -> DataFrame:
    """(block, bits) with all parts of a block made one by both(x, y). In two levels, and streams that hold one part, so that tasks don't add up in memory."""

    def fold(batches):
        last = held = None
        for batch in batches:
            blocks, out = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), []
            for key, data in zip(blocks, batch.column(2), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype=dtype)
                if key != last:
                    if last is not None:
                        out.append((*last, held.tobytes()))
                    last, held = key, x.copy()
                else:
                    held = both(held, x)
            yield _rows(out)
        if last is not None:
            yield _rows([(*last, held.tobytes())])

    schema = "block long, salt int, bits binary"
    level = parts.select(F.col("block").cast("long").alias("block"), F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("salt"), "bits")
    for keys in (["block", "salt"], ["block"]):
        level = map_arrow(level.repartition(*keys).sortWithinPartitions(*keys).select("block", "salt" if len(keys) > 1 else F.lit(0).alias("salt"), "bits"), fold, schema)
    return level.select("block", "bits")


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "salt", "bits"])


def may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for at in places(keys, len(filter_) * 8):
        at = at.astype(np.int64)
        out &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def few(ids: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table of short rows may be broadcast."""
    return ids.count() <= most


def wanted(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose column is in ids (one column of distinct longs, written; nulls match nothing), perhaps with a few others.

    Few ids are broadcast; more are a Bloom filter of bounded size; beyond that the two are shuffled.
    """
    ids = ids.toDF(column).where(F.col(column).isNotNull())
    if few(ids):
        return rows.join(F.broadcast(ids), column, "left_semi").select(*rows.columns)
    found = bloom(ids)
    if found is None:
        return rows.join(ids.hint("shuffle_merge"), column, "left_semi").select(*rows.columns)
    shared = rows.sparkSession.sparkContext.broadcast(found)
    place = rows.columns.index(column)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, np.asarray(batch.column(place).fill_null(0)))))

    return map_arrow(rows, keep, rows.schema)


def less(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose column isn't in ids (one column of distinct values, written); rows with a null stay. Few ids are broadcast, so that the rows aren't shuffled."""
    return rows.join(F.broadcast(ids) if few(ids) else ids, column, "left_anti")


def matched(rows: DataFrame, some: DataFrame, on: str) -> DataFrame:
    """rows joined with some (a written table, one row for each value of `on`): broadcast while it is few, else by a merge join whose skewed sides Spark can split."""
    return rows.join(F.broadcast(some) if few(some, MATCHED_ROWS) else some.hint("shuffle_merge"), on)

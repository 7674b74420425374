"""Best-fit packing of documents into sequences of a fixed capacity, by large-item matching.

Only piece lengths decide a packing, and there are at most `capacity` of them. So the
plan is made on the histogram of lengths (at most `capacity` rows reach the driver,
whatever the corpus): runs of equal pieces go to runs of equal sequences.

1. Pieces above a third of the capacity go at most twice into a sequence. From the
   longest down, each takes the longest other such piece that still fits beside it.
2. Shorter ones, from the longest down, go where they leave the least room (best fit).

Each run is (length, first rank, count, first sequence, offset): the pieces of that
length with those ranks are in those sequences. Ranks within a length are counted in
salted buckets, so a length that half of all pieces share is no hot key.

Edge cases: null text is empty and so one end id; a document over the capacity is cut
from its end, so that its first piece may be shorter; equal documents are ranked by
doc_id, piece and checksum; an empty table gives no sequence.
"""

from __future__ import annotations

import bisect
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shuffle_partitions, slices, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row string, ids binary"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Documents' ids cut into pieces; ids are little-endian, as wide as the vocabulary needs."""

    def cut(batches):
        from .encoding import encoder

        enc = encoder(tokenizer)
        width, end = enc.dtype.itemsize, np.array([end_id], dtype=enc.dtype).tobytes()
        for batch, texts in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                ids += end
                own = uuid.uuid4().hex  # tells rows with the same doc_id apart
                for k, (s, n) in enumerate(cuts(len(ids) // width, capacity)):
                    part = ids[s * width : (s + n) * width]
                    rows.append((doc_id, k, s, n, zlib.crc32(np.frombuffer(part, dtype=enc.dtype).astype("<u4").tobytes()), own, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "ids"])

    return map_arrow(texts_of(docs), cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) for these counts of lengths."""
    runs: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths are from 1 to the capacity")
    rank = dict.fromkeys(left, 0)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, count)
    free: list[int] = []  # rooms there are, ascending
    used = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room and room not in rooms:
            bisect.insort(free, room)
        if room:
            rooms.setdefault(room, []).append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        b = next((n for n in reversed(large[: bisect.bisect_right(large, capacity - a)]) if left[n] > (n == a)), 0)
        count = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, count, used, 0)
        if b:
            put(b, count, used, a)
        leave(capacity - a - b, used, count)
        used += count
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(free, n)
            if k == len(free):
                count = -(-left[n] // (capacity // n))
                leave(capacity, used, count)
                used += count
                continue
            room = free[k]
            first, count = rooms[room].pop()
            take = min(count, left[n])
            if take < count:
                rooms[room].append((first + take, count - take))
            if not rooms[room]:
                del rooms[room]
                free.pop(k)
            put(n, take, first, capacity - room)
            leave(room - n, first, take)
    return runs


def ranked(lengths: DataFrame, salts: int) -> DataFrame:
    """Adds rank: 0, 1, ... within each length. lengths has doc_id, piece, length, ids_crc32."""
    salted = lengths.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most `salts` rows
    starts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    inner = salted.withColumn("own", F.row_number().over(own) - 1)
    return inner.join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("own")).drop("first", "own", "salt")


def assign(pieces_: DataFrame, capacity: int, salts: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to pieces that can be read again (a written table)."""
    spark = pieces_.sparkSession
    histogram = {r[0]: r[1] for r in pieces_.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)  # runs: bounded by the lengths, not by the corpus
    names = [f.name for f in pieces_.schema.fields if f.name not in ("ids", *without)]
    table = ranked(pieces_.select(*names), salts or 4 * shuffle_partitions(spark))

    def place(batches):
        table_ = shared.value
        key = table_[:, 0] << 40 | table_[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            run = table_[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_.schema.fields if f.name in names)
    return map_arrow(table, place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The ids are in the pieces' table, written once."""
    return assign(materialise(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, without=("row",))


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, doc_ids, starts (of their documents' pieces) and ids. A sequence's pieces are at most `capacity`, which bounds each group."""
    written = materialise(pieces(docs, tokenizer, end_id, capacity), "pieces")
    placed = assign(written, capacity).select("row", "piece", "sequence_id", "offset")
    joined = written.join(placed, ["row", "piece"]).select("sequence_id", F.struct("offset", "doc_id", "start", "length", "ids").alias("x"))
    grouped = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("sequence_id", F.aggregate("x.length", F.lit(0).cast("long"), lambda a, b: a + b).alias("length"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets"), F.col("x.start").alias("starts"), F.expr("aggregate(x.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))

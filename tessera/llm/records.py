"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is: length (u64), masked checksum of those 8 bytes (u32), payload, masked
checksum of the payload (u32), all little-endian. The mask is ((c >> 15) | (c << 17)) +
0xA282EAD8 over zlib's CRC-32, so that a checksum inside a payload isn't mistaken for
its own. The payload is doc_id (i64), 1 if that is null else 0 (u8), bytes an id takes
(u8), ids. `<file>.idx` has 24 bytes a record: doc_id, byte offset, number of ids, each
i64; readers that shuffle seek by it.

Files are dealt by doc_id range, so file order is doc_id order. A task writes to a name
of its own attempt, and its row in the manifest (a Parquet table, committed by Spark
once per task) is what makes the file part of the data set: lost executors, retries and
speculative copies leave unlisted files only.

Edge cases: null text is empty; null doc_id sorts first and reads back as null; equal
doc_ids are ordered by text; an empty table gives an empty manifest; a document without
words is the end id alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, map_arrow, shuffle_partitions, slices, texts_of

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
LEAD = struct.Struct("<qBB")
MANIFEST = "part int, file string, records long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(zlib.crc32(size))) + payload + TAIL.pack(masked(zlib.crc32(payload)))


class BadRecord(ValueError):
    pass


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a file, in order; BadRecord where a checksum or length doesn't hold."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise BadRecord("cut short in a header")
        size, crc = HEAD.unpack(head)
        if crc != masked(zlib.crc32(head[:8])):
            raise BadRecord("length checksum")
        body = stream.read(size + TAIL.size)
        if len(body) < size + TAIL.size:
            raise BadRecord("cut short in a payload")
        payload = body[:size]
        if TAIL.unpack(body[size:])[0] != masked(zlib.crc32(payload)):
            raise BadRecord("payload checksum")
        yield payload


def payload_of(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return LEAD.pack(doc_id or 0, doc_id is None, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = LEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=LEAD.size)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, files: int | None = None) -> DataFrame:
    """Encodes docs and writes them below path; gives the manifest (one row a file), read from its table."""
    spark = docs.sparkSession
    dealt = texts_of(docs).repartitionByRange(files or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        from pyspark import TaskContext

        from .encoding import encoder

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], dtype=enc.dtype).tobytes()
        out = index = None
        records = tokens = place = 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        for batch, texts in slices(batches):
            if out is None:
                system, root = file_system(path)
                system.create_dir(root, recursive=True)
                out, index = system.open_output_stream(f"{root}/{name}", compression=None), system.open_output_stream(f"{root}/{name}.idx", compression=None)
            entries = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                ids += end
                record = frame(payload_of(doc_id, enc.dtype.itemsize, ids))
                out.write(record)
                n = len(ids) // enc.dtype.itemsize
                entries.append((doc_id or 0, place, n))
                place += len(record)
                tokens += n
            records += len(entries)
            index.write(np.array(entries, dtype="<i8").tobytes())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "records": records, "tokens": tokens, "bytes": place}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    map_arrow(dealt, write, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over 32-bit ids), and the ids if asked for; every checksum is verified."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    listed = manifest(spark, path).withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "start")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if keep_ids else [])])

    def read(batches):
        system, root = file_system(path)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                with system.open_input_stream(f"{root}/{file}", compression=None, buffer_size=1 << 20) as stream:
                    for payload in unframe(stream):
                        doc_id, ids = unpack(payload)
                        row = {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                        rows.append(row | {"ids": ids.astype(np.int64)} if keep_ids else row)
                        start += len(ids)
                        size += len(ids) if keep_ids else 1
                        if size > 1_000_000 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_arrow(listed.repartition(shuffle_partitions(spark)), read, READ + (", ids array<long>" if keep_ids else ""))


class ShuffledReader:
    """Records of a data set in any order, by the offset indexes: for a loader's own process."""

    def __init__(self, path: str, files: list[str]):
        self.system, self.root = file_system(path)
        self.files = files
        self.index = [np.frombuffer(self._bytes(f"{f}.idx"), dtype="<i8").reshape(-1, 3) for f in files]
        self.ends = np.cumsum([len(x) for x in self.index])

    def _bytes(self, file: str) -> bytes:
        with self.system.open_input_file(f"{self.root}/{file}") as f:
            return f.read()

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        k = int(np.searchsorted(self.ends, i, side="right"))
        place = int(self.index[k][i - (self.ends[k - 1] if k else 0), 1])
        with self.system.open_input_file(f"{self.root}/{self.files[k]}") as f:
            f.seek(place)
            return unpack(next(unframe(f)))

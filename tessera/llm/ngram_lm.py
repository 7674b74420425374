"""Character n-gram models of order 4 by language: counted by Spark, modified Kneser-Ney, stored as sorted hash arrays.

Symbols are UTF-16 units, so a 4-gram is 64 bits and its key is exact; texts begin with
three line feeds. All n-grams of all texts are counted (per task in sorted arrays, then by
Spark). Orders below the highest count the distinct symbols before an n-gram, each order
and language has the three discounts of modified Kneser-Ney, and orders interpolate down
to the uniform distribution. The estimates are joins and aggregations of the count table.

The model is a folder of Parquet parts: (lang, part, hash, value), ranged and sorted by
those. `part` is 2 n for log p of an n-gram and 2 n + 1 for the log of the back-off weight
of a context of n symbols; the hash is a bijection of the key, hence spread evenly, and a
lookup is a guess by the leading bits and a short walk. Workers load a language's arrays
when they first meet it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blooms import mixed, mixed_one
from .common import kept, map_arrow, materialise, shuffle_partitions, slices, texts_of, work_path

ORDER = 4
#: 4-grams of a language that a task sorts at once: bounds its memory.
MERGE_AT = 1_000_000
LOW = [(1 << (16 * n)) - 1 for n in range(4)]
TOP = (1 << 64) - 1


def units(text: str) -> np.ndarray:
    return np.frombuffer(("\n\n\n" + text).encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64)


def grams(u: np.ndarray) -> np.ndarray:
    """Keys of the 4-grams that end at each symbol after the three pads."""
    return u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) of all 4-grams of all texts. docs: doc_id, text, lang (null: empty)."""

    def count(batches):
        held: dict[str, list] = {}
        fresh: dict[str, list] = {}
        size: dict[str, int] = {}

        def settle(lang):
            if fresh.get(lang):
                held[lang] = [merged([*held.get(lang, []), distinct(np.concatenate(fresh[lang]))])]
            fresh[lang], size[lang] = [], 0

        for batch, texts in slices(batches):
            for lang, text in zip(batch.column(2).to_pylist(), texts, strict=True):
                if text:
                    g = grams(units(text))
                    fresh.setdefault(lang, []).append(g)
                    size[lang] = size.get(lang, 0) + len(g)
                    if size[lang] >= MERGE_AT:
                        settle(lang)
        for lang in list(fresh):
            settle(lang)
            keys, n = held[lang][0]
            for s in range(0, len(keys), 100_000):
                part = keys[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[s : s + 100_000].astype(np.int64))], names=["lang", "key", "n"])

    rows = map_arrow(texts_of(docs, F.coalesce("lang", F.lit("")).alias("lang")), count, "lang string, key long, n long")
    return materialise(rows.groupBy("lang", "key").agg(F.sum("n").alias("n")), "grams")


def _discounts(table: DataFrame) -> DataFrame:
    n = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw = [i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    d = [F.when(x.isNull(), 0.5 * i).otherwise(F.least(F.greatest(x, F.lit(0.05)), F.lit(float(i)))).alias(f"d{i}") for i, x in enumerate(raw, 1)]
    return table.groupBy("lang").agg(*n).select("lang", *d)


def _order(table: DataFrame, lower: DataFrame | None, n: int) -> DataFrame:
    """(lang, key, context, p, gamma) of one order's counts; lower: (lang, key, p) of the order below."""
    context = F.shiftrightunsigned("key", 16) if n > 1 else F.lit(0).cast("long")
    rows = table.withColumn("context", context).join(F.broadcast(_discounts(table)), "lang")  # a row a language
    of = Window.partitionBy("lang", "context")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    total = F.sum("n").over(of)
    rows = rows.select("lang", "key", "context", (F.greatest(F.col("n") - d, F.lit(0.0)) / total).alias("own"), (F.sum(F.least(d, F.col("n"))).over(of) / total).alias("gamma"), F.count("*").over(of).alias("types"))
    if lower is None:
        return rows.select("lang", "key", "context", (F.col("own") + F.col("gamma") / (F.col("types") + 1)).alias("p"), "gamma")
    below = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("p_"))
    return rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit(LOW[n - 1]))).join(below, ["lang", "suffix"]).select("lang", "key", "context", (F.col("own") + F.col("gamma") * F.col("p_")).alias("p"), "gamma")


def train(docs: DataFrame) -> str:
    """Counts docs (doc_id, text, lang), estimates, and writes the model; gives its folder."""
    spark = docs.sparkSession
    tables = {ORDER: counts(docs)}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = materialise(tables[n + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(LOW[n])).alias("key")).agg(F.count("*").alias("n")), f"grams{n}")
    lower, parts = None, []
    for n in range(1, ORDER + 1):
        rows = materialise(_order(tables[n], lower, n), f"order{n}")
        parts.append(rows.select("lang", F.lit(2 * n).alias("part"), "key", F.log("p").alias("value")))
        parts.append(rows.groupBy("lang", "context").agg(F.max("gamma").alias("gamma")).select("lang", F.lit(2 * (n - 1) + 1).alias("part"), F.col("context").alias("key"), F.log(F.greatest("gamma", F.lit(1e-12))).alias("value")))
        lower = rows.select("lang", "key", "p")
    model = parts[0]
    for p in parts[1:]:
        model = model.union(p)

    def hash_(batches):
        for b in batches:
            h = mixed(np.asarray(b.column(2)).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h), b.column(3).cast(pa.float32())], names=["lang", "part", "hash", "value"])

    path = work_path(spark, "model")
    cols = ["lang", "part", "hash"]
    map_arrow(model, hash_, "lang string, part int, hash long, value float").repartitionByRange(shuffle_partitions(spark), *cols).sortWithinPartitions(*cols).write.parquet(path)
    return path


class SortedHashes:
    """Ascending 64-bit hashes and their values. find() gives places, -1 where absent."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.append(values[order].astype(np.float32), np.float32(0))
        bits = max(1, int(len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.first[(h >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        return np.where(self.hashes[at] == h, at, -1)

    def value(self, h: int) -> float | None:
        """find() and the value of one hash: arrays of one cost far more than they hold."""
        at = int(self.first[h >> int(self.shift)])
        while (own := int(self.hashes[at])) < h:
            at += 1
        return float(self.values[at]) if own == h else None


class Model:
    def __init__(self, parts: dict[int, SortedHashes]):
        self.parts = parts
        floor = parts.get(2)
        self.unseen = float(floor.values[:-1].min()) if floor is not None and len(floor.values) > 1 else -20.0

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """ln p of each 4-gram's last symbol; absent n-grams back off."""
        out = np.zeros(len(keys), dtype=np.float64)
        rest = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            k = keys[rest] & np.uint64(LOW[n]) if n < ORDER else keys[rest]
            part = self.parts.get(2 * n)
            at = part.find(mixed(k)) if part is not None else np.full(len(k), -1)
            found = at >= 0
            out[rest[found]] += part.values[at[found]] if part is not None else 0
            rest, k = rest[~found], k[~found]
            if not len(rest):
                return out
            back = self.parts.get(2 * (n - 1) + 1)
            if back is not None:
                at = back.find(mixed(k >> np.uint64(16)))
                out[rest] += np.where(at >= 0, back.values[at], 0)
        out[rest] += self.unseen
        return out

    def log_p_of(self, key: int) -> float:
        """log_p of one 4-gram."""
        out = 0.0
        for n in range(ORDER, 0, -1):
            key &= LOW[n] if n < ORDER else TOP
            part, back = self.parts.get(2 * n), self.parts.get(2 * (n - 1) + 1)
            if part is not None and (value := part.value(mixed_one(key))) is not None:
                return out + value
            if back is not None:
                out += back.value(mixed_one(key >> 16)) or 0.0
        return out + self.unseen


def load(path: str, lang: str) -> Model:
    """A worker's model of one language; a language the model doesn't have gives one without n-grams."""

    def read() -> Model:
        import pyarrow.dataset as ds

        from .common import file_system

        system, root = file_system(path)
        table = ds.dataset(root, filesystem=system, format="parquet", exclude_invalid_files=False).to_table(filter=ds.field("lang") == lang, columns=["part", "hash", "value"])
        part, hashes, values = (table.column(c).to_numpy() for c in ("part", "hash", "value"))
        return Model({int(p): SortedHashes(hashes[part == p].view(np.uint64), values[part == p]) for p in np.unique(part)})

    return kept(path, lang, read)


"""Near-duplicate documents by exact Jaccard similarity of word shingles: a rare-first prefix join.

1. Every document's set of k-word shingles (64-bit hashes); equal sets are one node from
   here on. One pass also counts, in a fixed-size sketch, how often shingles occur.
2. Shingles are ordered by (sketch count, hash): rare first. Two sets of the wanted
   similarity share a shingle within their prefixes of n - ceil(t n) + 1 shingles, so
   prefixes alone are joined. Any total order gives all links; a good one gives few
   candidates, and what very many documents share lies in no prefix.
3. Candidates must pass the length filter (sizes within t) and the positional filter (what
   is left after the shared shingle can still reach the overlap needed), and the suffix
   filter (the sizes between fixed probes bound the overlap). Those left are verified
   once, by the exact overlap of the full sets, which only they are made again for.
4. links.Resolver joins verified links to components; links() gives each of them instead.

Edge cases: without words or text the set is empty and the document is linked with
nothing, its own component; with fewer than k words the whole sequence is one shingle;
repeated rows give a row each; a set that only rows without a doc_id have is linked with
nothing, and their component_id is null; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blooms import combined, less, mixed, wanted
from .common import kept, map_arrow, materialise, slices, texts_of
from .links import PAIRS, Resolver, shared, sifter, spread

SKETCH_BITS = 21
SKETCH_BLOCKS = 512
#: Sets that a task remembers to have given.
SEEN = 200_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class Shingles:
    """A text's set of k-word shingles as ascending 64-bit hashes; A-Z are lower-cased and words end at ASCII white space."""

    def __init__(self, k: int, most: int = 150_000):
        from .encoding import Memo

        self.k = k
        self.words = Memo(self._word, most)

    @staticmethod
    def _word(word: bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word)

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        n = len(words)
        if not n:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        if n < self.k:
            return mixed(np.array([np.bitwise_xor.reduce(h * ODD[:n]) + np.uint64(n)], dtype=np.uint64)) if n <= len(ODD) else mixed(np.array([np.sum(h * (2 * np.arange(n, dtype=np.uint64) + np.uint64(3)))]))
        out = h[: n - self.k + 1] * ODD[0]
        for i in range(1, self.k):
            out = out ^ (out >> np.uint64(29))
            out += h[i : n - self.k + 1 + i] * ODD[i % len(ODD)]
        return np.unique(mixed(out))


def shingler(k: int) -> Shingles:
    """One per worker and k."""
    return kept("shingles", k, lambda: Shingles(k))


def signature(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def scan(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, node, spread) of every document, written, and the sketch (a fixed 2**SKETCH_BITS counters)."""

    def count(batches):
        own, sets = np.zeros(1 << SKETCH_BITS, dtype=np.int64), shingler(k)
        for batch, texts in slices(batches):
            ids, sizes, nodes, all_, spreads = batch.column(0), [], [], [], []
            for text in texts:
                s = sets.of(text)
                sizes.append(len(s))
                nodes.append(signature(s) if len(s) else None)
                all_.append(s)
                spreads.append(spread(s))
            own += np.bincount((np.concatenate(all_) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(own))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(texts), pa.int32()), pa.array(spreads, pa.binary())], names=["doc_id", "n_shingles", "node", "block", "counts"])
        if own.any():
            blocks = own.astype("<u4").reshape(SKETCH_BLOCKS, -1)
            none = pa.nulls(SKETCH_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["doc_id", "n_shingles", "node", "block", "counts"])

    rows = materialise(map_arrow(texts_of(docs), count, "doc_id long, n_shingles long, node long, block int, counts binary"), "shingles")
    sketch = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), dtype=np.uint32)
    parts = rows.where("block is not null").select("block", F.col("counts").alias("bits"))
    for block, counts in combined(parts, "<u4", lambda x, y: np.minimum(x.astype(np.uint64) + y, 0xFFFFFFFF).astype("<u4")).collect():  # SKETCH_BLOCKS rows of fixed size
        sketch[block] = np.frombuffer(bytes(counts), dtype="<u4")
    sketch = np.minimum(sketch, 0xFFFF).astype(np.uint16)
    return rows.where("block is null").select("doc_id", "n_shingles", "node", F.col("counts").alias("spread")), sketch.reshape(-1)


def prefixes(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(key, node, size, pos) of every distinct set's prefix; a task gives a set once, other tasks may give it again."""
    ranks = docs.sparkSession.sparkContext.broadcast(sketch)  # fixed size

    def emit(batches):
        sets, seen, counts = shingler(k), set(), ranks.value
        for _, texts in slices(batches):
            keys, nodes, sizes, at = [], [], [], []
            for text in texts:
                s = sets.of(text)
                n = len(s)
                if not n or (node := signature(s)) in seen:
                    continue
                seen.add(node)
                p = n - -(-num * n // den) + 1
                if len(seen) > SEEN:
                    seen.clear()
                order = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(47) | s >> np.uint64(17)
                order.sort()
                keys.append(order[:p])
                nodes.append(np.full(p, node, dtype=np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
                at.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (nodes, sizes, at))], names=["key", "node", "size", "pos"])

    return map_arrow(texts_of(docs), emit, "key long, node long, size int, pos int")


def possible(num: int, den: int):
    def fits(x, y) -> Column:
        length = (den * F.least(x("size"), y("size")) >= num * F.greatest(x("size"), y("size")))
        most = F.least(x("pos"), y("pos")) + 1 + F.least(x("size") - x("pos"), y("size") - y("pos")) - 1
        return length & (most * (num + den) >= num * (x("size") + y("size")))

    return fits


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verifier(num: int, den: int):
    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                need = -(-num * (len(a) + len(b)) // (num + den))
                keep.append(den * min(len(a), len(b)) >= num * max(len(a), len(b)) and overlap(a, b) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lambda pairs: map_arrow(pairs, check, PAIRS)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(node, data) of documents' sets, once a task."""

    def emit(batches):
        sets, seen = shingler(k), set()
        for _, texts in slices(batches):
            rows = []
            for text in texts:
                s = sets.of(text)
                if len(s) and (node := signature(s)) not in seen:
                    seen.add(node)
                    rows.append((node, s.tobytes()))
            if len(seen) > SEEN:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "data"])

    return map_arrow(docs, emit, "node long, data binary")


def resolver(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, Resolver]:
    """(a row a document; spreads and first doc_id of the sets that share a prefix shingle; what verifies their pairs)."""
    listed, sketch = scan(docs, k)
    buckets = materialise(shared(prefixes(docs, k, num, den, sketch)).distinct(), "buckets")
    near = buckets.select("node").distinct()
    spreads = materialise(listed.join(near, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("spread").alias("spread")), "spreads")

    def fetch(nodes: DataFrame) -> DataFrame:
        ids = materialise(spreads.join(nodes, "node", "left_semi").select("first").distinct(), "firsts")
        some = sets_of(wanted(texts_of(docs), ids, "doc_id"), k)
        return some.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def marks(nodes: DataFrame) -> DataFrame:
        return wanted(spreads.select("node", "spread"), nodes, "node")

    return listed, spreads, Resolver(buckets, verifier(num, den), marks, num, den, fetch=fetch, possible=possible(num, den), sift=sifter(spreads.select("node", "spread"), num, den))


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included)."""
    listed, spreads, found = resolver(docs, k, num, den)
    sets = listed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = found.components().join(spreads.select("node", "first"), "node")
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(smallest, "component").select("node", "smallest")
    of = sets.join(named, "node", "left").select("node", F.coalesce("smallest", "first").alias("component_id"))
    return listed.join(of, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(a, b, n_a, n_b): every link between different sets, each once, by their first doc_ids, and how many documents have either set.

    Copies count in n_a and n_b and aren't expanded. A group of many near copies has a link for each of its pairs.
    """
    listed, spreads, found = resolver(docs, k, num, den)
    sets = materialise(listed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("first").alias(f"first_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    both = found.all_links().join(x, "a").join(y, "b")
    swap = F.col("first_a") > F.col("first_b")
    pick = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
    return both.select(pick("first_a", "first_b").alias("a"), pick("first_b", "first_a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows that aren't the first of their component; of rows with the same doc_id and component all stay."""
    found = components(docs, k, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return less(docs, materialise(found, "copies"), "doc_id")

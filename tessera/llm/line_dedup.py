"""Fuzzy line deduplication over all documents: MinHash bands, exact verification, one line per component.

Lines are what line feeds separate. They are compared lower-cased, with runs of spaces and
tabs as one space, from `min_chars` characters on: with 1, which is what the query and the
pipeline take, all that aren't blank. Lines shorter than a shingle only have exact copies.

1. A line's set of character shingles gives a one-permutation MinHash signature, empty
   bins being filled from the next one. Bands of its bins are candidate buckets; with
   rows r and bands b two lines of similarity s meet with probability 1 - (1 - s**r)**b.
2. Candidates whose spreads (how many shingles lie in each of equal ranges of hashes) rule
   a link out are dropped without their texts. links.Resolver verifies the others by the
   exact Jaccard similarity of the shingle sets and joins them, by distributed union-find;
   those of wide buckets in the task that finds them, which gives the joining links only.
3. Of each component the first line (smallest doc_id, then place) stays, also among
   exact copies, and the others go.

Edge cases: null text stays null; blank lines and those under `min_chars` stay; a document all of whose
lines go has an empty text; rows with the same doc_id count as one document, whose lines
have the same fate in each; with a null doc_id lines neither stay for others nor go; an
empty table gives none; other columns pass through `deduplicate` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blooms import few, matched, mixed, wanted
from .common import kept, map_arrow, materialise, slices, texts_of
from .links import MANY, PAIRS, Resolver, shared_keys, sifter

SHINGLE, ROWS, BANDS = 6, 4, 10
#: Lines that a task remembers to have given.
SEEN = 300_000
#: Lines or pairs sorted at once: their number takes PAIR_BITS of 64, a shingle's hash the others.
PAIR_BITS = 11
HASH_BITS = 64 - PAIR_BITS
#: Lines that may be broadcast as lists by document.
BROADCAST_LINES = 1_000_000
#: Ranges of hashes in a line's spread, for which wide buckets are compared, and in its mark, which is moved with every candidate.
SPREAD_BITS, MARK_BITS = 8, 6
#: Parts that a line's band keys are counted in: a shuffle holds one of them at a time.
KEY_PARTS = 2
#: Characters hashed at once.
STRETCH = 100_000
EMPTY, NONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint32(0xFFFFFFFF)
PRIME = np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def plain(line: str) -> str:
    """A lower-cased line without outer or repeated spaces and tabs."""
    if "  " in line or "\t" in line or line[:1] == " " or line[-1:] == " ":
        return " ".join(x for x in line.replace("\t", " ").split(" ") if x)
    return line


def lines_of(text: str, min_chars: int) -> list[tuple[int, str]]:
    """(place, line as it is compared) of the lines that are long enough."""
    return [(i, p) for i, line in enumerate(text.lower().split("\n")) if len(line) >= min_chars and len(p := plain(line)) >= min_chars and not p.isspace()]


def line_node(line: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k code points, from those of windows half as long."""
    part, size, out, done = codes.astype(np.uint64), 1, None, 0
    while size <= k:
        if k & size:
            if out is None:
                out = part
            elif len(out) > done:
                both = out[: len(part) - done] * ODD[0]
                both += part[done : len(out)]
                out = both
            else:
                out = out[:0]
            done += size
        if 2 * size <= k:
            if len(part) > size:
                both = part[: len(part) - size] * ODD[1]
                both += part[size:]
                both ^= both >> np.uint64(29)
                part = both
            else:
                part = part[:0]
        size *= 2
    return mixed(out[: max(0, len(codes) - k + 1)])


def within(ends: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n windows of k end within the line they begin in. Lines have k characters at least, or all of their windows are dropped."""
    out = np.ones(n, dtype=bool)
    for j in range(1, k):
        at = ends - j
        out[at[(at >= 0) & (at < n)]] = False
    return out


def shingle_set(line: str, k: int = SHINGLE) -> np.ndarray:
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.unique(rolled(codes, k)) if len(codes) >= k else rolled(codes, max(1, len(codes)))


def flat_sets(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sets of all lines one after another, ascending, by the upper HASH_BITS of shingle_set()'s hashes. One sort for many lines."""
    flat, sizes = [], []
    for part in stretches(lines):
        n = np.array([len(x) for x in part])
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h = rolled(codes, k)
        line = np.repeat(np.arange(len(part), dtype=np.uint64), n)[: len(h)]
        inside = within(np.cumsum(n), len(h), k)
        key = line[inside] << np.uint64(HASH_BITS) | h[inside] >> np.uint64(64 - HASH_BITS)
        if (n < k).any():  # a short line is one shingle
            few_ = np.flatnonzero(n < k)
            key = np.concatenate([key, few_.astype(np.uint64) << np.uint64(HASH_BITS) | np.concatenate([shingle_set(part[i], k)[:1] for i in few_]) >> np.uint64(64 - HASH_BITS)])
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        flat.append(key & np.uint64((1 << HASH_BITS) - 1))
        sizes.append(np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(part)))
    return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))


def stretches(lines: list[str], chars: int = STRETCH) -> Iterator[list[str]]:
    """Lines of so many characters in all, and 2**PAIR_BITS lines at most: they stay in a processor's cache."""
    part, size = [], 0
    for line in lines:
        part.append(line)
        size += len(line)
        if size >= chars or len(part) == 1 << PAIR_BITS:
            yield part
            part, size = [], 0
    if part:
        yield part


def bands(lines: list[str], k: int = SHINGLE, rows: int = ROWS, n_bands: int = BANDS) -> np.ndarray:
    """(lines, n_bands) band hashes. Every line has k code points at least."""
    bins = rows * n_bands
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    h = rolled(codes, k)
    low = np.minimum(h.astype(np.uint32), NONE - np.uint32(1))
    low[~within(ends, len(h), k)] = NONE  # windows over a line's end change no minimum
    slot = np.repeat(np.arange(len(lines)) * bins, sizes)[: len(h)]
    h >>= np.uint64(32)
    h *= np.uint64(bins)
    h >>= np.uint64(32)
    slot += h.view(np.int64)
    least = np.full(len(lines) * bins, NONE)
    np.minimum.at(least, slot, low)
    mins = np.where(least == NONE, EMPTY, least.astype(np.uint64)).reshape(-1, bins)
    open_ = np.flatnonzero((mins == EMPTY).any(axis=1))
    if len(open_):  # each bin without a hash takes that of the next one that has one, and how far away it is
        own = mins[open_]
        at = np.where(np.concatenate([own, own], axis=1) != EMPTY, np.arange(2 * bins), 2 * bins)
        after = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
        mins[open_] = np.take_along_axis(own, after % bins, axis=1) + ((after - np.arange(bins)).astype(np.uint64) << np.uint64(33))
    mins = mins.reshape(-1, n_bands, rows)
    out = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(lines), 1))
    for r in range(rows):
        out = mixed(out * PRIME + mins[:, :, r])
    return out


def lines_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line, node, keys) of every line that is long enough; keys are the bands, where a task meets a line that has a shingle for the first time."""

    def emit(batches):
        kept("lines", None, lambda: None)  # frees what the operator before has kept
        seen: set[int] = set()
        for batch, texts in slices(batches, chars=1_000_000):
            ids, at, nodes, first, new = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for i, line in lines_of(text, min_chars):
                    node = line_node(line)
                    ids.append(doc_id)
                    at.append(i)
                    nodes.append(node)
                    fresh = len(line) >= SHINGLE and node not in seen
                    first.append(fresh)
                    if fresh:
                        seen.add(node)
                        new.append(line)
            if len(seen) > SEEN:
                seen.clear()
            keys = np.concatenate([bands(part) for part in stretches(new)]).reshape(-1).view(np.int64) if new else np.empty(0, dtype=np.int64)
            mask = np.array(first, dtype=bool)
            ends = np.concatenate([[0], np.cumsum(mask * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys), mask=pa.array(~mask))], names=["doc_id", "line", "node", "keys"])

    return map_arrow(texts_of(docs).where("doc_id is not null"), emit, "doc_id long, line int, node long, keys array<long>")


def line_texts(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """(node, data, spread, mark) of the picked lines: data is the line as it is compared. picks: (doc_id, line, node), written; lines of a doc_id's rows are those of any of them that has the line."""
    lists = picks.groupBy("doc_id").agg(F.collect_list(F.struct("line", "node")).alias("picked"))
    lists = lists.select("doc_id", F.col("picked.line").alias("lines"), F.col("picked.node").alias("nodes"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lists) if few(picks, BROADCAST_LINES) else lists, "doc_id").where("text is not null")

    def emit(batches):
        for batch, texts in slices(batches):
            out = []
            for text, places, nodes in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lines = text.split("\n")
                for place, node in zip(places, nodes, strict=True):
                    if place < len(lines) and line_node(line := plain(lines[place].lower())) == node:  # not so in a row of the same id with another text
                        out.append((node, line))
            spread = spreads([x[1] for x in out])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array(c, pa.binary()) for c in ([x[1].encode("utf-8", "surrogatepass") for x in out], spread, marks(spread)))], names=["node", "data", "spread", "mark"])

    return map_arrow(rows.select("doc_id", "text", "lines", "nodes"), emit, "node long, data binary, spread binary, mark binary")


def pieces_of(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The sets of these lines, one after another."""
    n = sizes[which]
    starts = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def overlaps(flat: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes the sets of lines x[i] and y[i] share, for each i: one sort for many pairs."""
    out = []
    for at in range(0, len(x), 1 << PAIR_BITS):
        both = np.stack([x[at : at + (1 << PAIR_BITS)], y[at : at + (1 << PAIR_BITS)]], axis=1).reshape(-1)
        pair = np.repeat(np.arange(len(both), dtype=np.uint64) >> np.uint64(1), sizes[both])
        h = pair << np.uint64(HASH_BITS) | pieces_of(flat, sizes, both)
        h.sort()
        out.append(np.bincount((h[1:][h[1:] == h[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(both) // 2))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def alike(num: int, den: int):
    """Of texts as they are compared, which pairs are links."""

    def of(texts: list[bytes]):
        flat, sizes = flat_sets([d.decode("utf-8", "surrogatepass") for d in texts])

        def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            least, most = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
            near = np.flatnonzero(den * least >= num * most)
            keep = np.zeros(len(x), dtype=bool)
            keep[near] = (num + den) * overlaps(flat, sizes, x[near], y[near]) >= num * (least + most)[near]
            return keep

        return linked

    return of


def verifier(num: int, den: int):
    def check(batches):
        for batch in batches:
            place: dict[bytes, int] = {}
            x, y = (np.array([place.setdefault(d, len(place)) for d in batch.column(c).to_pylist()], dtype=np.int64) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(alike(num, den)([*place])(x, y)))

    return lambda pairs: map_arrow(pairs, check, PAIRS)


def spreads(lines: list[str]) -> list[bytes]:
    """The spread of each line's set, in 2**SPREAD_BITS ranges."""
    out = []
    for part in stretches(lines):
        flat, sizes = flat_sets(part)
        place = np.repeat(np.arange(len(part)), sizes) << SPREAD_BITS | (flat >> np.uint64(HASH_BITS - SPREAD_BITS)).astype(np.int64)
        out += [x.tobytes() for x in np.minimum(np.bincount(place, minlength=len(part) << SPREAD_BITS), MANY).astype(np.uint8).reshape(len(part), -1)]
    return out


def marks(spreads_: list[bytes]) -> list[bytes]:
    """Spreads, in 2**MARK_BITS ranges."""
    x = np.frombuffer(b"".join(spreads_), dtype=np.uint8).reshape(len(spreads_), 1 << MARK_BITS, 1 << SPREAD_BITS - MARK_BITS)
    return [m.tobytes() for m in np.minimum(x.sum(axis=2, dtype=np.int64), MANY).astype(np.uint8)]


def keys_of(listed: DataFrame) -> DataFrame:
    """The band keys of different lines, written. Keys of a band meet only their like, so each part of the bands is shuffled by itself."""
    size = BANDS // KEY_PARTS
    parts = [materialise(shared_keys(listed.where("keys is not null").select(F.explode(F.slice("keys", at + 1, size)).alias("key"), "node")), "keys") for at in range(0, BANDS, size)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def removals(docs: DataFrame, min_chars: int = 1, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, line, first_doc, first_line) of the lines that go, and of the line that stays for each."""
    listed = materialise(lines_table(docs, min_chars), "lines")
    banded = listed.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    buckets = materialise(wanted(banded, keys_of(listed), "key").distinct(), "buckets")
    near = materialise(buckets.select("node").distinct(), "near")
    picks = wanted(listed.where("keys is not null").select("doc_id", "line", "node"), near, "node").dropDuplicates(["node"])
    picks = materialise(picks, "picks")
    texts = materialise(line_texts(docs, picks), "texts")
    if texts.count() > picks.count():  # rows with the same doc_id
        texts = materialise(texts.dropDuplicates(["node"]), "texts")
    sift = sifter(texts.select("node", F.col("mark").alias("spread")), num, den)
    labels = Resolver(buckets, verifier(num, den), lambda nodes: wanted(texts.select("node", "spread", "data"), nodes, "node"), num, den, data=texts.select("node", "data"), sift=sift, mark_sifted=True, exact=alike(num, den)).components()

    # Only lines that occur again, as they are or as another of their component, can go: no others are joined.
    again = listed.groupBy("node").count().where("count > 1").select("node").join(labels, "node", "left_anti")
    fate = materialise(again.select("node", F.col("node").alias("component")).union(labels), "fates")
    some = materialise(matched(listed.select("doc_id", "line", "node"), fate, "node").select("doc_id", "line", "component"), "repeated")
    place = F.struct("doc_id", "line")
    firsts = some.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    gone = matched(some, materialise(firsts.select("component", "first"), "firsts"), "component").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
    return gone.select("doc_id", "line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))


def marks_of(places: Column) -> Column:
    """A byte for each place up to the last one of an ascending array: 1 for those in it, 0 for the others."""
    return F.array_join(F.transform(places, lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.lit("1"))), "").cast("binary")


def without_lines(text: Column, marks: Column) -> Column:
    """A text less its lines that are marked 1; in time linear in both, and without Python, whose batches would hold ten thousand whole texts."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: F.substring(marks, i + 1, F.lit(1)) != F.lit(b"1")), "\n")


def deduplicate(docs: DataFrame, min_chars: int = 1, num: int = 80, den: int = 100) -> DataFrame:
    """docs with their texts less the lines that go, and n_lines, n_removed."""
    found = materialise(removals(docs, min_chars, num, den).select("doc_id", "line"), "gone")
    gone = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("at"))
    gone = gone.select("doc_id", F.size("at").alias("_n"), marks_of(F.col("at")).alias("_gone"))
    joined = docs.join(F.broadcast(gone) if few(found, BROADCAST_LINES) else gone, "doc_id", "left")
    cut = F.when(F.col("_gone").isNotNull(), without_lines(F.col("text"), F.col("_gone")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    return joined.select(*[F.coalesce(cut, F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))

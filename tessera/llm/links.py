"""From candidate buckets to components of verified links, without the pairs within a bucket.

A bucket holds nodes any two of which might be linked. Only components are wanted, so a
link between nodes that are already joined needs no check:

1. Star rounds: each bucket pairs its nodes with one centre; distinct pairs are verified
   and joined. Copies of one thing fall together here, in pairs linear in the bucket.
   Rounds go on, with other centres and the buckets that still hold several components,
   as long as they find links.
2. Completion: buckets that still hold several components pair their nodes across those,
   so no link between different components is lost, and nothing is capped. Buckets of up
   to SMALL nodes are joined with themselves. Larger ones are cut into blocks of about
   WIDE nodes, and a task compares two blocks by their sets' spreads (how many hashes lie
   in each of equal ranges: two sets share no more of a range than the smaller has
   there), so that only pairs that can be links become rows; where nodes' data are short
   enough to move with them, it verifies those pairs too, and only links that join
   something become rows, fewer than there are nodes.

Each pair is verified once, whatever the number of buckets it shares.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blooms import few, matched, wanted
from .common import map_arrow, materialise
from .components import connected_components

PAIRS = "a long, b long"
Step = Callable[[DataFrame], DataFrame]
#: Which of pairs x[i], y[i] of numbered nodes are links; and what makes that of the nodes' data.
Linked = Callable[[np.ndarray, np.ndarray], np.ndarray]
Exact = Callable[[list[bytes]], Linked]
SMALL, WIDE = 3, 512
#: Star rounds at most, and the share of a round's pairs that must be links for another one to be worth while.
MOST_STARS, GAIN = 2, 0.3
#: Nodes of a key's block that are compared together with other keys', and pairs that are compared at once.
AT_ONCE, PAIRS_AT_ONCE = 64, 1 << 13
#: Pairs that a task verifies before it looks which others are still wanted; then twice as many.
EXACT_FIRST = 256
#: Ranges that spreads are compared by before their own ones.
ROUGH = 32
#: Ranges of hashes in a spread.
PROBE_BITS = 9
#: What a range says that holds as many or more.
MANY = 255


def spread(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of the equal ranges."""
    return np.minimum(np.bincount((hashes >> np.uint64(64 - PROBE_BITS)).astype(np.int64), minlength=1 << PROBE_BITS), MANY).astype(np.uint8).tobytes()


def spread_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def can_link(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether spreads x (one or a row each) and y (rows) allow a similarity of num / den; ranges that can't tell how many they have allow any."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    sizes = x.sum(axis=-1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
    return ((num + den) * most >= num * sizes) | (x == MANY).any(axis=-1) | (y == MANY).any(axis=1)


def sifter(spreads: DataFrame, num: int, den: int):
    """Drops pairs that can't be links by their spreads: two sets share no more of a range than the smaller has there. spreads: (node, spread)."""

    def check(batches):
        for batch in batches:
            keep = can_link(spread_matrix(batch.column(2)), spread_matrix(batch.column(3)), num, den) if batch.num_rows else np.empty(0, dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def sift(pairs: DataFrame) -> DataFrame:
        x, y = (spreads.select(F.col("node").alias(c), F.col("spread").alias(f"s{c}")) for c in ("a", "b"))
        return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb"), check, PAIRS)

    return sift


def wide_pairs(rows: DataFrame, num: int, den: int, exact: Exact | None = None) -> DataFrame:
    """(a, b) of different components within keys that may be linked, once a pair. rows: key, node, of, spread, n (nodes of the key), keys (all of the node, ascending).

    With exact, rows have data too, and (a, b) are links: as many as join what the pairs would, so fewer than there are rows.
    """
    data = ["data"] if exact else []
    n = F.greatest(F.ceil(F.col("n") / WIDE), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    below = F.slice("keys", F.lit(1), F.array_position("keys", F.col("key")).cast("int") - 1).alias("keys")  # what meet_first asks for
    dealt = rows.select("key", "node", "of", "spread", *data, below, own.alias("own"), other.alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "of", "spread", *data, "keys")

    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return map_arrow(dealt, block_pairs(num, den, exact), PAIRS)


def meet_first(keys: np.ndarray, ends: np.ndarray, key: int | np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether key (one for all, or one a node) is the smallest that nodes i[k] and j[k] share, for each k. Node i's keys are keys[ends[i] : ends[i + 1]], ascending; all have key, or only those before it."""
    below = keys < np.repeat(np.broadcast_to(key, len(ends) - 1), ends[1:] - ends[:-1])
    n = np.concatenate([[0], np.cumsum(below)])[ends]
    n = n[1:] - n[:-1]  # keys of each node under this one, which stand first
    out = np.ones(len(i), dtype=bool)
    some = np.flatnonzero((n[i] > 0) & (n[j] > 0))
    for s in range(0, len(some), 1 << 14):
        part = some[s : s + (1 << 14)]
        count = n[i[part]]
        pair = np.repeat(np.arange(len(part)), count)
        own = keys[np.repeat(ends[i[part]] - (np.cumsum(count) - count), count) + np.arange(len(pair))]
        at, to = ends[j[part]][pair], (ends[j[part]] + n[j[part]])[pair]
        while True:  # a step of all binary searches at once
            open_ = at < to
            if not open_.any():
                break
            mid = (at + to) >> 1
            less = open_ & (keys[np.minimum(mid, len(keys) - 1)] < own)
            at = np.where(less, mid + 1, at)
            to = np.where(open_ & ~less, mid, to)
        found = (at < (ends[j[part]] + n[j[part]])[pair]) & (keys[np.minimum(at, len(keys) - 1)] == own)
        out[part[pair[found]]] = False
    return out


def within_groups(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of rows, i < j, that lie in one of the groups starts[g] : ends[g]."""
    n = ends - starts
    rows = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    count = np.repeat(ends, n) - rows - 1
    i = np.repeat(rows, count)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def joining(of: np.ndarray, i: np.ndarray, j: np.ndarray, linked: Linked) -> tuple[np.ndarray, np.ndarray]:
    """Those linked pairs of rows i[k], j[k] that join different components of all that are linked. Pairs of what is joined by then aren't looked at."""
    label = np.unique(of, return_inverse=True)[1]
    kept: list[int] = []
    at, step = 0, EXACT_FIRST
    todo = np.arange(len(i))
    while at < len(todo):
        part = todo[at : at + step]
        part = part[label[i[part]] != label[j[part]]]
        for k in part[linked(i[part], j[part])].tolist() if len(part) else []:
            x, y = label[i[k]], label[j[k]]
            if x != y:
                label[label == x] = y
                kept.append(k)
        at, step = at + step, min(2 * step, PAIRS_AT_ONCE)
    return i[kept], j[kept]


def block_pairs(num: int, den: int, exact: Exact | None = None):
    """Compares the two blocks of each (key, lo, hi) in a stream sorted by those; holds a batch of rows and those of one more at a time.

    Two nodes may share many keys; their pair is given in the smallest of those.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch:
        key, lo, hi, own, node, of = (np.asarray(rows.column(c)) for c in ("key", "lo", "hi", "own", "node", "of"))
        x = spread_matrix(rows.column("spread").combine_chunks())
        rough = x.reshape(len(x), ROUGH, -1).sum(axis=2, dtype=np.uint16)
        lists = rows.column("keys").combine_chunks()
        keys, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        full = (x == MANY).any(axis=1)
        sizes = x.sum(axis=1, dtype=np.int64)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]

        def give(i: np.ndarray, j: np.ndarray) -> None:
            """Adds those of the pairs of rows that may be links, and that no smaller key has."""
            fits = of[i] != of[j]
            fits &= (own[i] != own[j]) | (lo[i] == hi[i])
            fits &= (den * np.minimum(sizes[i], sizes[j]) >= num * np.maximum(sizes[i], sizes[j])) | full[i] | full[j]
            i, j = i[fits], j[fits]
            for s in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[s : s + PAIRS_AT_ONCE], j[s : s + PAIRS_AT_ONCE]
                need = -(-num * (sizes[p] + sizes[q]) // (num + den))
                for marks in (rough, x):
                    near = np.flatnonzero((np.minimum(marks[p], marks[q]).sum(axis=1, dtype=np.int64) >= need) | full[p] | full[q])
                    p, q, need = p[near], q[near], need[near]
                first = meet_first(keys, ends, key, p, q)
                a.append(p[first])
                b.append(q[first])

        small = stops - starts <= AT_ONCE
        give(*within_groups(starts[small], stops[small]))
        for start, stop in zip(starts[~small].tolist(), stops[~small].tolist(), strict=True):
            left, right = (start + np.flatnonzero(own[start:stop] == side[start]) for side in (lo, hi))
            for i in left:
                to = right if lo[start] != hi[start] else right[right > i]
                give(np.full(len(to), i), to)
        a, b = np.concatenate(a), np.concatenate(b)
        if exact and len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = (used[k] for k in joining(of[used], place[: len(a)], place[len(a) :], exact(rows.column("data").take(pa.array(used)).to_pylist())))
        a, b = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def stream(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(ends[-1]) if len(ends) else 0  # where a group begins that the next batch may go on with
            if last is not None and (len(ends) or (keys[0] != last).any()):
                yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield compare(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = keys[-1]
        if held:
            yield compare(pa.Table.from_batches(held))

    return stream


def shared(rows: DataFrame) -> DataFrame:
    """Of (key, node, ...), the rows whose key has different nodes: one pass, no list of a key's nodes."""
    of = Window.partitionBy("key")
    return rows.withColumn("lo", F.min("node").over(of)).withColumn("hi", F.max("node").over(of)).where("lo <> hi").drop("lo", "hi")


def shared_keys(rows: DataFrame) -> DataFrame:
    """The keys of (key, node, ...) that have different nodes: a hot key is aggregated before it is shuffled."""
    return rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")


class Resolver:
    """Verifies the pairs of nodes that share a bucket, each once.

    buckets: (key, node, ...), written. fetch gives (node, data) of a table of nodes; verify
    takes (a, b, x, y), x and y being data, and gives the linked (a, b), whose similarity is
    num / den or more. spreads gives (node, spread) of a written table of nodes, perhaps with a few others. possible(x, y) may
    rule out pairs by the buckets' further columns, and sift pairs (a, b) by anything cheaper
    than their data. With mark_sifted, pairs that it rules out count as checked, and aren't sifted again.
    data: (node, data) of all nodes, where it is at hand already. With exact, spreads gives data too, and wide buckets' pairs are verified where they are found.
    """

    def __init__(self, buckets: DataFrame, verify: Step, spreads: Step, num: int, den: int, fetch: Step | None = None, data: DataFrame | None = None, possible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, sift: Step | None = None, mark_sifted: bool = False, exact: Exact | None = None):
        self.exact = exact
        self.mark_sifted = mark_sifted
        self.buckets, self.verify, self.spreads, self.num, self.den, self.fetch, self.sift = buckets, verify, spreads, num, den, fetch, sift
        self.data = data
        self.more = [c for c in buckets.columns if c not in ("key", "node")]
        self.fits = possible or (lambda x, y: F.lit(True))
        self.row = F.struct(*[F.col(c).alias(c) for c in ("node", "of", *self.more)])
        self.tried = self.links = None

    def _pairs(self, both: DataFrame) -> DataFrame:
        """(a, b) of rows x and y."""
        both = both.where((F.col("x.of") != F.col("y.of")) & self.fits(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
        return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def star(self, now: DataFrame, turn: int) -> DataFrame:
        """Each node with its bucket's centre."""
        centre = now.groupBy("key").agg(F.min_by(self.row, F.struct(F.col("node") if not turn else F.xxhash64("of", F.lit(turn)), "node")).alias("y"))
        return self._pairs(matched(now.select("key", self.row.alias("x")), materialise(centre, "centres"), "key"))

    def across(self, now: DataFrame, exact: Exact | None = None) -> tuple[DataFrame, DataFrame | None]:
        """All pairs of a bucket that lie in different components: those of small buckets, and those of wide ones that spreads allow, or with exact the links that join them."""
        sizes = materialise(now.groupBy("key").agg(F.count("*").alias("n")), "sizes")
        few_ = matched(now, sizes.where(F.col("n") <= SMALL), "key")
        pairs = self._pairs(few_.select("key", self.row.alias("x")).join(few_.select("key", self.row.alias("y")), "key").where("x.node < y.node"))
        wide = materialise(matched(now, sizes.where(F.col("n") > SMALL), "key").select("key", "node", "of", "n"), "wide")
        if wide.isEmpty():
            return pairs, None
        marks = materialise(self.spreads(materialise(wide.select("node").distinct(), "nodes")), "marks")
        held = wide.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # a node's keys are bounded by its own size
        return pairs, wide_pairs(wide.join(marks, "node").join(held, "node"), self.num, self.den, exact)

    def data_of(self, pairs: DataFrame) -> DataFrame:
        """(node, data) of the nodes of pairs (written). Sifted pairs and later rounds have few of all nodes, and no more are shuffled with them; a first one that isn't sifted has nearly all."""
        whole = self.tried is None and not self.sift
        if whole and not self.fetch:
            return self.data
        nodes = materialise(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "nodes")
        if self.fetch:
            new = nodes if self.data is None else materialise(nodes.join(self.data.select("node"), "node", "left_anti"), "new")
            fresh = materialise(self.fetch(new), "data")
            self.data = fresh if self.data is None else self.data.union(fresh)
        return self.data if self.tried is None and (whole or self.fetch) else wanted(self.data, nodes, "node")

    def check(self, pairs: DataFrame, sifted: DataFrame | None = None) -> DataFrame:
        """The linked ones of pairs, and of pairs that need no sifting, that weren't checked before."""
        new = lambda some: some if self.tried is None else some.join(self.tried, ["a", "b"], "left_anti")
        met = pairs = new(pairs.distinct())
        if self.sift and self.mark_sifted:
            met = pairs = materialise(pairs, "met")
        if self.sift:
            pairs = self.sift(pairs)
        if sifted is not None:
            pairs = new(pairs.union(sifted).distinct())
        pairs = materialise(pairs, "pairs")
        if not (self.sift and self.mark_sifted):
            met = pairs
        elif sifted is not None:
            met = met.union(pairs)
        data = self.data_of(pairs)
        full = pairs.join(data.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").join(data.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
        found = materialise(self.verify(full.select("a", "b", "x", "y")), "links")
        self.checked = met.count()
        self.tried = met if self.tried is None else self.tried.union(met)
        self.links = found if self.links is None else self.links.union(found)
        return found

    def components(self, stars: int = MOST_STARS) -> DataFrame:
        """(node, component) of linked nodes."""
        now, labels, turn, found = self.buckets.withColumn("of", F.col("node")), None, 0, None
        while True:
            last = turn >= stars or found is not None and found.count() < GAIN * self.checked
            if last and self.exact:
                pairs, joins = self.across(now, self.exact)
                self.check(pairs)
                if joins is not None:
                    self.links = self.links.union(materialise(joins, "joins"))
            else:
                found = self.check(*self.across(now)) if last else self.check(self.star(now, turn))
            labels = materialise(connected_components(self.links), "labels")
            turn += 1
            if last:
                return labels
            named = F.broadcast(labels) if few(labels) else labels
            now = self.buckets.join(named.select("node", F.col("component").alias("c")), "node", "left").withColumn("of", F.coalesce("c", "node")).drop("c")
            many = materialise(now.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("key"), "many")
            now = materialise(matched(now, many, "key"), "open")
            if now.isEmpty():
                return labels

    def all_links(self) -> DataFrame:
        """Every linked pair (a, b), also those within what is one component already: as many rows as there are links."""
        return self.check(*self.across(self.buckets.withColumn("of", F.col("node"))))

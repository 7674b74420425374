"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are compared as words (lower case, without punctuation) with a space between them,
items as well as documents. A passage is an item's text with edits of up to `max_edit` of
its characters, wherever it stands.

1. Windows have the size of the item they are compared with. A window can be the item only
   if enough of the item's stretches of q characters stand in it, unedited and in step
   (their places in text and item differ by the same, give or take the edits). Common
   stretches are left out, by their counts in all documents, so that common phrases make
   no windows, but half of an item's stretches are looked for at least. How many must be there is what
   all but one in 100 passages keep that have all the edits allowed, at random places.
2. The CGK embedding walks a window: step j puts out the character it stands on and moves
   on by a random bit of (j, character). Walks over strings that differ by an edit fall in
   step again, so edit distance becomes Hamming distance between what they put out. A
   repetition samples `samples` steps; window and item are a candidate if they agree on all
   of a repetition's steps. Walks of `TUPLES` repetitions each are made until the recall
   asked for is reached, which is simulated with all the edits allowed, by length.
3. A candidate is kept if the item has at most `max_edit` of its characters in edits to some
   stretch of the document there (bit-parallel approximate matching, exact). Of an item's
   places in a document the best one is given.

Items are read once and go to tasks in blocks of a checked size, each block scanning the
documents, so neither side is ever crossed with the other. Equal items are one pattern.

Edge cases: null and empty texts hold no item; items without words match nothing; items
under five characters must stand as whole words; an empty table on either side gives no
row; repeated documents give rows of their own; repeated items too; other columns are
ignored.
"""

from __future__ import annotations

import functools
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blooms import combined, less
from .common import SLICE_CHARS, map_arrow, materialise, slices, texts_of, while_writing

DROP = string.punctuation.encode()
#: Characters of all items in one block that goes to the tasks.
BLOCK_CHARS = 1_000_000
#: Stretches by an item's bytes: from so many on, so long.
STRETCHES = ((40, 8), (20, 6), (10, 4), (5, 3))
#: Stretches that an item keeps at least, counts in a row of the table of their frequencies, and the share of all places that is rare.
LEAST_CHOSEN, COUNTS, RARE = 40, 4096, 2e-7
#: Repetitions (sampled steps) of one walk, most walks, and steps of a walk for each byte of the item.
TUPLES, WALKS, STEPS = 150, 8, 1.5
#: Random bits for so many steps; longer walks use them again.
BITS = 1024
#: Stretches that are looked at together.
MOST_HITS = 4_000_000
SEED = 11


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, DROP).split()


def joined(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


def spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number. data ends with eight bytes that don't count."""
    out = np.empty(len(data) - 8, dtype=np.uint64)
    raw = data.tobytes()
    for r in range(min(8, len(out))):
        n = len(range(r, len(out), 8))
        out[r::8] = np.frombuffer(raw, dtype="<u8", count=n, offset=r)
    return out


def first_bytes(q: int) -> np.uint64:
    return np.uint64((1 << 8 * q) - 1)


def stretch_of(size: int) -> int:
    """q for an item of so many bytes, spaces around it included."""
    return next((q for least, q in STRETCHES if size >= least + 2), size)


@functools.cache
def bit_table(walk: int) -> np.ndarray:
    return np.random.default_rng(SEED + walk).integers(0, 2, (BITS, 256), dtype=np.int64)


@functools.cache
def sampled(walk: int, samples: int) -> np.ndarray:
    """(TUPLES, samples) places in a walk, as shares of its steps."""
    return np.random.default_rng(1000 * SEED + walk).random((TUPLES, samples))


def agreements(data: np.ndarray, starts: np.ndarray, steps: np.ndarray, other: np.ndarray, begins: np.ndarray, walk: int) -> np.ndarray:
    """(windows, most steps): whether each window's walk puts out what stands in other from begins on. steps falls."""
    out = np.zeros((len(starts), int(steps[0]) if len(steps) else 0), dtype=bool)
    bits, at = bit_table(walk), starts.copy()
    left = np.searchsorted(-steps, -np.arange(out.shape[1]), side="left")
    for j in range(out.shape[1]):
        n = left[j]  # windows that have a step j
        c = data[at[:n]]
        out[:n, j] = c == other[begins[:n] + j]
        at[:n] += bits[j % BITS][c]
    return out


def walked(data: np.ndarray, start: int, steps: int, walk: int) -> np.ndarray:
    """What one walk puts out."""
    bits, at, out = bit_table(walk), start, np.empty(steps, dtype=np.uint8)
    for j in range(steps):
        out[j] = c = data[at]
        at += bits[j % BITS, c]
    return out


def agreeing(agree: np.ndarray, steps: np.ndarray, walk: int, samples: int) -> np.ndarray:
    """Which windows agree on all steps of one of a walk's repetitions."""
    place = (sampled(walk, samples)[None] * steps[:, None, None]).astype(np.int64)
    rows = np.arange(len(steps))[:, None]
    found = agree[rows, place[..., 0]]
    for k in range(1, samples):
        found &= agree[rows, place[..., k]]
    return found.any(axis=1)


def edited(rng: np.random.Generator, text: np.ndarray, edits: int) -> np.ndarray:
    """text with so many letters replaced, put in or taken out."""
    out = text.tolist()
    for kind, share, letter in zip(rng.integers(0, 3, edits).tolist(), rng.random(edits).tolist(), rng.integers(97, 117, edits).tolist(), strict=True):
        at = int(share * len(out))
        out[at : at + (kind != 1)] = [letter] * (kind != 2)
    return np.array(out, dtype=np.uint8)


@functools.cache
def length_class(size: int) -> int:
    """Sizes in steps of an eighth, for which simulations are made once."""
    unit = max(1, 1 << max(0, size.bit_length() - 4))
    return size // unit * unit


@functools.cache
def least_stretches(size: int, q: int, edits: int, chosen: int, trials: int = 2000) -> int:
    """Of so many stretches of q, those that all but one in 100 of such passages keep unedited, and one at least."""
    rng = np.random.default_rng(SEED)
    hit = np.zeros((trials, size + 1), dtype=np.int64)
    hit[np.arange(trials)[:, None], rng.integers(0, size, (trials, edits)) + 1] = 1
    before = np.cumsum(hit, axis=1)
    whole = rng.permuted(before[:, q:] == before[:, :-q], axis=1)
    return max(1, int(np.quantile(whole[:, :chosen].sum(axis=1), 0.01)))


@functools.cache
def walks_needed(size: int, edits: int, samples: int, recall: float, trials: int = 200) -> int:
    """Walks after which so many of the passages with all edits allowed are candidates; WALKS at most."""
    rng = np.random.default_rng(SEED)
    steps = np.full(trials, int(STEPS * size))
    tail = lambda: rng.integers(97, 117, 2 * size + 8).astype(np.uint8)
    items = [np.where(rng.random(size) < 0.16, 32, rng.integers(97, 117, size)).astype(np.uint8) for _ in range(trials)]
    texts = [np.concatenate([edited(rng, x, edits), tail()]) for x in items]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    data, found = np.concatenate(texts), np.zeros(trials, dtype=bool)
    for walk in range(WALKS):
        own = np.concatenate([walked(np.concatenate([x, tail()]), 0, int(steps[0]), walk) for x in items])
        found |= agreeing(agreements(data, starts, steps, own, np.arange(trials) * int(steps[0]), walk), steps, walk, samples)
        if found.mean() >= recall:
            return walk + 1
    return WALKS


class Index:
    """A block of items: their stretches, in order, and what their walks put out."""

    def __init__(self, items: list[tuple[int, list[bytes]]], max_edit: float, samples: int, recall: float):
        self.ids: dict[bytes, list[int]] = {}
        for i, words in items:
            self.ids.setdefault(spaced(words), []).append(i)
        self.samples, self.max_edit = samples, max_edit
        self.texts = list(self.ids)
        self.patterns = [t.decode("utf-8", "surrogatepass").strip() for t in self.texts]
        self.words = [t.count(b" ") - 1 for t in self.texts]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.q = np.array([stretch_of(n) for n in self.sizes.tolist()], dtype=np.int64)
        edits = [int(max_edit * len(p)) for p in self.patterns]
        classes = [length_class(n) for n in self.sizes.tolist()]
        self.drift = np.array([e + 1 for e in edits], dtype=np.int64)
        self.walks = np.array([walks_needed(c, int(max_edit * c), samples, recall) if e else 1 for c, e in zip(classes, edits, strict=True)], dtype=np.int64)
        self.steps = np.maximum((STEPS * self.sizes).astype(np.int64), 1)
        self.begins = np.cumsum(self.steps) - self.steps
        pad = np.zeros(int(self.steps.max(initial=0)) + 8, dtype=np.uint8)
        arrays = [np.concatenate([np.frombuffer(t, dtype=np.uint8), pad]) for t in self.texts]
        self.put_out = [np.concatenate([walked(a, 0, n, w) for a, n in zip(arrays, self.steps.tolist(), strict=True)]) for w in range(int(self.walks.max(initial=0)))]
        self.classes = []
        for size in sorted(set(self.q.tolist()), reverse=True):
            own = np.flatnonzero(self.q == size)
            masked = [packed(arrays[i][: self.sizes[i] + 8])[: self.sizes[i] - size + 1] & first_bytes(min(size, 8)) for i in own]
            item = np.repeat(own, [len(m) for m in masked])
            self.classes.append(self._class(size, np.concatenate(masked), item, np.concatenate([np.arange(len(m)) for m in masked])))
        self.least = np.ones(len(self.texts), dtype=np.int64)

    def _class(self, size: int, keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple:
        order = np.argsort(keys, kind="stable")
        keys, first, count = np.unique(keys[order], return_index=True, return_counts=True)
        bits = min(24, max(16, (16 * len(keys)).bit_length()))
        present = np.zeros(1 << bits, dtype=bool)
        present[self._slot(keys, bits)] = True
        return first_bytes(min(size, 8)), bits, present, keys, first, count, item[order], offset[order], size

    def n_keys(self) -> int:
        return sum(len(c[3]) for c in self.classes) + 1

    def occurrences(self, data: np.ndarray) -> np.ndarray:
        """How often each stretch of an item stands in data, and at last how long data is."""
        return np.concatenate([*(np.bincount(k, minlength=len(c[3])) for _, k, c in self.hits(data)), [len(data)]])

    def choose(self, frequency: np.ndarray) -> None:
        """Keeps each item's rare stretches; if they are less than half of it or than LEAST_CHOSEN, the next ones too.

        All that stand in a RARE share of the places count as equally rare: a passage's own copies don't make its
        unedited stretches look common.
        """
        edits, at, rare = self.drift - 1, 0, max(1.0, RARE * float(frequency[-1]))
        for n, (_, _, _, keys, _, count, item, offset, size) in enumerate(self.classes):
            often = np.repeat(np.maximum(frequency[at : at + len(keys)], rare), count)
            values = np.repeat(keys, count)
            at += len(keys)
            order = np.lexsort((offset, often, item))
            which = item[order]
            rank = np.arange(len(which)) - np.searchsorted(which, which)
            total = np.bincount(item, minlength=len(self.texts))
            keep = order[(often[order] <= rare) | (rank < np.maximum(LEAST_CHOSEN, total // 2)[which])]
            chosen = np.bincount(item[keep], minlength=len(self.texts))
            self.classes[n] = self._class(size, values[keep], item[keep], offset[keep])
            for i in np.unique(item):
                if edits[i]:
                    c = length_class(int(self.sizes[i]))
                    self.least[i] = least_stretches(c, min(size, c - 1), int(self.max_edit * c), length_class(int(chosen[i]) * c // int(self.sizes[i])))

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def hits(self, data: np.ndarray) -> list[tuple]:
        """Of each class of stretches: (places in data, places in its keys, class)."""
        eight, out = packed(data), []
        for c in self.classes:
            mask, bits, present, keys = c[:4]
            at = np.flatnonzero(present[self._slot(eight & mask, bits)])
            own = eight[at] & mask
            k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            same = keys[k] == own
            out.append((at[same], k[same], c))
        return out

    def windows(self, hits: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(item, start in data) of the windows that hold enough of the item's stretches in step."""
        items, starts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for at, k, (*_, first, count, item, offset, _) in hits:
            n = count[k]
            place = np.repeat(first[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            which = item[place]
            key = which << 40 | np.repeat(at, n) - offset[place] + (1 << 32)
            key.sort()
            which = key >> 40
            near = np.searchsorted(key, key + self.drift[which], side="right") - np.arange(len(key))
            ends = np.flatnonzero(near >= self.least[which])
            if not len(ends):
                continue
            inside = np.zeros(len(key) + 1, dtype=np.int64)  # all stretches of such a run, each as a start of its own
            np.add.at(inside, ends, 1)
            np.add.at(inside, ends + near[ends], -1)
            key = np.unique(key[np.cumsum(inside[:-1]) > 0])
            items.append(key >> 40)
            starts.append((key & ((1 << 40) - 1)) - (1 << 32))
        return np.concatenate(items), np.concatenate(starts)

    def candidates(self, data: np.ndarray, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which of these windows agree with their items on all steps of a repetition. data goes on for the longest walk after the last start."""
        order = np.argsort(-self.steps[items], kind="stable")
        items, starts = items[order], np.maximum(starts[order], 0)
        found = np.zeros(len(items), dtype=bool)
        for walk in range(int(self.walks[items].max(initial=0))):
            for part in np.array_split(open_ := np.flatnonzero(~found & (self.walks[items] > walk)), 1 + len(open_) // 20_000):
                if len(part):
                    i, steps = items[part], self.steps[items[part]]
                    found[part] = agreeing(agreements(data, starts[part], steps, self.put_out[walk], self.begins[i], walk), steps, walk, self.samples)
        out = np.zeros(len(items), dtype=bool)
        out[order] = found
        return out


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(fewest edits from the pattern to a stretch of text, where that stretch ends); Myers' bit vectors."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, edits): the best place of every item in every text."""
    return _matches([spaced(words_of(t)) for t in texts], 0, index)


def _matches(norm: list[bytes], base: int, index: Index) -> list[tuple[int, int, int, int, int]]:
    ends = np.cumsum([len(t) + 1 for t in norm])
    data = np.frombuffer(b"\0".join([*norm, bytes(int(index.steps.max(initial=0)) + 16)]), dtype=np.uint8)
    hits = index.hits(data)
    if len(norm) > 1 and sum(int(c[5][k].sum()) for _, k, c in hits) > MOST_HITS:
        half = len(norm) // 2
        return _matches(norm[:half], base, index) + _matches(norm[half:], base + half, index)
    items, starts = index.windows(hits)
    keep = index.candidates(data, items, starts)
    items, starts = items[keep], starts[keep]
    # A window may begin a little before the text that holds most of it.
    texts = np.searchsorted(ends, np.maximum(starts + index.sizes[items] // 2, 0), side="right")
    places: dict[tuple[int, int], list[int]] = {}
    for k, i, s in zip(texts.tolist(), items.tolist(), starts.tolist(), strict=True):
        if k < len(norm):
            places.setdefault((k, i), []).append(s - int(ends[k]) + len(norm[k]) + 1)
    found = []
    for (k, i), at in places.items():
        pattern, size, best = index.patterns[i], int(index.sizes[i]), None
        most, slack, text = index.max_edit * len(pattern), int(index.drift[i]) + 4, norm[k]
        done = None
        for place in sorted(at):
            if done is not None and place <= done:
                continue
            done = place + 2 * slack  # one look covers the starts from here to there
            first = max(0, place - slack)
            part = text[first : max(0, place) + size + 3 * slack].decode("utf-8", "ignore")
            edits, end = best_match(pattern, part)
            if edits <= most and (best is None or edits < best[0]):
                last = text.count(b" ", 0, first) + part.count(" ", 0, end) - 1
                best = (edits, max(0, last - index.words[i] + 1))
        if best:
            found.append((base + k, i, best[1], index.words[i], best[0]))
    return found


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each of the index's stretches stands in all documents: as many counts as it has stretches, which a block bounds."""
    shared, n = docs.sparkSession.sparkContext.broadcast(index), index.n_keys()
    blocks_ = -(-n // COUNTS)

    def count(batches):
        own = np.zeros(blocks_ * COUNTS, dtype="<u8")
        for _, texts in slices(batches, chars=SLICE_CHARS // 4):
            own[:n] += shared.value.occurrences(np.frombuffer(b"\0".join([*(spaced(words_of(t)) for t in texts), bytes(16)]), dtype=np.uint8)).astype("<u8")
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks_)), pa.array([own[k * COUNTS : (k + 1) * COUNTS].tobytes() for k in range(blocks_)], pa.binary())], names=["block", "bits"])

    out = np.zeros((blocks_, COUNTS), dtype=np.int64)
    with while_writing(docs.sparkSession):
        for block, bits in combined(map_arrow(texts_of(docs), count, "block long, bits binary"), "<u8", np.add).collect():
            out[block] = np.frombuffer(bytes(bits), dtype="<u8")
    return out.reshape(-1)[:n]


def contaminated(docs: DataFrame, items: DataFrame, max_edit: float = 0.2, samples: int = 4, recall: float = 0.97) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits, item_chars of every benchmark passage found. recall is the share of passages with all the edits allowed that are to be found."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long, item_chars long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items):
        index = Index(block, max_edit, samples, recall)
        index.choose(frequencies(docs, index))
        shared = spark.sparkContext.broadcast(index)  # at most BLOCK_CHARS characters

        def scan(batches, shared=shared):
            index = shared.value
            for batch, texts in slices(batches, chars=SLICE_CHARS // 4):
                found = matches(texts, index)
                if found:
                    ids = batch.column(0).to_pylist()
                    rows = [(ids[k], item, p, n, e, len(index.patterns[i])) for k, i, p, n, e in found for item in index.ids[index.texts[i]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "edits", "item_chars"])

        out = out.union(map_arrow(texts_of(docs), scan, schema))
    return out


def blocks(items: DataFrame):
    """The items' words, in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        chars = sum(map(len, words)) + len(words)
        if block and size + chars > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, words))
        size += chars
    if block:
        yield block


def without(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs less the rows of documents that hold a benchmark passage."""
    found = contaminated(docs, items, **options).select("doc_id").distinct()
    return less(docs, materialise(found, "leaks"), "doc_id")

"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The encoding of a prefix is the encoding of a shorter prefix and one more token: the
only token, of those that end there, which may follow the shorter prefix's last one
(two tokens may stand side by side if the pair's own bytes encode to just that pair).
So count[i] = count[i - len(token)] + 1, in time linear in the piece, and one pass
answers "how many tokens has the text up to here" and "how much of the text fits"
without encoding again.

The table of a text holds the change of the count at each character, as little-endian
i16 (stored as i8 where that holds them, and compressed); pieces' tables are kept and joined, as a pattern piece's tokens don't depend on the
text around it. Where a cut changes the pieces themselves the table says so: within a run
of white space the run up to the cut is one piece, a cut contraction is two, and a cut
special token is plain text.

Edge cases: null or empty text has an empty table and no token; special strings within a
text are tokens, as is the library's default.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_arrow, materialise, slices, texts_of
from .encoding import Memo, TextEncoder, chunks, plain_spaced

#: Bytes of a piece whose states are kept.
HEAD = 6
CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    def __init__(self, path: str, cached: int = 600_000):
        base = TextEncoder(path, 0)
        if not base.spaced or base.core is None:
            raise ValueError("prefix counts need a byte-level BPE file without a normalizer whose ids are in merge order")
        self.special, self.pattern = base.special, base.pattern
        self.specials = re.compile("|".join(map(re.escape, sorted(base.special, key=len, reverse=True)))) if base.special else None
        self.core = base.core._core_bpe
        self.ids = dict(base.core._mergeable_ranks)
        self.longest = max(map(len, self.ids))
        self.alone = Memo(self._alone, len(self.ids))
        self.heads = Memo(self._states, 50_000)
        self.beside = Memo(self._beside, 400_000)
        self.pieces = Memo(self._piece, cached)
        self.known = Memo(self._chunk, cached)

    def _beside(self, pair: tuple[bytes, bytes]) -> bool:
        return self.core.encode_single_piece(pair[0] + pair[1]) == [self.ids[pair[0]], self.ids[pair[1]]]

    def counts(self, data: bytes) -> list[int]:
        """Tokens of each prefix of one piece's bytes, from the empty one on."""
        return self._states(data)[0]

    def _states(self, data: bytes) -> tuple[list[int], list[bytes]]:
        """That, and each prefix's last token. The states of pieces' first bytes are kept: few beginnings are common to most pieces."""
        if len(data) > HEAD:
            count, last = self.heads[data[:HEAD]]
            count, last = count.copy(), last.copy()
        else:
            count, last = [0], [b""]
        ids, beside, longest = self.ids, self.beside, self.longest
        for i in range(len(count), len(data) + 1):
            token = data[max(0, i - longest) : i]
            s = i - len(token)
            while True:
                if token in ids and (beside[last[s], token] if s else self.alone[token]):
                    break
                s += 1
                token = token[1:]
            count.append(count[s] + 1)
            last.append(token)
        return count, last

    def _alone(self, token: bytes) -> bool:
        return len(token) == 1 or self.core.encode_single_piece(token) == [self.ids[token]]

    def _piece(self, piece: str) -> bytes:
        if piece in CONTRACTIONS:
            at = [self.counts(b"'")[-1], self.counts(b"'")[-1] + self.counts(piece[1:2].encode())[-1], self.counts(piece.encode())[-1]]
        else:
            at = self.counts(piece.encode())[1:]
            if not piece.isascii():
                ends = np.cumsum([len(c.encode()) for c in piece]) - 1
                at = [at[e] for e in ends]
        return array("h", [b - a for a, b in zip([0, *at], at)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self.pattern.findall(chunk)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _segment(self, text: str) -> bytes:
        """Of a text without special tokens."""
        if plain_spaced(text):
            return b"".join(map(self.known.__getitem__, chunks(text)))
        out: list[bytes] = []
        before, owed = "", 0
        for piece in self.pattern.findall(text):
            own = self.pieces[piece]
            if owed or before and piece[0].isspace():
                change = array("h", own)
                change[0] += owed
                owed = 0
                if before and piece[0].isspace():  # the last of a run of white space: up to it, the run is one piece
                    run = sum(array("h", self.pieces[before + piece[0]])) - sum(array("h", self.pieces[before]))
                    owed, change[0] = change[0] - run, run
                    if len(change) > 1:
                        change[1] += owed
                        owed = 0
                own = change.tobytes()
            out.append(own)
            before = piece if piece.isspace() else ""
        return b"".join(out)

    def table(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            return self._segment(text) if text else b""
        out, at = [], 0
        for m in self.specials.finditer(text):
            first = text[at : m.start()]
            head = array("h", self._segment(first + m.group()[:-1]))  # up to the last character the special token is plain text
            whole = sum(array("h", self._segment(first))) + 1 if first else 1
            head.append(whole - sum(head))
            out.append(head.tobytes())
            at = m.end()
        return b"".join([*out, self._segment(text[at:]) if text[at:] else b""])


def stored(table: bytes) -> bytes:
    """A table as it is stored: compressed, a byte a character where all changes fit."""
    x = np.frombuffer(table, dtype="<i2")
    narrow = x.astype(np.int8)
    return zlib.compress(b"1" + narrow.tobytes() if (narrow == x).all() else b"2" + table, 1)


def changes(stored_: bytes) -> np.ndarray:
    """The change of the count at each character of a stored table."""
    data = zlib.decompress(stored_)
    return np.frombuffer(data[1:], dtype=np.int8 if data[:1] == b"1" else "<i2")


def tokens_at(stored_: bytes, chars: int) -> int:
    """Tokens of the text's first `chars` characters."""
    return int(changes(stored_)[:chars].sum(dtype=np.int64))


def longest_prefix(stored_: bytes, budget: int) -> int:
    """Most characters whose tokens are within the budget."""
    fits = np.flatnonzero(np.cumsum(changes(stored_), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def counter_of(path: str) -> PrefixCounter:
    """One per worker and file."""
    return kept("counter", path, lambda: PrefixCounter(path))


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_bytes and its stored table."""

    def count(batches):
        counter = counter_of(tokenizer)
        for batch, texts in slices(batches):
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([stored(counter.table(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "prefix_table"])

    return map_arrow(texts_of(docs), count, "doc_id long, n_bytes long, prefix_table binary")


def within(tables: DataFrame, budget: int) -> DataFrame:
    """Of stored tables: doc_id, n_bytes, n_tokens, and fits_chars, the longest prefix within the budget. No text is read."""

    def answer(batches):
        for batch in batches:
            rows = []
            for table in batch.column(2):
                at = np.cumsum(changes(table.as_py()), dtype=np.int64)
                total = int(at[-1]) if len(at) else 0
                fits = len(at) if total <= budget and (at <= budget).all() else int(max(np.flatnonzero(at <= budget), default=-1)) + 1
                rows.append((total, fits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))], names=["doc_id", "n_bytes", "n_tokens", "fits_chars"])

    return map_arrow(tables.select("doc_id", "n_bytes", "prefix_table"), answer, "doc_id long, n_bytes long, n_tokens long, fits_chars long")


def over_limit(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """Tables are written once, and counts and truncation points read off them."""
    counted = within(materialise(prefix_counts(docs, tokenizer), "prefix-tables"), limit)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")

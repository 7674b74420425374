"""Encoding whole texts with a tokenizers file, a distinct chunk at a time.

White space bounds what a byte-level or word-end BPE may merge, so a text's ids are
the ids of its white-space chunks, one after another. Each worker keeps the ids of
the chunks it met first (the frequent ones come early) and has the library's model
encode the others: the same ids at a fraction of its cost on whole texts. Byte-level
files whose ids are in merge order run on the byte-pair core of tiktoken instead, with
the ranks of the same file; the tests hold both to the library's ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import kept

#: Texts from so many characters on are searched for runs of white space that the byte-pair core's pattern can't match (its stack ends at a million).
LONG, LONG_RUN = 50_000, re.compile(r"\s{20000}")
#: White space beyond space and line feed, as the two tokenizers' patterns and Python count it.
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x01"
ODD_UNICODE = "\x85\xa0 ᠎               　"
RUNS = ("  ", "\n\n", " \n", "\n ")


def plain_spaced(text: str) -> bool:
    """Only single spaces and line feeds, each between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    if any(c in text for c in ODD_ASCII) or any(r in text for r in RUNS):
        return False
    return text.isascii() or not any(c in text for c in ODD_UNICODE)


def chunks(text: str) -> list[str]:
    """Of a plain-spaced text: words with the space before them, and line feeds."""
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The tokenizers' own split patterns.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextEncoder:
    """Ids of whole texts as little-endian bytes of `dtype` (the narrowest that holds the vocabulary).

    Chunks are kept at two levels: white-space chunks as they stand in the text, and the
    pattern's pieces of those (without case or punctuation around them they recur more),
    which the library's BPE model encodes. What has letters whose lower case depends on
    more than themselves, or a special token's text, goes through the whole library.
    """

    def __init__(self, path: str, cached: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        # The two layouts for which chunks are known to be independent; any other file is used on whole texts.
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.wordwise = parts == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0].get("behavior") == "Removed"
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"] if self.wordwise else SPACED)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.letters = byte_letters()
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.core = self._core(spec) if self.spaced else None
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known = Memo(self._chunk, cached)
        self.pieces = Memo(self._piece, cached)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _core(self, spec: dict):
        """The byte-pair core over this file's own vocabulary, where a token's rank is its id: same ids, and twice as fast."""
        back = {c: b for b, c in self.letters.items()}
        vocab = spec["model"]["vocab"]
        special = set(self.special)
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        merged = [vocab.get(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if merged != sorted(merged) or len(ranks) != len(merged) + 256:
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=SPACED, mergeable_ranks=ranks, special_tokens={})

    def _split(self, text: str) -> list[str] | None:
        if self.wordwise:
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f\u180e") else text.split()
        return chunks(text) if self.spaced and plain_spaced(text) else None

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            letters = "\u0120" + piece[1:] if piece[0] == " " else piece
            if not letters[1:].isprintable() or " " in letters or not piece[0].isprintable():
                letters = piece.translate(self.letters)
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii():
            if "<|" in chunk and any(s in chunk for s in self.special):
                return self._library([chunk])[0]
        elif self.wordwise and max(chunk) >= "\u0130" or any(s in chunk for s in self.special):
            return self._library([chunk])[0]
        found = self.pattern.findall(chunk.lower() if self.wordwise else chunk)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _whole(self, text: str) -> bytes:
        """A text with runs of white space: the pattern over all of it."""
        if not self.spaced or any(s in text for s in self.special):
            return self._library([text])[0]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _odd(self, text: str) -> bool:
        """Whether the byte-pair core doesn't do for this text."""
        return any(s in text for s in self.special) or len(text) >= LONG and LONG_RUN.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.core is not None:
            return [self._library([t])[0] if self._odd(t) else array(self.code, self.core.encode_ordinary(t)).tobytes() for t in texts]
        get = self.known.__getitem__
        parts = map(self._split, texts)
        return [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts, strict=True)]


class Memo(dict):
    """Keeps what make() gives for the first `most` keys; others are made each time."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


def encoder(path: str) -> TextEncoder:
    """One per worker and file."""
    return kept("encoder", path, lambda: TextEncoder(path))

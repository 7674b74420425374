"""Encoding, records, packing and prefix counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import encoding, packing, records, token_counts
from tessera.llm.common import work_path
from tessera.llm.encoding import TextEncoder

PARTS = ["a", "b", " ", "\n", "'", "s", "l", "é", " the", "ing", "!!", "\t", "1", "<|endoftext|>", "'ll", "  ", "日", "　", "\r\n", "É", "\x1c", "\x01", "Σ", "İ"]


def samples(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("which", ["byte_bpe", "word_bpe"])
@pytest.mark.parametrize("core", [True, False])
def test_encoder_equals_library(which, core, request, edge_rows):
    path = request.getfixturevalue(which)
    own, library = TextEncoder(path, cached=50), Tokenizer.from_file(path)
    if not core:
        own.core = None
    texts = samples() + [t or "" for _, t in edge_rows]
    for _ in range(2):  # the second time from what is kept
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype=own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_records_round_trip(spark, edges, edge_rows, word_bpe):
    path = work_path(spark, "records")
    records.write_records(edges, path, word_bpe, end_id=2, files=3)
    got = records.read_records(spark, path, keep_ids=True).orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(word_bpe), 0
    assert [r.doc_id for r in got] == [i for i, _ in edge_rows]
    for (_, text), r in zip(edge_rows, got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    files = [r.file for r in records.manifest(spark, path).orderBy("part").collect()]
    reader = records.ShuffledReader(path, files)
    order = list(range(len(reader)))
    random.Random(1).shuffle(order)
    for i in order:
        doc_id, ids = reader[i]
        assert (doc_id, ids.tolist()) == (got[i].doc_id, got[i].ids)


def test_records_of_none_and_damage(spark, none, word_bpe):
    path = work_path(spark, "records")
    records.write_records(none, path, word_bpe, end_id=2)
    assert records.read_records(spark, path).count() == 0
    whole = records.frame(b"payload")
    import io

    assert list(records.unframe(io.BytesIO(whole))) == [b"payload"]
    for bad in (whole[:-1], whole[:5], bytes([whole[0] ^ 1]) + whole[1:], whole[:14] + b"x" + whole[15:]):
        with pytest.raises(records.BadRecord):
            list(records.unframe(io.BytesIO(bad)))


def test_packing(spark, edges, edge_rows, make, byte_bpe):
    capacity = 64
    got = packing.pack(edges, byte_bpe, end_id=0, capacity=capacity).collect()
    library = Tokenizer.from_file(byte_bpe)
    total = 0
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in edge_rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for p, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (p, at) and (p == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_seq) <= -(-total // capacity) + 1
    seqs = packing.sequences(edges, byte_bpe, 0, capacity).collect()
    assert sum(s.length for s in seqs) == total and all(len(s.ids) == 2 * s.length for s in seqs)
    assert packing.pack(make([]), byte_bpe).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_close_to_the_bound(seed):
    rng, capacity, lengths = random.Random(seed), 100, {}
    for _ in range(3000):
        n = min(capacity, 1 + int(rng.expovariate(1 / 30)))
        lengths[n] = lengths.get(n, 0) + 1
    seqs = {}
    for n, _, count, first, offset in packing.plan(lengths, capacity):
        for s in range(first, first + count):
            seqs.setdefault(s, []).append((offset, n))
    placed = {}
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
            placed[n] = placed.get(n, 0) + 1
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    assert placed == lengths
    assert len(seqs) <= 1.01 * sum(n * c for n, c in lengths.items()) / capacity + 1


def test_prefix_counts_at_every_prefix(byte_bpe):
    counter, library = token_counts.PrefixCounter(byte_bpe, 50), Tokenizer.from_file(byte_bpe)
    for text in samples(300, 9):
        table = token_counts.stored(counter.table(text))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [token_counts.tokens_at(table, i) for i in range(len(text) + 1)] == want, text
        for budget in (0, 1, 3, 1000):
            assert token_counts.longest_prefix(table, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_over_limit(spark, edges, edge_rows, none, byte_bpe):
    library = Tokenizer.from_file(byte_bpe)
    got = {r.doc_id: r for r in token_counts.over_limit(edges, byte_bpe, 5).collect()}
    for i, text in edge_rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 5, len((text or "").encode()))
    assert token_counts.over_limit(none, byte_bpe, 5).count() == 0
    tables = {r.doc_id: r.prefix_table for r in token_counts.prefix_counts(edges, byte_bpe).collect()}
    for i, text in edge_rows:
        assert token_counts.tokens_at(tables[i], len(text or "")) == got[i].n_tokens
        fits = got[i].fits_chars
        assert fits == token_counts.longest_prefix(tables[i], 5) and len(library.encode((text or "")[:fits], add_special_tokens=False).ids) <= 5


LONG = {"spaces": " " * 1_000_000, "mixed": "a" + "\n \t" * 20_000 + "b", "special": "a <|endoftext|>" * 5_000}


@pytest.mark.parametrize("kind", LONG)
def test_long_runs(byte_bpe, kind):
    library = Tokenizer.from_file(byte_bpe)
    ids = library.encode(LONG[kind], add_special_tokens=False).ids
    enc = encoding.TextEncoder(byte_bpe)
    assert np.frombuffer(enc.encode([LONG[kind]])[0], dtype=enc.dtype).tolist() == ids
    table = token_counts.stored(token_counts.PrefixCounter(byte_bpe, 50).table(LONG[kind]))
    assert token_counts.tokens_at(table, len(LONG[kind])) == len(ids)
    assert token_counts.longest_prefix(table, len(ids)) == len(LONG[kind])


def test_sequences_of_repeated_ids(spark, make, byte_bpe):
    library = Tokenizer.from_file(byte_bpe)
    rows = [(1, "one two three"), (1, "one two three"), (1, "four five"), (None, "six"), (None, None)]
    want = sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows)
    got = []
    for r in packing.sequences(make(rows), byte_bpe, 0, 16).collect():
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.length <= 16
        got += [tuple(ids[a:b]) for a, b in zip(r.offsets, [*r.offsets[1:], r.length], strict=True)]
    assert sorted(got) == want

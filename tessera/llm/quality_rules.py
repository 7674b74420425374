"""Quality rules: counts of words, lines and repeats, and bands of n-gram perplexity by language.

A document's perplexity is that of its typical stretch: the negative log-probability a
word, averaged over each stretch of 16 words (the last has up to 31), and of those the median. So a passage in
another language or a table moves it little, and text that is unlike its language
throughout moves it much. In each language, documents deviate from the language's median
by a spread (median absolute deviation, scaled to a standard deviation) that grows for
short ones by sqrt(1 + 100 / words). Documents more than `upper` spreads above or `lower`
below it are rejected, as are those the base rules reject.

The model and the bands are made of all documents (see ngram_lm).

Edge cases: null text is empty and fails the base rules; null lang is a language of its
own; a language whose documents don't differ has no spread and rejects none; repeated
rows are counted each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_lm
from .blooms import few, less
from .common import kept, map_arrow, materialise, slices, texts_of
from .encoding import Memo

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STRETCH = 16
MOST_LANGS = 10_000
SHORT = 100
STATS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("surprise", pa.float64())]


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


ODD = np.array([2 * k * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 & (1 << 64) - 1 | 1 for k in range(WINDOW)], dtype=np.uint64)


def repeat_words(words: list[bytes], hashes: dict[bytes, int]) -> int:
    """Words within windows of 8 that occur more than once. Hashes (of words) only tell which windows can't."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    w = h[:n] * ODD[0]
    for k in range(1, WINDOW):
        w ^= w >> np.uint64(31)
        w += h[k : n + k] * ODD[k]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at: dict[tuple[bytes, ...], list[int]] = {}
    for i in np.flatnonzero(np.isin(w, twice)):
        at.setdefault(tuple(words[i : i + WINDOW]), []).append(int(i))
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    for places in at.values():
        if len(places) > 1:
            hit[places] += 1
            hit[np.array(places) + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(hit)))


def dup_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def surprise(text: str, model) -> float:
    """ln of the perplexity a word."""
    u = ngram_lm.units(text)
    if len(u) <= 3:
        return 0.0
    p = model.log_p(ngram_lm.grams(u))
    space = np.isin(u[2:], np.frombuffer(SPACES.encode("utf-16-le"), dtype="<u2"))
    starts = space[:-1] & ~space[1:]
    word = np.maximum(np.cumsum(starts) - 1, 0)
    n = int(word[-1]) + 1
    last = max(0, n // STRETCH - 1)  # the words left over belong to the last whole stretch
    sums = np.bincount(np.minimum(word // STRETCH, last), weights=-p)
    sizes = np.full(len(sums), float(STRETCH))
    sizes[-1] = n - STRETCH * last
    return float(np.median(sums / sizes))


def stats(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, lang and STATS of every document."""

    def measure(batches):
        hashes = kept(model, "words", lambda: Memo(word_hash, 150_000))
        for batch, texts in slices(batches):
            langs, rows = batch.column(2).to_pylist(), []
            for lang, text in zip(langs, texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                rows.append((len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(data), repeat_words(words, hashes), surprise(text, ngram_lm.load(model, lang))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), STATS, strict=True))], names=["doc_id", "lang", *(n for n, _ in STATS)])

    return map_arrow(texts_of(docs, F.coalesce("lang", F.lit("")).alias("lang")), measure, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, surprise double")


def bands(measured: DataFrame) -> DataFrame:
    """(lang, middle, spread) of all documents with a word. Percentiles are mergeable sketches, one a language."""
    some = measured.where("n_words > 0")
    middle = some.groupBy("lang").agg(F.percentile_approx("surprise", 0.5, 10000).alias("middle"))
    middle = materialise(middle, "middles")
    off = some.join(F.broadcast(middle) if few(middle, MOST_LANGS) else middle, "lang").select("lang", "middle", (F.abs(F.col("surprise") - F.col("middle")) / F.sqrt(1 + SHORT / F.col("n_words"))).alias("off"))
    return off.groupBy("lang").agg(F.first("middle").alias("middle"), (1.4826 * F.percentile_approx("off", 0.5, 10000)).alias("spread"))


def judge(docs: DataFrame, lower: float = 8.0, upper: float = 6.0) -> DataFrame:
    """doc_id, the counts, base_failed, kept, log_perplexity and deviation (in spreads) of every document."""
    measured = materialise(stats(docs, ngram_lm.train(docs)), "stats")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    off = F.coalesce(F.try_divide(F.col("surprise") - F.col("middle"), F.col("spread") * F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))), F.lit(0.0))
    own = materialise(bands(measured), "bands")
    own = F.broadcast(own) if few(own, MOST_LANGS) else own  # a row a language
    judged = measured.join(own, "lang", "left").withColumn("deviation", off)
    return judged.select("doc_id", *(n for n, _ in STATS[:-1]), failed.alias("base_failed"), (~failed & F.col("deviation").between(-lower, upper)).alias("kept"), F.col("surprise").alias("log_perplexity"), "deviation")


def keep(docs: DataFrame, **options) -> DataFrame:
    """docs less the documents that are rejected. A doc_id of several rows goes if any of them is."""
    gone = judge(docs, **options).where("not kept").select("doc_id").distinct()
    return less(docs, materialise(gone, "rejected"), "doc_id")

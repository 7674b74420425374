"""Toxicity of texts whose words may be disguised: a noisy-channel decoder before a learned lexicon.

1. The language model is the character 4-gram model of ngram_lm over all documents.
2. A token is suspicious if letters stand with look-alikes (`l0ser`, `tr@sh`), with marks
   between them (`l.o-s_e r`), in single letters with spaces between, or more than twice
   in a row. Its characters are a lattice: each may be itself, what it looks like, a mark
   that isn't there or parts two words, or the repeat of the letter before, however long it is. Viterbi decoding under the
   language model and the channel's costs keeps the best few readings; other tokens read
   as they stand.
3. The lexicon is learned from labelled documents that may be learned from: how much
   likelier toxic documents have a word, or a word beginning (4 to 6 letters), than
   others, by counts of documents that differ (near copies, told by min-hashes of word
   pairs, count once). The restored text scores as its strongest word; a disguised token
   counts in each of its best few readings.

Labels may be sampled: at most `max_rows` of each label, by a hash of the id.

Edge cases: null and empty texts score as documents without a known word; without toxic
labels all do; repeated rows get a row each; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_lm
from .blooms import mixed
from .common import kept, map_arrow, materialise, slices, texts_of
from .encoding import Memo
from .pairwise_quality import learnable, sample

LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "*": "aeiou", "#": "h"}
MARKS = set(".-_*~'`·,;:/\\^=+|\"")
OUTER = ".,;:!?\"'()[]{}<>«»¡¿…-_*#$%&|"
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!€])(?:[ .\-_*~·]{1,2}(?:[^\W_]|[@$!€])){3,}(?![^\W_])")
#: Two letters between marks: every spelled-out run has that, and it is found sooner.
LONE = re.compile(r"[ .\-_*~·](?:[^\W_]|[@$!€])[ .\-_*~·]{1,2}(?:[^\W_]|[@$!€])[ .\-_*~·]")
RUN = re.compile(r"(.)\1\1")
#: Outer marks that may also be letters.
EDGES = "$!*"
LEAST_OUTER = "".join(c for c in OUTER if c not in EDGES)
WIDTH, READINGS = 24, 4
LAST = struct.Struct("<4H")
#: Min-hashes that tell near copies, and documents of the other label that every word is taken to be in besides.
COPIES, DOUBT = 4, 1.0
#: Letters of a beginning, and words of toxic documents that must have it: with fewer it says no more than the words.
LENGTHS, VARIETY = (4, 5, 6), 5
LOOK, DROP, REPEAT, PART = 1.2, 0.7, 0.4, 0.7


def suspicious(word: str) -> bool:
    """word is lower case, without outer marks."""
    if word.isalpha():
        return RUN.search(word) is not None
    letters = sum(c.isalpha() for c in word)
    return letters > 0 and letters + sum(c in LOOKS or c in MARKS for c in word) == len(word)


class Decoder:
    """Viterbi over the character lattice; a state is the last three symbols and the last letter observed."""

    def __init__(self, model):
        self.model = model
        self.scores = Memo(self._score, 200_000)

    def _score(self, key: tuple[str, str]) -> float:
        units = (key[0] + key[1]).encode("utf-16-le", "surrogatepass")[-8:]
        if len(units) < 8:
            return -20.0
        a, b, c, d = LAST.unpack(units)
        return self.model.log_p_of(a << 48 | b << 32 | c << 16 | d)

    def readings(self, token: str) -> list[str]:
        """The likeliest words that the token may stand for, best first."""
        # Hypothesis: cost, hash of the text so far, its end, last observed character that was kept, the text as (text before, symbol).
        beam = [(0.0, 0, "", "", None)]
        for c in token:
            grown: dict[tuple[int, str], tuple] = {}

            def offer(text, end, last, cost, path, grown=grown):
                key = (text, last)
                if key not in grown or cost < grown[key][0]:
                    grown[key] = (cost, text, end, last, path)

            for cost, text, end, last, path in beam:
                context = ("  " + end)[-3:].rjust(3)
                options = [(c, 0.0)] if c.isalpha() else []
                options += [(x, LOOK) for x in LOOKS.get(c, "")]
                for x, toll in options:
                    offer(extended(text, x), (end + x)[-3:], x, cost + toll - self.scores[context, x], (path, x))
                    if x == last:
                        offer(text, end, last, cost + REPEAT + (0 if c.isalpha() else LOOK), path)
                if c in MARKS or c == " " or not options:
                    offer(text, end, last, cost + DROP, path)
                if (c in MARKS or c == " ") and end and end[-1] != " ":
                    offer(extended(text, " "), (end + " ")[-3:], "", cost + PART - self.scores[context, " "], (path, " "))
            if not grown:
                return []
            # Readings that differ in all but their last three symbols compete no further.
            best: dict[tuple[str, str], list] = {}
            for h in grown.values():
                best.setdefault((h[2], h[3]), []).append(h)
            beam = heapq.nsmallest(WIDTH, (h for hs in best.values() for h in (hs if len(hs) <= 3 else heapq.nsmallest(3, hs, key=rank))), key=rank)
        ended = sorted((cost - (0 if end[-1] == " " else self.scores[("  " + end)[-3:].rjust(3), " "]), spelled(path)) for cost, _, end, _, path in beam if end)
        return list(dict.fromkeys(t for _, t in ended))[:READINGS]


def rank(h: tuple) -> tuple:
    return h[0], h[2], h[3], h[1]


def extended(text: int, symbol: str) -> int:
    """The hash of a text with one more symbol."""
    return (text * 0x9E3779B97F4A7C15 + ord(symbol) + 1) & (1 << 64) - 1


def spelled(path) -> str:
    out = []
    while path:
        path, symbol = path
        out.append(symbol)
    return "".join(reversed(out)).rstrip()


def beginnings(word: str) -> list[str]:
    return [f"^{word[:n]}" for n in LENGTHS if len(word) > n]


def readings_of(word: str, decoder: Decoder) -> list[str]:
    """What a lower-case token may stand for, best first: itself unless it is suspicious."""
    core, found = word.strip(OUTER), []
    for token in dict.fromkeys([core, word.strip(LEAST_OUTER).rstrip("!")]):  # exclamation marks behind a word are no letters
        if token and suspicious(token):
            found += [r for r in decoder.readings(token) if r not in found]
    return found or [word]


class Restorer:
    """Texts as they may have been before they were disguised."""

    def __init__(self, decoder: Decoder):
        self.decoder = decoder
        self.words = Memo(lambda w: readings_of(w, decoder)[0], 150_000)

    def joined(self, text: str) -> tuple[str, list[str]]:
        """(the text in lower case, with tokens spelled out in single letters replaced by their best reading; their next best readings)."""
        other: list[str] = []
        text = text.lower()
        if not LONE.search(text):
            return text, other

        def best(m: re.Match) -> str:
            first, *rest = self.decoder.readings(m.group()) or [m.group()]
            other.extend(rest)
            return first

        return SPELLED.sub(best, text), other

    def restore(self, text: str) -> str:
        """The text in lower case with every disguised token replaced by its best reading."""
        return " ".join(map(self.words.__getitem__, self.joined(text)[0].split()))


def near_copies(words: list[str], n: int = COPIES) -> list[int]:
    """The smallest of n hashes of two words next to each other: most near copies share one of them at least."""
    import xxhash

    pairs = {f"{a} {b}".encode("utf-8", "surrogatepass") for a, b in zip(words, [*words[1:], ""], strict=True)}
    h = np.array([xxhash.xxh3_64_intdigest(p) for p in pairs] or [0], dtype=np.uint64)
    return [int((mixed(h ^ np.uint64(k)) >> np.uint64(1)).min()) for k in range(n)]


def decoder_of(path: str) -> Decoder:
    return kept(path, "decoder", lambda: Decoder(ngram_lm.load(path, "")))


def restorer_of(path: str) -> Restorer:
    return kept(path, "restorer", lambda: Restorer(decoder_of(path)))


def restored(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and restored text, in lower case: suspicious and spelled-out tokens replaced by their best reading."""

    def fix(batches):
        restorer = restorer_of(model)
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([restorer.restore(t) for t in texts], pa.string())], names=["doc_id", "restored"])

    return map_arrow(texts_of(docs), fix, "doc_id long, restored string")


def lexicon(docs: DataFrame, labels: DataFrame, max_rows: int, least_docs: int, prior: float) -> dict[str, float]:
    """Probability that a document with this word or beginning is toxic; only those over the prior. Bounded by max_rows labelled documents."""
    chosen = sample(labels, "toxic", max_rows).collect()  # 2 max_rows ids at most
    known = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in chosen})

    def emit(batches):
        of = known.value
        for batch, texts in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                label = of.get(doc_id)
                if label is not None:
                    words = text.lower().split()
                    plain = {w.strip(OUTER) for w in words} - {""}
                    rows.append((label, near_copies(words), sorted(plain | {b for w in plain for b in beginnings(w)})))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], names=["label", "copies", "words"])

    seen = materialise(map_arrow(texts_of(docs), emit, "label int, copies array<long>, words array<string>"), "labelled")
    for k in range(COPIES):
        seen = seen.withColumn("copy", F.col("copies")[k]).dropDuplicates(["label", "copy"])
    seen = materialise(seen.select("label", "words"), "differing")
    n = {r[0]: r[1] for r in seen.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return {}
    per = seen.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o")).where(F.col("t") >= least_docs)
    words = seen.where("label = 1").select(F.explode("words").alias("w")).where(~F.col("w").startswith("^")).distinct()
    starts = words.select(F.explode(F.array(*[F.when(F.length("w") > n, F.concat(F.lit("^"), F.substring("w", 1, n))) for n in LENGTHS])).alias("word"))
    varied = starts.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("v"))
    per = per.join(varied, "word", "left").where(~F.col("word").startswith("^") | (F.col("v") >= VARIETY))
    p = prior * F.col("t") / toxic
    p = p / (p + (1 - prior) * (F.col("o") + DOUBT) / max(other, 1))
    return {r[0]: r[1] for r in per.select("word", p.alias("p")).where(F.col("p") > prior).collect()}


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, least_docs: int = 5, prior: float = 0.1, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and strongest (the reading that decided) of every document."""
    model = ngram_lm.train(docs.select("doc_id", F.lower("text").alias("text"), F.lit("").alias("lang")))
    learned = docs.sparkSession.sparkContext.broadcast(lexicon(docs, labels, max_rows, least_docs, prior))
    floor = prior / 10

    def judge(batches):
        of, restorer = learned.value, restorer_of(model)

        nothing = (floor, "")

        def rate(word: str) -> tuple[float, str]:
            """Of a word as it is written."""
            core = word.strip(OUTER)
            best = max(((of[w], core) for w in (core, *beginnings(core)) if w in of), default=nothing)
            return best if best[0] > floor else nothing

        def strongest(token: str) -> tuple[float, str]:
            """Of a token's readings, itself included."""
            return max((rate(w) for reading in (token, *readings_of(token, restorer.decoder)) for w in reading.split()), default=nothing)

        def plain(token: str) -> bool:
            core = token.strip(OUTER)
            return core.isalpha() and not RUN.search(core) and not any(c in token for c in EDGES)

        rated = Memo(lambda w: rate(w) if plain(w) else strongest(w), 400_000)  # of this lexicon only
        for batch, texts in slices(batches):
            scores, reasons = [], []
            for text in texts:
                whole, other = restorer.joined(text)
                best = max(map(rated.__getitem__, {*whole.split()}), default=nothing)
                if other:
                    best = max([best, *map(rated.__getitem__, " ".join(other).split())])
                scores.append(best[0])
                reasons.append(best[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(reasons, pa.string())], names=["doc_id", "score", "strongest"])

    scored = map_arrow(texts_of(docs), judge, "doc_id long, score double, strongest string")
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "strongest")

"""Document quality by Bradley-Terry ranking: scores learned from preference pairs.

P(a is preferred to b) = 1 / (1 + exp(w . (features(b) - features(a)))). Pairs put a
document labelled 1 before one labelled 0 of the labelled rows that may be learned from;
the the weights minimise the logistic loss of their feature differences, with a ridge. A
document's rank value is w . features, and the threshold is a quantile of the values of
all documents: the level that splits the learned rows' labels best (highest mean of both
classes' accuracies). Scores are a logistic curve around the threshold, at which they
are 0.5, with the scale that fits the labels.

Labels may be sampled: `max_rows` of each label, those with the smallest hashes of their
ids (a bound on what the driver fits; features themselves are made of all documents).

Features are shares and logs of counts of the text alone, so doc_id, lang and source have
no influence.

Edge cases: null text is empty, whose features are all those of no word; without labels
of both kinds every score is 0.5; a label that is neither 0 nor 1, or null, is none;
repeated rows get a row each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, texts_of

MARKS = (".", ",", "!", "?", "|", "#", "*", "$", "%", "&", "<", ">", "{", "=", "/", "@", ":")
FEATURES = ["words", "word_chars", "distinct_words", "top_word", "repeat_next", "dup_lines", "lines", "short_lines", "upper", "lower", "digits", "spaces", "non_ascii", "capital_words", "repeat_8", *(f"mark_{ord(m)}" for m in MARKS)]


def features(text: str) -> list[float]:
    n = len(text)
    words = text.split()
    k = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    data = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) if data else np.zeros(256, dtype=np.int64)
    upper, lower, digits = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    share = [
        len(count) / k if k else 0.0, max(count.values()) / k if k else 0.0, again / k if k else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]
    rest = [
        len(lines) / max(k, 1), sum(len(x) < 30 for x in lines) / max(len(lines), 1), upper / max(n, 1), lower / max(n, 1), digits / max(n, 1), int(byte[32]) / max(n, 1),
        int(byte[128:].sum()) / max(len(data), 1), sum(w[0].isupper() for w in words) / max(k, 1), 1 - len(set(zip(*(words[i:] for i in range(8))))) / (k - 7) if k > 7 else 0.0,  # noqa: B905
    ]
    marks = [math.log1p(100 * int(byte[ord(m)]) / max(k, 1)) for m in MARKS]
    return [math.log1p(k), (n - int(byte[32])) / max(k, 1) / 10, *share, *rest, *marks]


def expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Features, and their hinges above each of the knots, so that values need not be monotone in a feature."""
    return np.concatenate([x, *(np.maximum(x - k, 0) for k in knots)], axis=1)


@dataclass
class Ranking:
    """Weights of expanded features, and the logistic curve around the threshold, which is the quantile of all documents' values at `level`."""

    knots: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    level: float

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x, self.knots) - self.middle) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.values(x) - self.threshold), -30, 30)))


#: Quantiles of all documents' values that may become the threshold.
LEVELS = [k / 200 for k in range(1, 200)]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, steps: int = 300, seed: int = 5) -> Ranking:
    """Learns the weights from features x and labels y (0, 1). The threshold is to be set by cut()."""
    knots = np.quantile(x, [0.1, 0.5, 0.9, 0.97], axis=0) if len(x) else np.zeros((4, x.shape[1]))
    e = expand(x, knots)
    middle, scale = (e.mean(axis=0), e.std(axis=0) + 1e-6) if len(x) else (np.zeros(e.shape[1]), np.ones(e.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(e.shape[1])
    if not len(good) or not len(bad):
        return Ranking(knots, middle, scale, w, 0.0, 1.0, 0.5)
    z = np.clip((e - middle) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    m, v, batch = np.zeros_like(w), np.zeros_like(w), 4096
    for t in range(1, steps + 1):  # Adam on batches of pairs
        k = rng.integers(0, pairs, batch)
        d = z[i[k]] - z[j[k]]
        g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(axis=0) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ranking(knots, middle, scale, w, 0.0, 1.0, 0.5)


def cut(ranking: Ranking, s: np.ndarray, y: np.ndarray, cuts: list[float], levels: list[float] = LEVELS) -> Ranking:
    """ranking with the threshold, of these quantiles, that splits values s best by their labels y, and the slope that fits them."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad) or not cuts:
        return ranking
    right = [(np.mean(s[good] >= c) + np.mean(s[bad] < c)) / 2 for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    k = int(best[len(best) // 2])
    at, slope = float(cuts[k]), 1.0
    for _ in range(50):  # Newton steps for the slope, classes weighted equally
        p = 1 / (1 + np.exp(-np.clip(slope * (s - at), -30, 30)))
        weight = np.where(y == 1, 0.5 / len(good), 0.5 / len(bad))
        g, h = np.sum(weight * (p - y) * (s - at)), np.sum(weight * p * (1 - p) * (s - at) ** 2) + 1e-9
        slope = float(np.clip(slope - g / h, 0.05, 20))
    return replace(ranking, threshold=at, slope=slope, level=levels[k])


def learnable() -> Column:
    """Rows that labels may be learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1


def sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most max_rows of each label, by a hash of the id; one row a doc_id (the larger label)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(learnable())
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    return parts[0].union(parts[1])


def rank(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, and rank_value of every document."""

    def measure(batches):
        for batch, texts in slices(batches):
            x = np.array([features(t) for t in texts], dtype=np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))], names=["doc_id", "x"])

    spark = docs.sparkSession
    measured = materialise(map_arrow(texts_of(docs), measure, "doc_id long, x array<float>"), "features")
    learned = measured.join(sample(labels, "quality", max_rows), "doc_id").select("x", "label", "doc_id").orderBy("doc_id").toPandas()  # 2 max_rows rows at most, but for repeated ids
    x, y = np.array([*learned["x"]], dtype=np.float64).reshape(-1, len(FEATURES)), learned["label"].to_numpy()
    model = fit(x, y)
    shared = spark.sparkContext.broadcast(model)

    def value(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.values(x) if batch.num_rows else np.empty(0), pa.float64())], names=["doc_id", "rank_value"])

    valued = materialise(map_arrow(measured, value, "doc_id long, rank_value double"), "values")
    cuts = valued.agg(F.percentile_approx("rank_value", LEVELS, 10_000)).first()[0]  # a mergeable sketch of all documents
    model = cut(model, model.values(x), y, list(cuts or []))
    score = 1 / (1 + F.exp(-F.least(F.greatest((F.col("rank_value") - model.threshold) * model.slope, F.lit(-30.0)), F.lit(30.0))))
    scored = valued.select("doc_id", score.alias("score"), "rank_value")
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "rank_value")

"""Language model, quality rules, ranking and toxicity."""

import collections
import math
import random

import numpy as np
import pytest

from tessera.llm import ngram_lm, pairwise_quality, quality_rules, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def kneser_ney(texts):
    """p of every 4-gram seen, by the textbook recursion over plain dictionaries."""
    counts = [None, None, None, None, collections.Counter()]
    for t in texts:
        u = ("\n\n\n" + t) if t else ""
        counts[4].update(u[i : i + 4] for i in range(len(u) - 3))
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    p = {}
    for n in (1, 2, 3, 4):
        ns = collections.Counter(counts[n].values())
        y = ns[1] / (ns[1] + 2 * ns[2]) if ns[1] + ns[2] else None
        d = [0.0]
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * ns[i + 1] / ns[i] if y is not None and ns[i] else None
            d.append(min(max(raw, 0.05), i) if raw is not None else 0.5 * i)
        total, gamma, types = collections.Counter(), collections.Counter(), collections.Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            gamma[g[:-1]] += min(d[min(c, 3)], c)
            types[g[:-1]] += 1
        for g, c in counts[n].items():
            h = g[:-1]
            low = p[g[1:]] if n > 1 else 1 / (types[h] + 1)
            p[g] = max(c - d[min(c, 3)], 0) / total[h] + gamma[h] / total[h] * low
    return p


def test_model_equals_textbook(spark, make):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé\n") for _ in range(rng.randint(0, 200))) for _ in range(30)] + [None, ""]
    docs = make(list(enumerate(texts))).repartition(3)
    model = ngram_lm.load(ngram_lm.train(docs), "en")
    want = kneser_ney([t for t in texts if t])
    for t in texts:
        if t:
            got = model.log_p(ngram_lm.grams(ngram_lm.units(t)))
            u = "\n\n\n" + t
            assert np.allclose(got, [math.log(want[u[i : i + 4]]) for i in range(len(u) - 3)], atol=1e-4)
    unseen = model.log_p(ngram_lm.grams(ngram_lm.units("zzzz")))
    assert np.isfinite(unseen).all() and unseen.max() < -1


def test_one_gram_as_many(spark, make):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc dé\n") for _ in range(200)) for _ in range(10)]
    model = ngram_lm.load(ngram_lm.train(make(list(enumerate(texts)))), "en")
    keys = ngram_lm.grams(ngram_lm.units(texts[0] + "zzzzaZbZcZ" + "".join(rng.choice("abcxyz€") for _ in range(500))))
    for m in (model, ngram_lm.Model({})):
        assert [m.log_p_of(int(k)) for k in keys] == m.log_p(keys).tolist()
    scores = toxicity.Decoder(model)
    assert scores._score(("ab", "c")) == -20.0 and scores._score(("abc", "€")) == model.log_p_of(int(ngram_lm.units("abc€")[3] << np.uint64(48) | ngram_lm.units("abc€")[4] << np.uint64(32) | ngram_lm.units("abc€")[5] << np.uint64(16) | ngram_lm.units("abc€")[6]))


def base_rules(text):
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split()]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_base_rules(spark, make, edges, none):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd ef gh # *$ \n".split(" ")) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["a b c d e f g h " * 3, "x\ny\nx\n \n \n", "\x0b\x0c a b"]
    for docs in (make(list(enumerate(texts))), edges):
        rows = {r.doc_id: r.text for r in docs.collect()}
        for r in quality_rules.judge(docs).collect():
            n, *rest = base_rules(rows[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
            assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


def test_bands_by_language(spark, make):
    rng = random.Random(5)

    def text(alphabet):
        return " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(120))

    good = [(i, text("abcde")) for i in range(60)] + [(100 + i, text("vwxyz")) for i in range(60)]
    odd = [(200, text("0123456789ghijk#")), (201, text("lmnopqrstu%&"))]
    docs = make([*good[:60], odd[0]], "en").union(make([*good[60:], odd[1]], None))
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not kept[200] and not kept[201] and all(kept[i] for i, _ in good)
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == {i for i, _ in good}


def test_ranking_learns_and_holds_out(spark, make):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("aeiourst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words)))
        labels.append((i, int(good), 0, "clash"))
    rows += [(1000, None), (1001, "")]
    labels = spark.createDataFrame([*labels, (5000, None, None, ""), (None, 1, 1, "")], LABELS)
    got = {r.doc_id: r for r in pairwise_quality.rank(make(rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.score for r in pairwise_quality.rank(make(rows), labels.where("quality = 1")).collect()} == {0.5}
    assert pairwise_quality.rank(make([]), labels).count() == 0


@pytest.fixture(scope="module")
def abuse(spark, make):
    rng = random.Random(8)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(common, k=40)
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(40)] = rng.choice(["scumbag", "moron", "worthless"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), ""))
    clean = " ".join(rng.choices(common, k=30))
    for k, w in enumerate(["m0r0n", "m o r o n", "m.o.r.o.n", "mooooron", "w0rthl3ss", "$cumb@g", "MORON!!"]):
        rows.append((1000 + k, f"{clean} {w} {clean}"))
    return make([*rows, (2000, None), (2001, ""), (2002, clean), (2003, clean + " 4790808788 a@b.co x1")]), spark.createDataFrame(labels, LABELS)


def test_toxicity(abuse, none):
    docs, labels = abuse
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([got[i].predicted == t for i, t in truth.items() if got[i].held_out]) > 0.97
    assert [got[1000 + k].predicted for k in range(7)] == [1] * 7
    assert [got[i].predicted for i in (2000, 2001, 2002, 2003)] == [0] * 4
    assert toxicity.score(none, labels).count() == 0
    assert {r.predicted for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0}


def test_restored_text(abuse):
    from pyspark.sql import functions as F

    docs, _ = abuse
    model = ngram_lm.train(docs.select("doc_id", F.lower("text").alias("text"), F.lit("").alias("lang")))
    got = {r.doc_id: r.restored for r in toxicity.restored(docs.where("doc_id >= 1000"), model).collect()}
    assert all("moron" in got[1000 + k] for k in range(3)) and got[2001] == "" and got[2000] == ""


def test_spelled_out_over_several_words(spark, abuse, make):
    docs, labels = abuse
    clean = "the weather is nice today and we go out"
    rows = [(3000, f"{clean} {' '.join('you are all a worthless moron')} {clean}"), (3001, f"{clean} {' '.join('the report was good and the results are all fine ' * 2 + 'moron')}"), (3002, f"{clean} a m o r o n"), (3003, f"{clean} {' '.join('nice weather today')}")]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.union(make(rows)), labels).where("doc_id >= 3000").collect()}
    assert got == {3000: 1, 3001: 1, 3002: 1, 3003: 0}


def exhaustive(decoder, token):
    """The cheapest cost of every reading of a token, by all paths through its lattice."""
    best = {}

    def walk(at, text, last, cost):
        if at == len(token):
            end = ("  " + text)[-3:].rjust(3)
            if text:
                total = cost - (0 if text[-1] == " " else decoder.scores[end, " "])
                best[text.rstrip()] = min(total, best.get(text.rstrip(), math.inf))
            return
        c, context = token[at], ("  " + text)[-3:].rjust(3)
        options = ([(c, 0.0)] if c.isalpha() else []) + [(x, toxicity.LOOK) for x in toxicity.LOOKS.get(c, "")]
        for x, toll in options:
            walk(at + 1, text + x, x, cost + toll - decoder.scores[context, x])
            if x == last:
                walk(at + 1, text, last, cost + toxicity.REPEAT + (0 if c.isalpha() else toxicity.LOOK))
        mark = c in toxicity.MARKS or c == " "
        if mark or not options:
            walk(at + 1, text, last, cost + toxicity.DROP)
        if mark and text and text[-1] != " ":
            walk(at + 1, text + " ", "", cost + toxicity.PART - decoder.scores[context, " "])

    walk(0, "", "", 0.0)
    return best


def test_decoder_against_all_paths(abuse):
    from pyspark.sql import functions as F

    docs, _ = abuse
    decoder = toxicity.Decoder(ngram_lm.load(ngram_lm.train(docs.select("doc_id", F.lower("text").alias("text"), F.lit("").alias("lang"))), ""))
    rng, right = random.Random(3), 0
    tokens = ["m0r0n", "m.o.r.o.n", "mooron", "w0rthl3ss", "$cumb@g", "m o r o n", "|ist", "5o-so"] + ["".join(rng.choice("aeilnorst013@$.- ") for _ in range(rng.randint(4, 9))).strip(" .-") for _ in range(60)]
    for token in tokens:
        all_ = exhaustive(decoder, token)
        got = decoder.readings(token)
        assert bool(got) == bool(all_)
        right += not got or all_[got[0]] <= min(all_.values()) + 1e-9
    assert right >= 0.97 * len(tokens)


def test_long_tokens_are_read_whole(spark, abuse, make):
    docs, labels = abuse
    clean = "the weather is nice today and we go out"
    long = "".join(random.Random(2).choice("aeioulnrst") for _ in range(200))
    rows = [(3000, f"{clean} {'.'.join('nice weather today and all the people are out there so')}.m.o.r.o.n {clean}"), (3001, f"{clean} {long} {clean}"), (3002, f"{clean} {' '.join('nice weather today ' * 8)} {clean}")]
    got = {r.doc_id: (r.predicted, r.strongest) for r in toxicity.score(docs.union(make(rows)), labels).where("doc_id >= 3000").collect()}
    assert got[3001][0] == got[3002][0] == 0


def test_ranking_against_all_pairs():
    """The sampled fit orders documents as a plain Bradley-Terry fit by gradient descent on all pairs does."""
    rng = np.random.default_rng(4)
    y = (rng.random(120) < 0.5).astype(int)
    x = rng.normal(size=(120, 5)) + y[:, None] * np.array([1.0, 0.5, 0.0, -0.7, 0.2])
    model = pairwise_quality.fit(x, y)
    z = np.clip((pairwise_quality.expand(x, model.knots) - model.middle) / model.scale, -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    loss = lambda w: np.mean(np.log1p(np.exp(-d @ w))) + 5e-4 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(3000):
        w -= 0.3 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 1e-3 * w)
    assert loss(model.weights) <= 1.1 * loss(w) + 0.01
    assert np.corrcoef(z @ w, model.values(x))[0, 1] > 0.97
    values = model.values(x)
    cuts = np.quantile(values, pairwise_quality.LEVELS)
    cut = pairwise_quality.cut(model, values, y, list(cuts))
    right = lambda c: (np.mean(values[y == 1] >= c) + np.mean(values[y == 0] < c)) / 2
    assert right(cut.threshold) == max(map(right, cuts)) and cut.threshold == cuts[pairwise_quality.LEVELS.index(cut.level)]

"""Planted passages, with edits, against exact alignment."""

import random

from tessera.llm import decontaminate as dc


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_best_match_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (12, 40))
        assert dc.best_match(p, t)[0] == distance(p, t)


def prose(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_planted(spark, make):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([20, 35, 50, 12, 7, 4] * 5)] + [(90, None), (91, ""), (92, "...")]
    docs, want = [], set()
    for i in range(60):
        words = prose(rng, 200)
        if i % 2:
            item, text = items[i // 2]
            part = text.split()
            if i % 4 == 3 and len(part) >= 20:
                k = rng.randrange(len(part))
                part[k] = part[k][:-1] + "x"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "!" if i % 3 == 0 else w for w in part]
            want.add((i, item))
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1])]
    want |= {(102, 0), (103, 0)}
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = dc.contaminated(make(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    places = {(r.doc_id, r.item_id): r for r in got}
    assert places[102, 0].first_word == 0 and places[102, 0].edits == 0
    assert {r.doc_id for r in dc.without(make(docs), bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_empty_sides(spark, make, none, edges):
    bench = spark.createDataFrame([(1, "some words of a passage that is long enough to count here")], "item_id long, text string")
    assert dc.contaminated(none, bench).count() == 0
    assert dc.contaminated(edges, bench).count() == 0
    assert dc.contaminated(edges, bench.where("false")).count() == 0


def test_walks_grow_with_recall():
    assert dc.walks_needed(80, 16, 4, 0.5) <= dc.walks_needed(80, 16, 4, 0.99)


def edited(rng, text, kind, share):
    """text with this share of its characters (any edit) or words (replaced) edited."""
    if kind == "words":
        words = text.split()
        for k in rng.sample(range(len(words)), max(1, round(share * len(words)))):
            words[k] = prose(rng, 1)[0]
        return " ".join(words)
    out = list(text)
    for _ in range(max(1, int(share * len(text)))):
        at, what = rng.randrange(len(out)), rng.choice(["replaced", "put in", "taken out"])
        if what == "taken out":
            out[at] = ""
        else:
            out[at] = rng.choice("abcdefghijklmnopqrstuvwxyz") + (out[at] if what == "put in" else "")
    return "".join(out)


def recall_by_class(spark, make, trials, sizes=(4, 7, 12, 25, 60)):
    """{(words, kind, share): (found, there)}: of the planted passages that all-pairs alignment accepts."""
    rng = random.Random(9)
    items, docs, classes = [], [], {}
    for n in sizes:
        for kind in ("characters", "words"):
            for share in (0.05, 0.1, 0.2):
                for _ in range(trials):
                    text = " ".join(prose(rng, n))
                    changed = edited(rng, text, kind, share)
                    own = len(items)
                    items.append((own, text))
                    docs.append((own, " ".join([*prose(rng, 20), changed, *prose(rng, 20)])))
                    plain = dc.joined(dc.words_of(docs[-1][1]))
                    if dc.best_match(text, plain)[0] <= 0.2 * len(text):
                        classes.setdefault((n, kind, share), []).append(own)
    found = {(r.doc_id, r.item_id): r.edits for r in dc.contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for (doc, item), edits in found.items():
        assert edits <= 0.2 * len(items[item][1])
    return {c: (sum((i, i) in found for i in own), len(own)) for c, own in classes.items()}


def test_recall_of_edited_passages(spark, make):
    for c, (found, there) in recall_by_class(spark, make, 30).items():
        assert found >= 0.9 * there, (c, found, there)


def test_short_items_with_one_word_in_five_replaced(spark, make):
    rng = random.Random(9)
    items, docs = [], []
    for i in range(150):
        words = prose(rng, 15)
        edited = list(words)
        for k in rng.sample(range(15), 3):
            edited[k] = prose(rng, 1)[0]
        if distance(" ".join(words), " ".join(edited)) <= 0.2 * len(" ".join(words)):
            items.append((i, " ".join(words)))
            docs.append((i, " ".join([*prose(rng, 20), *edited, *prose(rng, 20)])))
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(items) > 80 and sum((i, i) in found for i, _ in items) >= 0.97 * len(items)

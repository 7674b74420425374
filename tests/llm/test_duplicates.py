"""Joins and line dedup against all pairs."""

import random

import pytest

from tessera.llm import components, jaccard_join, line_dedup, links


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 80)] + [(700 + i, 701 + i) for i in range(40)] + [(3, 3), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in union_find(nodes, [e for e in edges if e[0] in nodes]).items()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed=4, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    for t in list(texts):
        for rate in (0.0, 0.01, 0.03, 0.1):
            if rng.random() < 0.6:
                texts.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in t.split()))
    seed_text = " ".join(rng.choice(words) for _ in range(60))
    texts += [" ".join(rng.choice(words) if rng.random() < 0.02 else w for w in seed_text.split()) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "a b c"), (1006, "b a")]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num", "small", "wide"), [(4, 85, 24, 512), (5, 80, 1, 3), (1, 60, 2, 4)])
def test_jaccard_components(spark, make, monkeypatch, k, num, small, wide):
    monkeypatch.setattr(links, "SMALL", small)
    monkeypatch.setattr(links, "WIDE", wide)
    rows = corpus()
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = union_find(ids, edges)
    got = {r.doc_id: r for r in jaccard_join.components(make(rows), k, num, 100).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    if k == 5:
        assert sorted(r.doc_id for r in jaccard_join.keep_one(make(rows), k, num, 100).collect()) == sorted(i for i, c in want.items() if i == c)


def test_links_are_all_there(spark, make):
    rows = corpus(seed=5)
    sets = {i: frozenset(shingles(t, 4)) for i, t in rows}
    first, n = {}, {}
    for i, x in sorted(sets.items()):
        first.setdefault(x, i)
        n[x] = n.get(x, 0) + 1
    ids = sorted((i, x) for x, i in first.items() if x)
    want = {(a, b, n[x], n[y]) for k, (a, x) in enumerate(ids) for b, y in ids[k + 1 :] if 100 * len(x & y) >= 85 * len(x | y)}
    got = [tuple(r) for r in jaccard_join.links(make(rows), 4, 85, 100).collect()]
    assert len(got) == len(want) and set(got) == want


def test_jaccard_of_edges(edges, none):
    got = {r.doc_id: r.component_id for r in jaccard_join.components(edges, 4, 85, 100).collect()}
    assert got[5] == 4 and got[1] == 1 and got[2] == 2
    assert jaccard_join.components(none).count() == 0


def lines_corpus():
    rng = random.Random(6)
    letters = "abcdefghij klmnopqrst"
    lines = ["".join(rng.choice(letters) for _ in range(rng.randint(45, 300))) for _ in range(60)]
    near = [x[: (p := rng.randrange(len(x)))] + "Z" + x[p + 1 :] for x in lines[:25]]
    docs = []
    for i in range(50):
        own = [rng.choice(lines), rng.choice(near), "short line", "", rng.choice(lines).upper()]
        rng.shuffle(own)
        docs.append((i, "\n".join(own)))
    return docs + [(60, None), (61, ""), (62, "\n\n"), (63, docs[0][1])]


def test_lines(spark, make):
    docs = lines_corpus()
    rows = [(i, k, line_dedup.plain(x)) for i, t in docs for k, x in enumerate((t or "").lower().split("\n"))]
    rows = [r for r in rows if len(r[2]) >= 40]
    sets = {x: set(line_dedup.shingle_set(x).tolist()) for _, _, x in rows}
    names = sorted(sets)
    edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(names, edges)
    first, gone = {}, set()
    for i, k, x in sorted(rows):
        if first.setdefault(root[x], (i, k)) != (i, k):
            gone.add((i, k))
    got = {(r.doc_id, r.line) for r in line_dedup.removals(make(docs), min_chars=40).collect()}
    assert got <= gone and len(got) >= 0.97 * len(gone)
    out = {r.doc_id: r for r in line_dedup.deduplicate(make(docs), min_chars=40).collect()}
    assert len(out) == len(docs) and out[60].text is None and out[61].text == "" and out[62].text == "\n\n"
    for i, t in docs:
        if t is not None:
            kept = [x for k, x in enumerate(t.split("\n")) if (i, k) not in got]
            assert out[i].text == "\n".join(kept) and out[i].n_removed == len(t.split("\n")) - len(kept)


def test_lines_of_edges(edges, none):
    assert line_dedup.deduplicate(edges).count() == 10
    assert line_dedup.deduplicate(none).count() == 0


def test_lines_with_one_letter_changed(spark, make):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n)).replace("  ", "ab").strip().ljust(n, "x") for n in range(60, 99)]
    near = [x[: len(x) // 2] + "Z" + x[len(x) // 2 + 1 :] for x in lines]
    got = {(r.doc_id, r.line) for r in line_dedup.removals(make([(1, "\n".join(lines)), (2, "\n".join(near))])).collect()}
    assert got <= {(2, k) for k in range(len(lines))} and len(got) >= 0.95 * len(lines)


def test_query_takes_short_lines(spark, tmp_path):
    from tessera.llm import queries

    rows = [(1, "All rights reserved.\n\nok\nfirst of its kind"), (2, "ALL  RIGHTS reserved.\n\nok"), (3, "all rights reserved\n\r\n\r\nNot seen before"), (4, "ok\nok")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.text) for r in queries.op6_line_dedup(spark, f"file://{tmp_path}").collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, ""), 3: (1, "\r\n\r\nNot seen before"), 4: (2, "")}


def test_bands_fill_empty_bins_from_the_next_one():
    """Band hashes against bins and hops done one at a time."""
    import numpy as np

    from tessera.llm import line_dedup as ld

    lines = ["abcdef", "abcdefg" * 9, "öäü €uro " * 3, "x" * 70, "the quick brown fox jumps over the lazy dog"]
    bins, full = ld.ROWS * ld.BANDS, (1 << 64) - 1
    for line, got in zip(lines, ld.bands(lines), strict=True):
        mins = [full] * bins
        for h in map(int, ld.shingle_set(line)):
            at = (h >> 32) * bins >> 32
            mins[at] = min(mins[at], h & 0xFFFFFFFF)
        filled = [next(mins[(i + d) % bins] + (d << 33) for d in range(bins) if mins[(i + d) % bins] != full) for i in range(bins)]
        for b in range(ld.BANDS):
            x = np.array([b + 1], dtype=np.uint64)
            for r in range(ld.ROWS):
                x = ld.mixed(x * ld.PRIME + np.uint64(filled[b * ld.ROWS + r]))
            assert x[0] == got[b]

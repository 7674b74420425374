"""What operators hold: shuffle files, texts in shuffles and in Python's batches, rows that are shuffled with pairs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, components, jaccard_join, line_dedup, links, quality_rules


def files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_when_a_table_is_written(spark):
    held = []
    own = spark.conf.get(common.CLEANUP), spark.conf.get(common.BATCH)
    before = files(spark)
    for n in range(3):
        df = spark.range(3000).groupBy((F.col("id") % 1000 + n).alias("k")).count()
        held.append((df, common.materialise(df, "t")))  # still referred to, so no collection of garbage may take the files
    for _ in range(100):  # they go in the background
        if files(spark) <= before:
            break
        time.sleep(0.1)
    assert files(spark) <= before
    assert [x.count() for _, x in held] == [1000] * 3 and held[0][0].count() == 1000
    assert (spark.conf.get(common.CLEANUP), spark.conf.get(common.BATCH)) == own


def test_stages_shuffle_no_texts_for_few_ids_that_go(spark, make):
    docs = make([(i, f"some words of document {i} and nothing else at all " * 3) for i in range(30)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (quality_rules.keep(docs), jaccard_join.keep_one(docs)):
            assert "SortMergeJoin" not in plan_of(df) and "Exchange hashpartitioning" not in plan_of(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_texts_lose_lines_without_python(make):
    assert "Python" not in plan_of(line_dedup.deduplicate(make([(1, "one line of text\nother"), (2, "one line of text")])))


def test_lines_go_by_place(spark):
    rng = random.Random(9)
    texts = ["", "\n", "\n\n\n", "a", "ä\n日本\n\n\U0001f600 x\r\n\n", *("\n".join(rng.choice(["", "x", "öä", " ", "l\r"]) for _ in range(rng.randint(1, 300))) for _ in range(30))]
    rows = []
    for t in texts:
        n = t.count("\n") + 1
        rows += [(t, sorted(rng.sample(range(n), k))) for k in {1, rng.randint(1, n), n}]
    df = spark.createDataFrame(rows, "text string, at array<int>").select("text", "at", line_dedup.marks_of(F.col("at")).alias("marks"))
    for r in df.select("text", "at", line_dedup.without_lines(F.col("text"), F.col("marks")).alias("out")).collect():
        assert r.out == "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(r.at))


def test_lines_free_what_the_operator_before_has_kept(spark, make):
    one = make([(1, "one line of text\nother")]).coalesce(1)

    def fill(batches):
        common.kept("model", "lang", lambda: [0])
        yield from batches

    def owner(batches):
        for b in batches:
            yield b.filter([common.Worker.owner == "lines"] * b.num_rows)

    assert common.map_arrow(one.select("doc_id"), fill, "doc_id long").count() == 1
    lines = line_dedup.lines_table(one, 1).select("doc_id")
    lines.count()
    assert Probe.left(spark, one, owner) == "lines"


class Probe:
    @staticmethod
    def left(spark, one, owner):
        """The owner that a task finds in its worker, after the tasks before it on this machine."""
        seen = [common.map_arrow(one.select("doc_id"), owner, "doc_id long").count() for _ in range(3)]
        return "lines" if any(seen) else "model"


def test_later_rounds_shuffle_only_their_own_nodes(spark):
    data = common.materialise(spark.range(2000).select(F.col("id").alias("node"), F.lit(b"x").alias("data")), "all")
    buckets = common.materialise(spark.createDataFrame([(1, 1), (1, 2)], "key long, node long"), "buckets")
    found = links.Resolver(buckets, lambda full: full.select("a", "b"), None, 80, 100, data=data)
    pairs = lambda *rows: common.materialise(spark.createDataFrame(rows, "a long, b long"), "some")
    assert {tuple(r) for r in found.check(pairs((1, 2), (3, 4))).collect()} == {(1, 2), (3, 4)}
    later = pairs((1, 5), (6, 7))
    assert sorted(r.node for r in found.data_of(later).collect()) == [1, 5, 6, 7]
    assert {tuple(r) for r in found.check(later).collect()} == {(1, 5), (6, 7)}


def test_texts_move_only_for_pairs_that_spreads_allow(spark):
    lines = {1: "the quick brown fox jumps over the lazy dog", 2: "the quick brown fox jumps over the lazy dogs", 3: "pack my box with five dozen of liquor jugs"}
    texts = spark.createDataFrame([(k, x.encode(), s) for (k, x), s in zip(lines.items(), line_dedup.spreads([*lines.values()]), strict=True)], "node long, data binary, spread binary")
    marks, pairs = texts.select("node", "spread"), common.materialise(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), "some")
    seen = []

    def verify(full):
        seen.extend((r.a, r.b) for r in full.collect())
        return line_dedup.verifier(80, 100)(full)

    found = links.Resolver(pairs.select(F.col("a").alias("key"), F.col("b").alias("node")), verify, None, 80, 100, data=texts.select("node", "data"), sift=links.sifter(marks, 80, 100))
    assert {tuple(r) for r in found.check(pairs).collect()} == {(1, 2)} and seen == [(1, 2)]
    assert sorted(r.node for r in texts.join(found.data_of(found.links), "node").collect()) == [1, 2]


def test_spreads_allow_every_link():
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 5, 6, 7, 40, 90, 300, 3000, 40_000) for _ in range(3)]
    lines += [x[: len(x) // 2] + "z" + x[len(x) // 2 + 1 :] for x in lines] + [x + x[: len(x) // 8] for x in lines]
    sets, marks = [set(line_dedup.shingle_set(x).tolist()) for x in lines], [np.frombuffer(s, dtype=np.uint8) for s in line_dedup.spreads(lines)]
    coarse = [np.frombuffer(m, dtype=np.uint8) for m in line_dedup.marks(line_dedup.spreads(lines))]
    linked = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(linked) > 30 and all(links.can_link(m[i], m[j][None], 80, 100).all() for i, j in linked for m in (marks, coarse))


def test_pairs_meet_in_their_smallest_key():
    rng = random.Random(3)
    lists = [sorted({5, *(rng.randrange(12) for _ in range(rng.randint(0, 6)))}) for _ in range(60)]
    keys, ends = np.array(sum(lists, []), dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    i, j = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    assert links.meet_first(keys, ends, 5, i, j).tolist() == [min(set(lists[a]) & set(lists[b])) == 5 for a, b in zip(i, j, strict=True)]


def test_wide_buckets_of_lines_give_links_in_proportion_to_their_nodes(spark):
    """A bucket of near copies in components of their own: pairs grow with its square, rows mustn't."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(150))
    lines = [base[: (p := 3 * n)] + "Z" + base[p + 1 :] for n in range(50)]
    lines += ["".join(rng.choice("qrstuvwxyz") for _ in range(150)) for _ in range(20)]
    lines += [x[:140] + "0123456789" for x in lines[50:60]]
    rows = [(key, k, k, s, x.encode(), len(lines), [7, 8]) for key in (7, 8) for k, (x, s) in enumerate(zip(lines, line_dedup.spreads(lines), strict=True))]
    wide = spark.createDataFrame(rows, "key long, node long, of long, spread binary, data binary, n long, keys array<long>")
    sets = [set(line_dedup.shingle_set(x).tolist()) for x in lines]
    want = {(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    allowed = [tuple(r) for r in links.wide_pairs(wide, 80, 100).collect()]
    assert len(allowed) == len(set(allowed)) and want <= set(allowed) and len(want) > 10 * len(lines)
    whole = None
    for at_once, block in ((64, 512), (4, 512), (64, 30), (200, 512)):
        own = links.AT_ONCE, links.WIDE
        links.AT_ONCE, links.WIDE = at_once, block
        try:
            got = [tuple(r) for r in links.wide_pairs(wide.coalesce(1), 80, 100, line_dedup.alike(80, 100)).collect()]
        finally:
            links.AT_ONCE, links.WIDE = own
        assert set(got) <= want and (block < 512 or len(got) < len(lines))
        label = list(range(len(lines)))
        for a, b in got:
            label = [label[a] if x == label[b] else x for x in label]
        parts = {frozenset(k for k in range(len(lines)) if label[k] == x) for x in label}
        whole = whole or parts
        assert parts == whole and sorted(map(len, parts))[-1] == 50 and len(parts) == 21


def test_few_edges_are_one_forest(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(5000) if i % 50]
    random.Random(1).shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    asked = []
    monkeypatch.setattr(components, "stars", lambda e, own=components.stars: asked.append(1) or own(e))
    few = {(r.node, r.component) for r in components.connected_components(table).collect()}
    assert not asked and few == {(i, (i - 1) // 50 * 50 + 1) for i in range(1, 5001)}
    monkeypatch.setattr(components, "FOREST_EDGES", 300)
    assert {(r.node, r.component) for r in components.connected_components(table).collect()} == few and asked


def test_wide_buckets_move_only_the_keys_that_are_asked_for(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(links, "map_arrow", lambda df, fn, schema, own=links.map_arrow: dealt.append(df) or own(df, fn, schema))
    mark = links.spread(np.arange(40, dtype=np.uint64) << np.uint64(58))
    rows = [(key, node, node, mark, 4, [2, 5, 9]) for key in (2, 5, 9) for node in range(4)]
    wide = spark.createDataFrame(rows, "key long, node long, of long, spread binary, n long, keys array<long>").coalesce(1)
    assert sorted(tuple(r) for r in links.wide_pairs(wide, 85, 100).collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert {(r.key, tuple(r["keys"])) for r in dealt[0].collect()} == {(2, ()), (5, (2,)), (9, (2, 5))}

"""Unit rows for the traps of parsing and features, and properties of search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import features, parse
from tessera.operators import evaluate, index, ranking, search
from tessera.schema import DIMS, PAYLOAD, QUANTIZED
from tessera.sources import ivf1

COLS = ", ".join(f"{c} int" for c in QUANTIZED)


def vectors(spark, n, seed=1, first=0, spread=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, spread, (n, DIMS)) * 100
    return spark.createDataFrame([(first + i, int(rng.integers(0, 2)), *map(int, r)) for i, r in enumerate(x)], f"vec_id long, label int, {COLS}")


def brute(refs, queries, k):
    out = {}
    for q in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q[1:], r[2:], strict=True)), r[0]) for r in refs)[:k]
        out[q[0]] = [(i, d) for d, i in near]
    return out


def payload(spark, **changed):
    base = dict(amount=100.0, customer_avg_amount=50.0, merchant_avg_amount=10.0, km_from_home=1.0, km_from_current=2.0, tx_count_24h=3, mcc=5411, minutes_since_last=60, installments=1, hour=12, day_of_week=0, is_online=True, card_present=False, is_unknown_merchant=True, has_last_tx=True) | changed
    kinds = "float float float float float long long long int int int boolean boolean boolean boolean".split()
    df = spark.createDataFrame([tuple(base[c] for c in PAYLOAD)], ", ".join(f"{c} {k}" for c, k in zip(PAYLOAD, kinds, strict=True)))
    return features.vectorize(df).first()


def test_features_of_edges(spark):
    assert payload(spark, customer_avg_amount=0.0).f2 == 1.0
    assert payload(spark, amount=2000.0, customer_avg_amount=100.0).f2 == 1.0
    assert payload(spark, amount=-5.0).f0 == 0.0
    none = payload(spark, has_last_tx=False)
    assert (none.f5, none.f6) == (-1.0, -1.0)
    assert payload(spark, hour=23).f3 == 1.0


def test_feature_rounding_is_single_precision(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 12000, 300).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in x], "amount float")
    got = [r[0] for r in df.select(features.clamp01(features.ratio(F.col("amount"), 10000))).collect()]
    y = np.clip(x / np.float32(10000), 0, 1).astype(np.float32) * np.float32(10000)
    want = (np.floor(y + np.float32(0.5))).astype(np.float32) * np.float32(0.0001)
    assert np.allclose(got, want, atol=1.01e-4) and np.mean(np.array(got, dtype=np.float32) == want) > 0.99


@pytest.mark.parametrize(("text", "ok"), [("2024-02-31T10:00:00Z", True), ("2024/01/01x00:00", True), ("2024-01-01T00:0", False), ("20a4-01-01T00:00", False), ("2024-01-01T24:00", False), ("", False), (None, False)])
def test_iso(spark, text, ok):
    row = spark.createDataFrame([(text,)], "t string").select(parse.iso_parts(F.col("t")).isNotNull()).first()
    assert row[0] is ok


def test_nearest_equals_brute_force(spark):
    refs, asked = vectors(spark, 300), vectors(spark, 20, seed=2, first=1000)
    queries = asked.withColumnRenamed("vec_id", "qid").drop("label")
    got = {}
    for r in search.nearest(refs.repartition(5), queries).orderBy("rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, r.distance))
    want = brute([tuple(r) for r in refs.collect()], [tuple(r) for r in queries.collect()], 5)
    assert got == want


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    refs, queries = vectors(spark, 40), vectors(spark, 10, seed=3).withColumnRenamed("vec_id", "qid").drop("label")
    assert search.nearest(refs, queries).count() == 50


@pytest.mark.parametrize("held", [700, 1 << 22])
def test_many_queries_by_regions(spark, monkeypatch, held):
    """References dealt out by regions, several blocks of queries, ties and copies: the same as brute force."""
    for name, value in (("MANY", 10), ("BLOCK", 4), ("SCAN", 20), ("HELD", held)):
        monkeypatch.setattr(search, name, value)
    refs, asked = vectors(spark, 300), vectors(spark, 100, seed=2)
    queries = asked.withColumnRenamed("vec_id", "qid").drop("label")
    got = {}
    for r in search.nearest(refs.repartition(5), queries).orderBy("rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, r.distance))
    assert got == brute([tuple(r) for r in refs.collect()], [tuple(r) for r in queries.collect()], 5)


def test_few_references_keep_all_cores_busy(spark, monkeypatch):
    """Many queries of few references: these are dealt out by more than one region, as one task reads a region."""
    trees, deal = [], search.by_regions
    monkeypatch.setattr(search, "by_regions", lambda rows, tree, dims: trees.append(tree) or deal(rows, tree, dims))
    for name, value in (("MANY", 10), ("BLOCK", 4)):
        monkeypatch.setattr(search, name, value)
    refs, asked = vectors(spark, 300), vectors(spark, 100, seed=2)
    queries = asked.withColumnRenamed("vec_id", "qid").drop("label")
    assert search.nearest(refs, queries).count() == 500
    assert [len(column) for column, _ in trees] == [2 * spark.sparkContext.defaultParallelism]


def test_pruned_search_equals_all_distances():
    """Leaves that are left out hold none of the best, whatever comes first; equal vectors are cut to the k smallest ids."""
    rng = np.random.default_rng(4)
    x, q = rng.integers(0, 40, (6000, 3)) * 250, rng.integers(0, 40, (200, 3)) * 250
    x[:900] = x[0]
    ident, label = rng.permutation(6000), rng.integers(0, 2, 6000)
    best = search.TopK(q, 6)
    for s in range(0, 6000, 2500):
        best.add(x[s : s + 2500], ident[s : s + 2500], label[s : s + 2500])
    d = ((q[:, None] - x) ** 2).sum(axis=2)
    order = np.array([np.lexsort((ident, one))[:6] for one in d])
    assert (best.ident == ident[order]).all() and (best.distance == np.take_along_axis(d, order, 1)).all() and (best.label == label[order]).all()


def test_inverted_file_hands_on_only_the_best(spark):
    """Pairs of queries and lists aren't shuffled: what leaves a task is its k best of each query."""
    lists = index.postings(index.assign(vectors(spark, 400, spread=9), index.strided_seeds(vectors(spark, 400, spread=9), 4)))
    queries = vectors(spark, 15, seed=8, spread=9).withColumnRenamed("vec_id", "qid").drop("label")
    plan = search.ivf_nearest(lists, index.strided_seeds(vectors(spark, 400, spread=9), 4), queries, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(qid") == 1


def test_few_references(spark):
    refs = vectors(spark, 3).withColumn("label", F.lit(1))
    queries = vectors(spark, 1, seed=5).withColumnRenamed("vec_id", "qid").drop("label")
    row = search.exact_score(refs, queries).first()
    assert (row.fraud_count, row.fraud_score, row.approved) == (3, 0.6, False)
    empty = search.exact_score(refs.where("false"), queries).first()
    assert (empty.fraud_count, empty.approved) == (0, True)
    assert search.exact_score(refs, queries.where("false")).count() == 0


def test_all_clusters_probed_is_exact_and_recall_grows(spark):
    refs = vectors(spark, 400, spread=9)
    seeds = index.strided_seeds(refs, 12)
    centroids = index.stored(index.update(index.assign(refs, seeds), seeds), "centroids")
    lists = index.postings(index.assign(refs, centroids)).cache()
    queries = vectors(spark, 15, seed=8, spread=9).withColumnRenamed("vec_id", "qid").drop("label")
    exact = {(r.qid, r.vec_id) for r in search.nearest(refs, queries).collect()}
    recall = []
    for nprobe in (1, 4, 12, 50):
        got = {(r.qid, r.vec_id) for r in search.ivf_nearest(lists, centroids, queries, nprobe).collect()}
        recall.append(len(got & exact))
    assert recall == sorted(recall) and recall[2] == recall[3] == len(exact)
    same = evaluate.accuracy(lists, centroids, 12, 50).first()
    assert same.mismatch == 0 and evaluate.gate(evaluate.accuracy(lists, centroids, 12, 50))


def test_training_keeps_every_vector(spark):
    refs = vectors(spark, 200, spread=9)
    centroids, lists = index.train(refs, 8, most=5)
    assert lists.count() == 200 and centroids.count() == 8
    assert index.offsets(lists, centroids).agg(F.sum("size")).first()[0] == 200


def test_seeds_of_copies(spark):
    refs = spark.createDataFrame([(i, 0, *[5] * DIMS) for i in range(6)], f"vec_id long, label int, {COLS}")
    assert index.plus_plus_seeds(refs, 4).count() == 4


def test_ranking(spark):
    df = spark.createDataFrame([(i * i, i) for i in range(1, 101)], "id long, w long")
    got = ranking.ranked(df, "id").orderBy("id").collect()
    assert [r["rank"] for r in got] == list(range(100))
    assert [r.id for r in ranking.systematic(df, "id", 10).orderBy("id").collect()] == [(10 * i + 1) ** 2 for i in range(10)]
    assert ranking.weighted_pick(df, "id", "w", 0.5).first().w == 71
    assert ranking.systematic(df.where("false"), "id", 10).count() == 0


def test_binary_layout(spark):
    refs = vectors(spark, 60, spread=9)
    seeds = index.strided_seeds(refs, 4)
    lists = index.postings(index.assign(refs, seeds)).cache()
    c, cluster, place, label, v = ivf1.decode(ivf1.encode(seeds, lists))
    assert len(v) == 60 and len(c) == 4
    want = sorted((r.cluster_id, r.pos, r.label, *[r[q] for q in QUANTIZED]) for r in lists.collect())
    assert sorted((int(a), int(b), int(x), *map(int, y)) for a, b, x, y in zip(cluster, place, label, v, strict=True)) == want


def test_binary_file_in_pieces(spark, tmp_path, monkeypatch):
    """Written from pieces: the bytes of the whole layout; read by ranges: what the whole file holds."""
    refs = vectors(spark, 60, spread=9)
    seeds = index.strided_seeds(refs, 4)
    lists = index.postings(index.assign(refs, seeds)).cache()
    monkeypatch.setattr(ivf1, "PIECE", 8)
    ivf1.write_ivf1(seeds, lists, str(tmp_path / "i"))
    data = (tmp_path / "i" / "index.bin").read_bytes()
    assert data == ivf1.encode(seeds, lists)
    for got, want in zip(ivf1.read_ivf1(spark, str(tmp_path / "i")), ivf1._read_whole(spark, str(tmp_path / "i")), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_seeds_over_all_equal_a_plain_version(spark):
    from tessera.operators import index

    rng = random.Random(4)
    rows = [(i, *(rng.randrange(50) for _ in range(3))) for i in range(300)]
    got = [tuple(r)[1:] for r in index.plus_plus_over_all(spark.createDataFrame(rows, "vec_id long, q0 int, q1 int, q2 int"), 5, 3).orderBy("cluster_id").collect()]
    state = index.lcg(index.LCG_START)
    want = [rows[(state >> 33) % 300][1:]]
    mass = [math.inf] * 300
    while len(want) < 5:
        mass = [min(m, sum((a - b) ** 2 for a, b in zip(r[1:], want[-1], strict=True))) for m, r in zip(mass, rows, strict=True)]
        state = index.lcg(state)
        goal, run = (state >> 11) / (1 << 53) * sum(mass), 0
        for m, r in zip(mass, rows, strict=True):
            run += m
            if run >= goal:
                want.append(r[1:])
                break
    assert got == want


def test_generator():
    from tessera.operators import index

    assert index.lcg(0) == 1442695040888963407 and index.lcg((1 << 64) - 1) == 1442695040888963407 - 6364136223846793005 + (1 << 64)


def test_requests_are_bytes_and_may_follow_each_other(spark):
    from tessera.functions import http

    body = '{"a":"é"}'.encode()
    raw = b"POST /fraud-score HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    rows = spark.createDataFrame([(1, raw * 3), (2, None), (3, b"")], "id int, raw binary")
    got = [(r.id, r.place, r.body, r.complete) for r in http.parse_raw(rows).orderBy("id", "place").collect()]
    assert got == [(1, 0, body.decode(), True), (1, 1, body.decode(), True), (1, 2, body.decode(), True), (2, 0, "", False), (3, 0, "", False)]


def test_pipelined_requests_are_all_answered(spark):
    from tessera.plans import sql
    from tessera.streaming import scorer

    good = "{" + sql.GOOD + "}"
    one = f"POST /fraud-score HTTP/1.1\r\nContent-Length: {len(good)}\r\n\r\n{good}"
    rows = spark.createDataFrame([(1, one + one + "GET /ready HTTP/1.1\r\n\r\n"), (2, one)], "event_id long, raw string")
    near = lambda q: q.selectExpr("qid", "0L as vec_id", "0L as distance", "1 as label", "1 as rank")
    got = {(r.event_id, r.place): (r.status, r.response[:15]) for r in scorer.respond(rows, near).collect()}
    assert got == {k: (200, "HTTP/1.1 200 OK") for k in ((1, 0), (1, 1), (1, 2), (2, 0))}


def test_settings(spark, monkeypatch):
    from tessera.settings import Settings, reference_path, settings

    assert settings(spark) == Settings()
    monkeypatch.setenv("NPROBE", "7")
    monkeypatch.setenv("ACCURACY_SAMPLE", "many")
    assert settings(spark).nprobe == 7 and settings(spark).accuracy_sample == 200
    monkeypatch.setenv("REF_PATH", "/no/such/file.gz")
    assert reference_path(spark).endswith("../..//no/such/file.gz")

"""Registered queries of the scoring engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distance, features, http, parse
from tessera.operators import evaluate, index, ranking, search, stats
from tessera.plans import sql
from tessera.schema import DIMS, FEATURES, PAYLOAD, QUANTIZED
from tessera.sources import fixtures, ivf1, references
from tessera.streaming import scorer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CLUSTERS, PROBES = 32, 4


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


@query
def json_parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON and parsed again."""
    return parse.parse_requests(fixtures.requests(spark, sf_dir)).select("event_id", "status", *PAYLOAD)


@query
def json_reject_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_requests(rows(spark, "id int, body string", sql.MALFORMED)).select("id", "status")


@query
def iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), fixtures.stamp(F.col("ts")).alias("text"))
    both = events.union(rows(spark, "id string, text string", sql.STAMPS)).withColumn("at", parse.iso_parts(F.col("text")))
    return both.select("id", *[F.coalesce(x, F.lit(-1)).alias(c) for c, x in [(c, F.col(f"at.{c}")) for c in ("year", "month", "day", "hour", "minute")] + [("weekday", parse.day_of_week(F.col("at")))]])


@query
def minutes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.transactions(spark, sf_dir).where("last_ts IS NOT NULL").select(F.col("event_id").cast("string").alias("id"), fixtures.stamp(F.col("last_ts")).alias("a"), fixtures.stamp(F.col("ts")).alias("b"))
    both = t.union(rows(spark, "id string, a string, b string", sql.INTERVALS))
    return both.select("id", parse.minutes_between(parse.iso_parts(F.col("a")), parse.iso_parts(F.col("b"))).alias("minutes"))


@query
def day_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = parse.iso_parts(fixtures.stamp(F.col("ts")))
    return fixtures.read(spark, sf_dir, "events").select("event_id", parse.day_of_week(at).alias("weekday"), at.hour.alias("hour"))


@query
def mcc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.transactions(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.col("mcc_text").alias("text"))
    both = events.union(rows(spark, "id string, text string", sql.MCCS))
    return both.select("id", parse.mcc_code(F.col("text")).alias("mcc"), features.mcc_risk(parse.mcc_code(F.col("text"))).alias("risk"))


@query
def wrapping_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "x int", [(x,) for x in sql.WRAPS]).select("x", parse.wrapped(F.col("x"), 8).alias("as_u8"), parse.wrapped(F.col("x"), 32).alias("as_u32"))


@query
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vectorize(fixtures.payloads(spark, sf_dir), "event_id")


@query
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.quantize(features.vectorize(fixtures.payloads(spark, sf_dir), "event_id"), "event_id")


@query
def quantize_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(features.quantize_array(F.col("embedding"))).alias("dim", "q"))


@query
def label_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(spark, sf_dir).select("event_id", features.indicator(F.col("label")).alias("fraud"))


@query
def l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    return search.pair_distances(e, fixtures.queries(e), fixtures.EMBEDDED)


@query
def centroid_probe_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    return search.probes(fixtures.queries(e), index.strided_seeds(e, CLUSTERS, fixtures.EMBEDDED), 10, fixtures.EMBEDDED)


@query
def exact_knn5_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every 50th transaction scored by its five nearest among all others."""
    v = index.stored(fixtures.vectors(spark, sf_dir), "vectors")  # the queries' side and each scan read them
    asked = fixtures.queries(v)
    return search.score(asked, search.nearest(v, asked, exclude_self=True))


@query
def exact_knn5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    return search.nearest(e, fixtures.queries(e), dims=fixtures.EMBEDDED)


def _one_pass(vectors: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(centroids, postings) after one deterministic round. Each of its passes reads the vectors once more, so they are written first."""
    vectors = index.stored(vectors, "vectors")
    seeds = index.strided_seeds(vectors, CLUSTERS, dims)
    centroids = index.stored(index.update(index.assign(vectors, seeds, dims), seeds, dims), "centroids")
    return centroids, index.postings(index.assign(vectors, centroids, dims))


#: By application and tables: where an index was written.
_INDEXES: dict[tuple[str, str], str] = {}


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(centroids, postings) of the transactions, read from an index that is built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = index.shared_path(spark, "index")
        index.write(*_one_pass(fixtures.vectors(spark, sf_dir), DIMS), path)
        _INDEXES[key] = path
    return index.read(spark, _INDEXES[key])


@query
def ivf_knn5_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship through the stored index: only the folders of probed clusters are read. The queries are vectors of the lists themselves."""
    centroids, lists = _indexed(spark, sf_dir)
    return search.ivf_score(lists, centroids, fixtures.queries(lists.drop("cluster_id", "pos")), PROBES)


@query
def float_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding and the one before it, in single precision."""
    e = fixtures.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("x"))
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(before, "vec_id").select("vec_id", distance.squared_float(F.col("x"), F.col("y")).alias("distance"))


@query
def unscaled_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer distances of embeddings to the query set, on the scale of the features."""
    return l2_pairs(spark, sf_dir).select("qid", "vec_id", distance.unscaled(F.col("distance")).alias("distance"))


@query
def kmeans_pp_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four seeds drawn over all embeddings; the tests hold them to a plain version."""
    e = fixtures.embeddings(spark, sf_dir)
    return index.plus_plus_over_all(e, 4, fixtures.EMBEDDED)


@query
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    return index.assign(e, index.strided_seeds(e, CLUSTERS, fixtures.EMBEDDED), fixtures.EMBEDDED).select("vec_id", "cluster_id")


@query
def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    seeds = index.strided_seeds(e, CLUSTERS, fixtures.EMBEDDED)
    moved = index.update(index.assign(e, seeds, fixtures.EMBEDDED), seeds, fixtures.EMBEDDED)
    return moved.select("cluster_id", F.posexplode(features_array(fixtures.EMBEDDED)).alias("dim", "q"))


def features_array(dims: int) -> Column:
    return features.as_array("q", dims)


@query
def kmeans_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    dims = fixtures.EMBEDDED
    seeds = index.strided_seeds(e, CLUSTERS, dims)
    first = index.assign(e, seeds, dims)
    return index.changed(first, index.assign(e, index.stored(index.update(first, seeds, dims), "centroids"), dims))


@query
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.systematic(fixtures.read(spark, sf_dir, "events").select("event_id"), "event_id", 200)


@query
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = fixtures.read(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("weight"))
    picks = [ranking.weighted_pick(weighed, "event_id", "weight", f).select(F.lit(f).alias("fraction"), "event_id", F.col("cumulative").cast("long")) for f in (0.125, 0.5, 0.875)]
    return picks[0].union(picks[1]).union(picks[2])


@query
def posting_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids, lists = _one_pass(fixtures.embeddings(spark, sf_dir), fixtures.EMBEDDED)
    return index.offsets(lists, centroids)


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids, lists = _one_pass(fixtures.embeddings(spark, sf_dir), fixtures.EMBEDDED)
    return stats.index_stats(centroids, lists, fixtures.EMBEDDED)


@query
def phantom_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One far fraud in one list, with and without its list's padding."""
    zeros = ", ".join(f"{c} int" for c in QUANTIZED)
    lists = rows(spark, f"cluster_id int, vec_id long, label int, {zeros}", [(0, 1, 1, *[9000] * DIMS)])
    centroids = rows(spark, f"cluster_id int, {zeros}", [(0, *[9000] * DIMS)])
    asked = rows(spark, f"qid long, {zeros}", [(7, *[100] * DIMS)])
    padding = index.offsets(lists, centroids).select("cluster_id", (F.col("padded") - F.col("size")).alias("n"))
    out = [search.score(asked, search.ivf_nearest(lists, centroids, asked, phantoms=p)).select(F.lit(name).alias("padding"), "qid", "fraud_count", "approved") for name, p in (("on", padding), ("off", None))]
    return out[0].union(out[1])


@query
def ann_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids, lists = _indexed(spark, sf_dir)
    return evaluate.accuracy(lists, centroids, PROBES, 200)


@query
def kmeans_pp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding and training as a whole; random, so only its shape can be compared."""
    e = fixtures.embeddings(spark, sf_dir)
    centroids, lists = index.train(e, CLUSTERS, fixtures.EMBEDDED, most=15, sample=index.SAMPLE)
    return stats.index_stats(centroids, lists, fixtures.EMBEDDED)


@query
def index_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.embeddings(spark, sf_dir)
    centroids, lists = _one_pass(e, fixtures.EMBEDDED)
    path = index.shared_path(spark, "index")
    index.write(centroids, lists, path)
    return index.read(spark, path)[1].select("vec_id", F.posexplode(features_array(fixtures.EMBEDDED)).alias("dim", "q"))


@query
def index_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the one-file layout, by label counts and sums per cluster."""
    centroids, lists = _one_pass(fixtures.vectors(spark, sf_dir), DIMS)
    path = index.shared_path(spark, "ivf1")
    ivf1.write_ivf1(centroids, lists, path)
    _, back = ivf1.read_ivf1(spark, path)
    return back.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("label").alias("frauds"), F.sum("q0").alias("sum_q0"), F.sum("q13").alias("sum_q13"))


@query
def references_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors written as JSON and read as such."""
    v = features.vectorize(fixtures.payloads(spark, sf_dir), "event_id", "label")
    path = index.shared_path(spark, "references")
    one = F.to_json(F.struct(F.array(*FEATURES).alias("vector"), "label"))
    parts = max(1, -(-v.count() // 10_000))  # rows of one array
    arrays = v.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(parts)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").option("compression", "gzip").text(path)
    back = references.read_references(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in QUANTIZED])


@query
def http_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = http.parse_raw(rows(spark, "id int, raw string", sql.RAW_REQUESTS))
    code = http.status(F.col("path"), F.lit(True), F.lit(False))
    return framed.select("id", "place", "path", "content_length", "close", "complete", F.length("body").alias("body_chars"), code.alias("status"), http.status(F.col("path"), F.lit(False), F.lit(False)).alias("status_unready"))


@query
def http_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th transaction as an HTTP request, and the response's text."""
    v = index.stored(fixtures.vectors(spark, sf_dir), "vectors")  # scanned more than once
    body = F.col("body")
    raw = F.concat(F.lit("POST /fraud-score HTTP/1.1\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\nConnection: "), F.when(F.col("event_id") % 100 == 0, "close").otherwise("keep-alive"), F.lit("\r\n\r\n"), body)
    asked = fixtures.requests(spark, sf_dir).where("event_id % 50 = 0").select("event_id", raw.alias("raw"))
    asked = index.stored(asked, "requests")  # framed, parsed and joined again
    return scorer.respond(asked, lambda q: search.nearest(v, q, exclude_self=True)).drop("place")


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a stream, for every transaction: requests read from files, scored by micro-batch, drained and read back."""
    v = index.stored(fixtures.vectors(spark, sf_dir), "vectors")  # scanned by each micro-batch
    source, out, checkpoint = (index.shared_path(spark, n) for n in ("requests", "scores", "progress"))
    fixtures.requests(spark, sf_dir).select("event_id", "body").write.parquet(source)
    stream = spark.readStream.schema("event_id long, body string").parquet(source)
    scorer.start(stream, lambda q: search.nearest(v, q, exclude_self=True), out, checkpoint).awaitTermination()
    return spark.read.schema("event_id long, status int, fraud_count long, fraud_score double, approved boolean").parquet(out).select(F.col("event_id").alias("qid"), "fraud_count", "fraud_score", "approved")


ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL

"""Scoring a stream of requests: each micro-batch by the batch plan, against an index that doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import features, http, parse
from tessera.operators import search
from tessera.session import stored


def score_requests(requests: DataFrame, neighbours: Callable[[DataFrame], DataFrame], key: str = "event_id") -> DataFrame:
    """(key, status, fraud_count, fraud_score, approved) of rows with a JSON body; neighbours gives a table of queries its nearest labelled vectors."""
    parsed = stored(parse.parse_requests(requests.select(F.col(key).cast("long").alias("qid"), "body")), "parsed")  # searched and joined again
    queries = features.quantize(features.vectorize(parsed.where("status = 200"), "qid"), "qid")
    scored = search.score(queries, neighbours(queries))
    return parsed.select("qid", "status").join(scored, "qid", "left").withColumnRenamed("qid", key)


def respond(requests: DataFrame, neighbours: Callable[[DataFrame], DataFrame], ready: bool = True, key: str = "event_id") -> DataFrame:
    """(key, place, status, response) of rows with raw HTTP requests, several of which one connection (key) may send."""
    framed = http.parse_raw(requests)
    scored = score_requests(framed.where("place = 0"), neighbours, key).select(key, F.lit(0).alias("place"), F.col("status").alias("parsed"), "fraud_count")
    if not framed.where("place > 0").isEmpty():  # the key doesn't tell them apart: numbers below those of any key do
        more = stored(framed.where("place > 0").select(key, "place", "body").withColumn("_n", -1 - F.monotonically_increasing_id()), "pipelined")
        found = score_requests(more.select(F.col("_n").alias("event_id"), "body"), neighbours).select(F.col("event_id").alias("_n"), F.col("status").alias("parsed"), "fraud_count")
        scored = scored.union(more.join(found, "_n").select(key, "place", "parsed", "fraud_count"))
    rows = framed.join(scored, [key, "place"], "left")
    code = http.status(F.col("path"), F.lit(ready), F.col("parsed") == 200)
    return rows.select(key, "place", code.alias("status"), http.response(code, F.col("path"), F.coalesce("fraud_count", F.lit(0)), F.col("close")).alias("response"))


def start(requests: DataFrame, neighbours: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Writes each micro-batch's scores to a folder of its own number, so that a repeated batch overwrites itself. Drains what there is and ends."""

    def one(batch: DataFrame, number: int) -> None:
        score_requests(batch, neighbours, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Transactions derived from the events table, as flat payloads and as request JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions import features, parse
from tessera.schema import MCC_RISK, PAYLOAD

EMBEDDED = 64
CODES = [*map(str, MCC_RISK), "0000", "abc"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _average(over: WindowSpec) -> Column:
    return (F.sum("cents").over(over).cast("double") / F.count("*").over(over).cast("double") / 100 * 40).cast("float")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label and what a request holds, per event."""
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("event_id", "user_id", "ts", "event_type", k.alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    user, merchant = Window.partitionBy("user_id"), Window.partitionBy("k")
    ordered = user.orderBy("ts", "event_id")
    recent = user.orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-86400, 0)
    seen = F.row_number().over(Window.partitionBy("user_id", "k").orderBy("ts", "event_id")) > 1
    return base.select(
        "event_id", "user_id", "ts", "k",
        (F.col("cents").cast("double") / 100 * 40).cast("float").alias("amount"),
        (F.col("event_id") % 14).cast("int").alias("installments"),
        F.when(F.col("user_id") % 10 == 0, F.lit(0).cast("float")).otherwise(_average(user)).alias("customer_avg_amount"),
        (3 * (F.count("*").over(recent) - 1)).cast("int").alias("tx_count_24h"),
        seen.alias("known"),
        F.element_at(F.array(*map(F.lit, CODES)), (F.col("k") % 12 + 1).cast("int")).alias("mcc_text"),
        _average(merchant).alias("merchant_avg_amount"),
        F.col("event_type").isin("view", "click").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("event_id") * 7919 % 1500).cast("float").alias("km_from_home"),
        (F.col("event_id") * 104729 % 1500).cast("float").alias("km_from_current"),
        F.lag("ts").over(ordered).alias("last_ts"),
        F.when(F.col("event_type") == "error", "fraud").otherwise("legit").alias("label"),
    )


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label and the flat payload, computed without JSON."""
    t = transactions(spark, sf_dir).withColumn("_at", parse.iso_parts(stamp(F.col("ts")))).withColumn("_last", parse.iso_parts(stamp(F.col("last_ts"))))
    has_last = F.col("last_ts").isNotNull()
    own = {
        "tx_count_24h": parse.wrapped(F.col("tx_count_24h"), 32),
        "mcc": parse.mcc_code(F.col("mcc_text")),
        "minutes_since_last": F.when(has_last, parse.minutes_between(F.col("_last"), F.col("_at"))).otherwise(F.lit(0).cast("long")),
        "installments": parse.wrapped(F.col("installments"), 8).cast("int"),
        "hour": F.col("_at.hour"),
        "day_of_week": parse.day_of_week(F.col("_at")),
        "km_from_current": F.when(has_last, F.col("km_from_current")).otherwise(F.lit(0).cast("float")),
        "is_unknown_merchant": ~F.col("known"),
        "has_last_tx": has_last,
    }
    return t.select("event_id", "label", *[own.get(c, F.col(c)).alias(c) for c in PAYLOAD])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label and the request as JSON."""
    merchant = F.concat(F.lit("M-"), F.col("k").cast("string"))
    known = F.when(F.col("known"), F.array(merchant, F.lit("M-none"))).otherwise(F.array(F.lit("M-none")))
    body = F.to_json(
        F.struct(
            F.struct("amount", "installments", stamp(F.col("ts")).alias("requested_at")).alias("transaction"),
            F.struct(F.col("customer_avg_amount").alias("avg_amount"), "tx_count_24h", known.alias("known_merchants")).alias("customer"),
            F.struct(merchant.alias("id"), F.col("mcc_text").alias("mcc"), F.col("merchant_avg_amount").alias("avg_amount")).alias("merchant"),
            F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
            F.when(F.col("last_ts").isNotNull(), F.struct(stamp(F.col("last_ts")).alias("timestamp"), "km_from_current")).alias("last_transaction"),
        )
    )
    return transactions(spark, sf_dir).select("event_id", "label", body.alias("body"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (0, 1) and q0... of every event."""
    return features.quantize(features.vectorize(payloads(spark, sf_dir), "event_id", "label"), F.col("event_id").cast("long").alias("vec_id"), features.indicator(F.col("label")).alias("label"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and q0... of every embedding."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", features.quantize_array(F.col("embedding")).alias("q"))
    return rows.select("vec_id", F.col("label").cast("int"), *[F.col("q")[i].alias(f"q{i}") for i in range(EMBEDDED)])


def queries(vectors_: DataFrame) -> DataFrame:
    """The stated query set of the searches: rows whose id is divisible by 50."""
    return vectors_.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid").drop("label")

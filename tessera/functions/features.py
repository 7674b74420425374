"""Payload to 14 features and their integers, in single precision as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import DIMS, FEATURES, MCC_RISK, OTHER_RISK, QUANTIZED, SCALE


def f32(x: float | str | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("float")


def ratio(x: Column, y: Column | float) -> Column:
    """Single-precision division: the quotient of two floats as a double rounds to the same float."""
    return (f32(x) / (f32(y) if not isinstance(y, Column) else f32(y))).cast("float")


def round4(x: Column) -> Column:
    return (F.round((f32(x) * f32(SCALE)).cast("float")).cast("float") * f32("0.0001")).cast("float")


def clamp01(x: Column) -> Column:
    return round4(F.greatest(F.least(x, f32(1)), f32(0)))


def mcc_risk(code: Column) -> Column:
    pairs = [F.lit(v) for k, r in MCC_RISK.items() for v in (k, r)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.try_cast("int")), F.lit(OTHER_RISK)).cast("float")


def expressions() -> list[Column]:
    """The features of a flat payload, in order; pure expressions, so one projection whatever reads them."""
    c = F.col
    avg = c("customer_avg_amount")
    return [
        clamp01(ratio(c("amount"), 10000)),
        clamp01(ratio(c("installments"), 12)),
        clamp01(F.when(avg > f32(0), ratio(ratio(c("amount"), avg), 10)).otherwise(f32(1))),
        round4(ratio(c("hour"), 23)),
        round4(ratio(c("day_of_week"), 6)),
        F.when(c("has_last_tx"), clamp01(ratio(c("minutes_since_last"), 1440))).otherwise(f32(-1)),
        F.when(c("has_last_tx"), clamp01(ratio(c("km_from_current"), 1000))).otherwise(f32(-1)),
        clamp01(ratio(c("km_from_home"), 1000)),
        clamp01(ratio(c("tx_count_24h"), 20)),
        c("is_online").cast("float"),
        c("card_present").cast("float"),
        c("is_unknown_merchant").cast("float"),
        mcc_risk(c("mcc")),
        clamp01(ratio(c("merchant_avg_amount"), 10000)),
    ]


def vectorize(payloads: DataFrame, *keep: str) -> DataFrame:
    return payloads.select(*keep, *[e.alias(n) for e, n in zip(expressions(), FEATURES, strict=True)])


def quantized(x: Column) -> Column:
    return F.round((f32(x) * f32(SCALE)).cast("float")).cast("int")


def quantize(features: DataFrame, *keep: str) -> DataFrame:
    return features.select(*keep, *[quantized(F.col(f)).alias(q) for f, q in zip(FEATURES, QUANTIZED, strict=True)])


def quantize_array(vector: Column) -> Column:
    return F.transform(vector, quantized)


def as_array(prefix: str = "q", dims: int = DIMS) -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(dims)])


def indicator(label: Column) -> Column:
    return F.coalesce((label == "fraud").cast("int"), F.lit(0))

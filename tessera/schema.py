"""Schemas and fixed values of the scoring model."""

from pyspark.sql import types as T

DIMS = 14
NEIGHBOURS = 5
NPROBE = 10
FRAUD_FROM = 3
SCALE = 10_000
BLOCK = 8

# Merchant category codes and their risk; any other code has the last risk.
MCC_RISK = {
    5411: 0.15,
    5812: 0.30,
    5912: 0.20,
    5944: 0.45,
    7801: 0.80,
    7802: 0.75,
    7995: 0.85,
    4511: 0.35,
    5311: 0.25,
    5999: 0.50,
}
OTHER_RISK = 0.50


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


REQUEST = _struct(
    ("transaction", _struct(("amount", T.FloatType()), ("installments", T.IntegerType()), ("requested_at", T.StringType()))),
    ("customer", _struct(("avg_amount", T.FloatType()), ("tx_count_24h", T.IntegerType()), ("known_merchants", T.ArrayType(T.StringType())))),
    ("merchant", _struct(("id", T.StringType()), ("mcc", T.StringType()), ("avg_amount", T.FloatType()))),
    ("terminal", _struct(("is_online", T.BooleanType()), ("card_present", T.BooleanType()), ("km_from_home", T.FloatType()))),
    ("last_transaction", _struct(("timestamp", T.StringType()), ("km_from_current", T.FloatType()))),
    ("_corrupt_record", T.StringType()),
)

LABELLED = _struct(("vector", T.ArrayType(T.FloatType())), ("label", T.StringType()))

#: The flat payload, in order.
PAYLOAD = ["amount", "customer_avg_amount", "merchant_avg_amount", "km_from_home", "km_from_current", "tx_count_24h", "mcc", "minutes_since_last", "installments", "hour", "day_of_week", "is_online", "card_present", "is_unknown_merchant", "has_last_tx"]
FEATURES = [f"f{i}" for i in range(DIMS)]
QUANTIZED = [f"q{i}" for i in range(DIMS)]

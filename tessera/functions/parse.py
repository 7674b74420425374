"""Requests to payloads: JSON, calendar and integer parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import PAYLOAD, REQUEST

ISO = r"(?s)^[0-9]{4}.[0-9]{2}.[0-9]{2}.[0-9]{2}.[0-9]{2}"
# Weekday offsets of the months.
MONTHS = (0, 3, 2, 5, 0, 3, 5, 1, 4, 6, 2, 4)
REQUIRED = [
    "transaction.amount", "transaction.installments", "transaction.requested_at",
    "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants",
    "merchant.id", "merchant.mcc", "merchant.avg_amount",
    "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
]


def iso_parts(text: Column) -> Column:
    """struct(year, month, day, hour, minute) of the first 16 characters, or null; what stands between the digits, seconds and zone don't matter, nor whether the month has the day."""

    def part(name: str, start: int, length: int) -> Column:
        return F.substring(text, start, length).cast("int").alias(name)

    # Digits are certain where the pattern holds; other rows must not reach the casts.
    parts = F.when(text.rlike(ISO), F.struct(part("year", 1, 4), part("month", 6, 2), part("day", 9, 2), part("hour", 12, 2), part("minute", 15, 2)))
    fits = parts.month.between(1, 12) & parts.day.between(1, 31) & (parts.hour <= 23) & (parts.minute <= 59)
    return F.when(fits, parts)


def minutes(at: Column) -> Column:
    """Minutes in a calendar of 365-day years and 30-day months."""
    return at.year.cast("long") * 525600 + at.month * 43200 + at.day * 1440 + at.hour * 60 + at.minute


def minutes_between(before: Column, after: Column) -> Column:
    return F.greatest(minutes(after) - minutes(before), F.lit(0).cast("long"))


def day_of_week(at: Column) -> Column:
    """0 on Sundays, by month offsets, so that days a month doesn't have count on."""
    offset = F.element_at(F.array(*map(F.lit, MONTHS)), at.month)
    year = at.year - (at.month < 3).cast("int")
    whole = year + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + offset + at.day
    return F.pmod(whole, F.lit(7)).cast("int")


def wrapped(x: Column, bits: int) -> Column:
    """An integer modulo 2**bits, as a cast to fewer unsigned bits gives it."""
    return F.pmod(x.cast("long"), F.lit(1 << bits).cast("long"))


def mcc_code(text: Column) -> Column:
    """A decimal code below 2**32, perhaps after a plus, else 0."""
    code = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    return F.when(code < (1 << 32), code).otherwise(0).cast("long")


def one_object(body: Column) -> Column:
    """Whether a text is one JSON object or array and nothing else: strings are taken out, then what is between the innermost brackets, level by level."""
    bare = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', '""')
    levels = F.length(bare) - F.length(F.regexp_replace(bare, r"[{\[]", ""))
    left = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), bare, lambda s, _: F.regexp_replace(s, r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]", "0"))
    return (levels > 0) & (F.regexp_replace(left, r"^[ \t\r\n]+|[ \t\r\n]+$", "") == "0")


def keys_once(body: Column) -> Column:
    """Whether no field of a request, at either level, is there twice; other keys may be."""

    def at(part: Column, names: list[str]) -> Column:
        own = F.filter(F.json_object_keys(part), lambda k: k.isin(*names))
        return F.coalesce(F.size(own) == F.size(F.array_distinct(own)), F.lit(True))

    once = at(body, REQUEST.names[:-1])
    for f in REQUEST.fields[:-1]:
        once = once & at(F.get_json_object(body, f"$.{f.name}"), f.dataType.names)
    return once


def parse_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds status (200, 400) and the flat payload (null where 400) to rows with a JSON body."""
    parsed = requests.withColumn("_r", F.from_json(body, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    whole = F.col("_r").isNotNull() & F.col("_r._corrupt_record").isNull() & one_object(F.col(body)) & keys_once(F.col(body))
    for leaf in REQUIRED:
        whole = whole & F.col(f"_r.{leaf}").isNotNull()
    last = F.col("_r.last_transaction")
    parsed = parsed.withColumn("_at", iso_parts(F.col("_r.transaction.requested_at"))).withColumn("_last", iso_parts(F.col("_r.last_transaction.timestamp")))
    whole = whole & F.col("_at").isNotNull() & (last.isNull() | (F.col("_last").isNotNull() & F.col("_r.last_transaction.km_from_current").isNotNull()))
    has_last = last.isNotNull()
    payload = {
        "amount": F.col("_r.transaction.amount"),
        "customer_avg_amount": F.col("_r.customer.avg_amount"),
        "merchant_avg_amount": F.col("_r.merchant.avg_amount"),
        "km_from_home": F.col("_r.terminal.km_from_home"),
        "km_from_current": F.when(has_last, F.col("_r.last_transaction.km_from_current")).otherwise(F.lit(0).cast("float")),
        "tx_count_24h": wrapped(F.col("_r.customer.tx_count_24h"), 32),
        "mcc": mcc_code(F.col("_r.merchant.mcc")),
        "minutes_since_last": F.when(has_last, minutes_between(F.col("_last"), F.col("_at"))).otherwise(F.lit(0).cast("long")),
        "installments": wrapped(F.col("_r.transaction.installments"), 8).cast("int"),
        "hour": F.col("_at.hour"),
        "day_of_week": day_of_week(F.col("_at")),
        "is_online": F.col("_r.terminal.is_online"),
        "card_present": F.col("_r.terminal.card_present"),
        "is_unknown_merchant": ~F.array_contains("_r.customer.known_merchants", F.col("_r.merchant.id")),
        "has_last_tx": has_last,
    }
    parsed = parsed.withColumn("status", F.when(whole, 200).otherwise(400))
    ok = F.col("status") == 200
    return parsed.select(*requests.columns, "status", *[F.when(ok, payload[c]).alias(c) for c in PAYLOAD])

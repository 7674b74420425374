"""Squared Euclidean distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.features import f32


def squared(x: Column, y: Column) -> Column:
    """Of two integer arrays, exact."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, v: s + v)


def squared_flat(x: list[Column], y: list[Column]) -> Column:
    """Of two rows of integer columns, exact; stays in generated code."""
    total = F.lit(0).cast("long")
    for a, b in zip(x, y, strict=True):
        d = a.cast("long") - b
        total = total + d * d
    return total


def squared_float(x: Column, y: Column) -> Column:
    """Of two float arrays, summed in order in single precision."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: ((a - b) * (a - b)).cast("float")), f32(0), lambda s, v: (s + v).cast("float"))


def unscaled(raw: Column) -> Column:
    """An integer distance on the features' scale, in single precision."""
    return ((raw.cast("float") * f32("0.0001")).cast("float") * f32("0.0001")).cast("float")

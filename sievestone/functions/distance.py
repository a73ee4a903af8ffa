"""Distance and similarity expressions over array columns and packed bits; JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - inner_product(a, b) / F.nullif(size, F.lit(0.0))).otherwise(F.lit(1.0))


METRICS = {"l2": l2, "cosine": cosine_distance, "inner_product": lambda a, b: -inner_product(a, b)}


def sign_bits(a: Column) -> Column:
    """The positions of positive elements, ascending."""
    return F.filter(F.transform(a, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def pack_bits(positions: Column) -> Column:
    """Positions 0 to 63 as one signed 64-bit integer."""
    return F.aggregate(positions, F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))))


def common_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b)).cast("bigint")


def union_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseOR(b)).cast("bigint")

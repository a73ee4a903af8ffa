"""Joins that Spark has no operator for: as-of and interval joins, without comparing all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, order: str, value: str, parts: int = 64) -> DataFrame:
    """left with `value` of the last right row of its key whose order (a number) is not greater; null if there is none. Null
    values and orders don't count as right rows. A key's rows are cut in `parts` ranges of the order, so that no task gets a
    whole hot key: within a range a running last value answers, and each range's last value is carried to the next ones by a
    window over at most `parts` rows a key. No pairs are made."""
    columns = left.columns
    right = right.where(F.col(value).isNotNull() & F.col(order).isNotNull())
    both = left.withColumns({"_right": F.lit(0), "_value": F.lit(None).cast(dict(right.dtypes)[value])}).unionByName(right.select(key, order, F.lit(1).alias("_right"), F.col(value).alias("_value")), allowMissingColumns=True)
    low, high = right.agg(F.min(order), F.max(order)).first()
    width = max(1, (high - low) / parts) if low is not None else 1
    ranged = both.withColumn("_range", F.greatest(F.lit(0), F.least(F.lit(parts), F.floor((F.col(order) - F.lit(low if low is not None else 0)) / F.lit(width)))))
    lasts = ranged.where("_right = 1").groupBy(key, "_range").agg(F.max_by("_value", order).alias("_last"))
    # A range without right rows carries what came before it: the last range that has some and is smaller.
    spread = lasts.unionByName(ranged.where("_right = 0").select(key, "_range").distinct().withColumn("_last", F.lit(None).cast(dict(right.dtypes)[value]))).groupBy(key, "_range").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    so_far = Window.partitionBy(key, "_range").orderBy(F.col(order), F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_found", F.last("_value", ignorenulls=True).over(so_far)).where("_right = 0")
    met = found.join(carried, found[key].eqNullSafe(carried["_key"]) & (F.col("_range") == F.col("_at")), "left")
    answer = F.when(F.col(order).isNotNull() & F.col(key).isNotNull(), F.coalesce("_found", "_carried"))
    return met.select(*columns, answer.alias(f"asof_{value}"))


def within(left: DataFrame, right: DataFrame, a: Column, b: Column, width: int) -> DataFrame:
    """Rows of both with a <= b <= a + width (whole numbers): an equi-join on buckets of that width; each left row looks in
    two buckets, so a pair is found once."""
    left = left.withColumn("_bucket", F.explode(F.array(F.floor(a / width), F.floor(a / width) + 1)))
    right = right.withColumn("_bucket", F.floor(b / width))
    return left.join(right, "_bucket").where((b >= a) & (b <= a + width)).drop("_bucket")

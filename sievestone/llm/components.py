"""Connected components of an edge table by alternating large-star and small-star steps, for graphs of any size.

Each step sends nodes' neighbours to the smallest of them; a logarithmic number of steps leaves a star around the
smallest node of each component. Minima are aggregated before they are shuffled, and joins read written tables, so the
star around a hot node can be split among tasks. Tables are written after each step: nothing is collected, and a lost
executor costs only the step at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

STEPS = 40


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """u, v for every node u that isn't the smallest of its component, with v the smallest; from edges (u, v)."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = written(edges, folder, f"{name}-0"), None
    for step in range(1, STEPS + 1):
        both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), folder, f"{name}-{step}-both")
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder, f"{name}-{step}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, folder, f"{name}-{step}-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}-{step}-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = written(small, folder, f"{name}-{step}")
        now = _signature(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"the components of a graph didn't settle in {STEPS} steps")

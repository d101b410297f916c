"""Interval algebra over DataFrames: one row per interval ``(key..., lo, hi)``.

Each operator is one shuffle on the keys and window functions over it; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """``df`` with lo <= hi and ``island``: intervals at most ``gap`` apart share a number."""
    ordered = df.withColumns({"lo": F.least("lo", "hi"), "hi": F.greatest("lo", "hi")})
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("lo") > reach + gap), 1).otherwise(0)
    return ordered.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w)).drop("fresh")


def merge(df: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    found = islands(df.select(*keys, "lo", "hi"), keys, gap).groupBy(*keys, "island")
    return found.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def intersect(left: DataFrame, right: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The overlaps of positive length between intervals of the same key.  Intervals meet in stretches
    of ``size``, a pair only in the first one that both touch; about their usual length is best."""
    left, right = (d.select(*keys, "lo", "hi").where("hi > lo") for d in (left, right))
    at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))).alias("_s")
    other = right.select(*keys, F.col("lo").alias("lo2"), F.col("hi").alias("hi2")).select("*", at("lo2", "hi2"))
    both = left.select("*", at("lo", "hi")).join(other, [*keys, "_s"]).where("lo < hi2 and lo2 < hi")
    both = both.where(F.floor(F.greatest("lo", "lo2") / size) == F.col("_s"))
    return both.select(*keys, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))


def complement(df: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """What intervals leave free of each key's ``bounds(key..., from, to)``."""
    inside = merge(df, keys).join(bounds, keys).where("hi > from and lo < to")
    w = Window.partitionBy(*keys).orderBy("lo")
    before = inside.select(*keys, F.coalesce(F.lag("hi").over(w), F.col("from")).alias("lo"), F.col("lo").alias("hi"))
    last = inside.groupBy(*keys).agg(F.max("hi").alias("lo"), F.first("to").alias("hi"))
    empty = bounds.join(inside.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("from").alias("lo"), F.col("to").alias("hi"))
    return before.unionByName(last).unionByName(empty).where("hi > lo")


def coverage(df: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """(key..., covered): the share of each key's bounds that its intervals cover together."""
    clipped = df.join(bounds, keys).select(*keys, F.greatest(F.least("lo", "hi"), "from").alias("lo"), F.least(F.greatest("lo", "hi"), "to").alias("hi")).where("hi > lo")
    union = merge(clipped, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    return bounds.join(union, keys, "left").select(*keys, F.coalesce(F.try_divide(F.col("n"), F.col("to") - F.col("from")), F.lit(0.0)).alias("covered"))


def rhythm(df: DataFrame, keys: list[str], value: str, least: float = 0.0) -> DataFrame:
    """(key..., n, pitch, cv) of the gaps between ordered values that exceed ``least``."""
    w = Window.partitionBy(*keys).orderBy(value)
    steps = df.select(*keys, (F.col(value) - F.lag(value).over(w)).alias("gap")).where(F.col("gap") > least)
    return steps.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("gap").alias("pitch"), F.try_divide(F.stddev_pop("gap"), F.avg("gap")).alias("cv"))


def sessions(df: DataFrame, keys: list[str], value: str, apart: float) -> DataFrame:
    """``df`` with ``session``: values at most ``apart`` from the one before share a number."""
    w = Window.partitionBy(*keys).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(w) <= apart, 0).otherwise(1)
    return df.withColumn("session", fresh).withColumn("session", F.sum("session").over(w))

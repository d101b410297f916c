"""Band, grid and nearest joins as equi-joins on bucket keys with a residual predicate.

A plain band predicate plans as a nested loop over all pairs; with bucket keys Spark hashes, and
AQE splits a crowded bucket.  One side is replicated to the neighbouring buckets, by a constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str, low: float, high: float) -> DataFrame:
    """Pairs with ``low <= right - left <= high`` within equal keys."""
    size = max(high - low, 1e-6 * max(abs(low), abs(high)), 1e-9)
    bucket = lambda c: F.floor(c / size)
    # the band's own width, from its lower end; the margin is for rounding of the sums
    reach = F.sequence(bucket(F.col(left_value) + low - size / 1000), bucket(F.col(left_value) + high + size / 1000))
    a = left.withColumn("_b", F.explode(reach))
    b = right.withColumn("_b", bucket(F.col(right_value)))
    near = (F.col(right_value) - F.col(left_value)).between(low, high)
    return a.join(b, [*keys, "_b"]).where(near).drop("_b")


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """array<struct<cx,cy>> of the grid cells that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def box_join(points: DataFrame, boxes: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``points(key..., px, py)`` with the ``boxes(key..., x0, y0, x1, y1)`` that hold them."""
    a = points.withColumn("_c", F.struct(F.floor(F.col("px") / size).alias("cx"), F.floor(F.col("py") / size).alias("cy")))
    b = boxes.withColumn("_c", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    return a.join(b, [*keys, "_c"]).where("px between x0 and x1 and py between y0 and y1").drop("_c")


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pairs of ``left(px, py)`` and ``right(qx, qy)`` at most ``radius`` apart.  Spark doesn't foresee what the
    cells add to a side, so the join is shuffled and no side goes through the driver."""
    around = cells(F.col("px") - radius, F.col("py") - radius, F.col("px") + radius, F.col("py") + radius, radius)
    a = left.withColumn("_c", F.explode(around))
    b = right.withColumn("_c", F.struct(F.floor(F.col("qx") / radius).alias("cx"), F.floor(F.col("qy") / radius).alias("cy")))
    return a.hint("merge").join(b, [*keys, "_c"]).where(F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")) <= radius).drop("_c")


def best_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; Spark limits each group before it is shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def mode_cluster(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """(key..., mode, support): the median of the largest group within ``tol`` of one of its
    values (a share of it); of equal groups the one about the smallest value.

    Groups are frames of a range window over the logarithm, so no pair is formed.
    """
    v = F.col(value)
    by = ", ".join(f"`{k}`" for k in keys)
    # as SQL, since frames of the Python API take whole numbers only
    count = F.expr(f"count(1) over (partition by {by} order by _log range between {-math.log1p(-tol) + 1e-12!r}D preceding and {math.log1p(tol) + 1e-12!r}D following)")
    sized = df.where(v > 0).withColumn("_log", F.log(v)).withColumn("_n", count)
    top = best_per(sized, keys, [F.desc("_n"), F.asc(value)]).select(*keys, v.alias("_v"), F.col("_n").alias("support"))
    members = df.where(v > 0).join(top, keys).where(F.abs(v - F.col("_v")) <= tol * F.col("_v") + 1e-9)
    return members.groupBy(*keys).agg(F.median(value).alias("mode"), F.first("support").alias("support"))

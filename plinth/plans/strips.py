"""Plans encoded from the part table: a strip of four rooms each, drawn as paired wall faces.

A plan is four consecutive part keys; a room is 4000 mm deep and 2000 + 100 * p_size mm wide;
the partition after a room has a 900 mm gap if its size is even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH, OUTER, INNER, GAP = 4000.0, 200.0, 100.0, 900.0


def strips(part: DataFrame) -> DataFrame:
    """(plan_id, k, width, x0, x1, door) of each room."""
    rooms = part.select(F.floor(F.col("p_partkey") / 4).cast("string").alias("plan_id"), (F.col("p_partkey") % 4).cast("int").alias("k"), (2000 + 100 * F.col("p_size")).cast("double").alias("width"), (F.col("p_size") % 2 == 0).alias("door"))
    w = Window.partitionBy("plan_id").orderBy("k")
    return rooms.withColumn("x1", F.sum("width").over(w)).withColumn("x0", F.col("x1") - F.col("width")).withColumn("last", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("k"))) == 1)


def _line(ax, ay, bx, by) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    p = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    return F.array(p(ax, ay), p(bx, by))


def primitives(part: DataFrame) -> DataFrame:
    """Wall faces as primitives in millimetres (one millimetre a point)."""
    rooms = strips(part)
    o, i = OUTER / 2, INNER / 2
    x0, x1, mid = F.col("x0"), F.col("x1"), DEPTH / 2
    level = [_line(x0, y + s, x1, y + s) for y in (0.0, DEPTH) for s in (-o, o)]
    first = F.when(F.col("k") == 0, F.array(_line(-o, 0, -o, DEPTH), _line(o, 0, o, DEPTH))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    whole = F.array(*[_line(x1 + s, 0, x1 + s, DEPTH) for s in (-i, i)])
    split = F.array(*[_line(x1 + s, a, x1 + s, b) for s in (-i, i) for a, b in ((0, mid - GAP / 2), (mid + GAP / 2, DEPTH))])
    closing = F.array(*[_line(x1 + s, 0, x1 + s, DEPTH) for s in (-o, o)])
    after = F.when(F.col("last"), closing).when(F.col("door"), split).otherwise(whole)
    lines = rooms.select("plan_id", "k", F.posexplode(F.concat(F.array(*level), first, after)).alias("n", "points"))
    return lines.select(
        "plan_id", (F.col("k") * 16 + F.col("n")).alias("prim_id"), "points", F.lit(False).alias("closed"), F.lit(True).alias("stroked"), F.lit(False).alias("filled"),
        F.lit(0.5).cast("double").alias("width"), F.lit("A-WALL").alias("layer"), F.struct(*[F.lit(0.0).alias(c) for c in "rgb"]).alias("color"),
    )

"""Scales of any number of plans as tables: dimensions beside lines, title blocks, door arcs, by trust.

The rules and constants are those of :mod:`plinth.plans.scale`.  Primitives are ``(plan_id, prim_id,
points, closed)`` and texts ``(plan_id, text_id, text, x, y, height, angle)``, in page points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.functions import text as tx
from plinth.operators.joins import best_per, mode_cluster
from plinth.operators.segments import nearest_segment
from plinth.plans.scale import DEFAULT_RATIO, DOOR_MM, LEAST, MOST, POINT_MM

PLAN = ["plan_id"]
#: Cells in which texts meet lines, and the share of a line's run that a text must stand beside.
CELL, BESIDE = 50.0, (0.02, 0.98)
LEAST_LINE, LINE_DEGREES = 5.0, 6.0
#: What a candidate for a door's arc needs: points, residual over radius, turn.
ARC_POINTS, ARC_RESIDUAL, ARC_SPAN = 5, 0.02, 0.6


def lines(primitives: DataFrame) -> DataFrame:
    """(plan_id, seg, ax, ay, bx, by): the lines of primitives in their order, closing ones too."""
    p = F.col("points")
    ring = F.when(F.col("closed") & (F.size(p) > 2), F.concat(p, F.slice(p, 1, 1))).otherwise(p)
    steps = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.size(ring)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    each = primitives.where(F.size("points") > 1).select("plan_id", "prim_id", F.posexplode(steps).alias("_k", "s"))
    each = each.select("plan_id", (F.shiftleft(F.col("prim_id").cast("long"), 24) + F.col("_k")).alias("seg"), "s.*")
    return each.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > 1e-6)


def dimension_ratios(texts: DataFrame, segs: DataFrame) -> DataFrame:
    """(plan_id, point, s_seg, ratio): what each written dimension says about the nearest line beside it."""
    told = texts.withColumn("value", tx.dimension_value(F.col("text"))).where("value is not null")
    points = told.select("plan_id", F.col("text_id").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"), F.greatest(4 * F.col("height"), F.lit(10.0)).alias("reach"), "value", "angle")
    ends = [F.col(c) for c in ("s_ax", "s_ay", "s_bx", "s_by")]
    vx, vy = ends[2] - ends[0], ends[3] - ends[1]
    ratio = F.col("value") / F.hypot(vx, vy)
    fits = (F.hypot(vx, vy) >= LEAST_LINE) & g.is_parallel(vx, vy, F.cos("angle"), F.sin("angle"), LINE_DEGREES) & g.project_param(F.col("px"), F.col("py"), *ends).between(*BESIDE) & ratio.between(LEAST, MOST)
    return nearest_segment(points, segs, PLAN, CELL, fits, [F.col("s_seg")]).select("plan_id", "point", "s_seg", ratio.alias("ratio"))


def from_dimensions(texts: DataFrame, segs: DataFrame) -> DataFrame:
    agreed = mode_cluster(dimension_ratios(texts, segs), PLAN, "ratio", 0.02)
    return agreed.select("plan_id", F.col("mode").alias("mm_per_pt"), F.least(F.lit(0.98), 0.55 + 0.15 * F.col("support")).alias("confidence"), F.col("support").cast("long").alias("support"))


def from_titles(texts: DataFrame) -> DataFrame:
    told = texts.withColumn("_ratio", tx.scale_ratio(F.col("text"))).where("_ratio is not null")
    first = best_per(told, PLAN, [F.asc("text_id")])
    return first.select("plan_id", (F.col("_ratio") * POINT_MM).alias("mm_per_pt"), F.lit(0.6).alias("confidence"), F.lit(1).cast("long").alias("support"))


def from_doors(primitives: DataFrame) -> DataFrame:
    p = F.col("points")
    fits = lambda c: (c["r"] >= 1e-6) & (c["rms"] <= ARC_RESIDUAL * c["r"]) & (g.arc_span(p, c["cx"], c["cy"]) >= ARC_SPAN)
    radius = g.bound(g.circle_of(p), lambda c: F.when(fits(c), c["r"]))
    arcs = primitives.where(~F.col("closed") & (F.size("points") >= ARC_POINTS)).select("plan_id", F.explode(F.array_compact(F.array(radius))).alias("r"))
    agreed = mode_cluster(arcs, PLAN, "r", 0.05)
    told = agreed.select("plan_id", (DOOR_MM / F.col("mode")).alias("mm_per_pt"), F.lit(0.35).alias("confidence"), F.col("support").cast("long").alias("support"))
    return told.where(F.col("mm_per_pt").between(LEAST, MOST))


def find_scale(plans: DataFrame, primitives: DataFrame, texts: DataFrame) -> DataFrame:
    """(plan_id, mm_per_pt, source, confidence, support) of ``plans(plan_id, explicit)``: the most trusted
    source that tells a scale.  An explicit one that can't be read falls through."""
    explicit = plans.select("plan_id", tx.scale_argument(F.col("explicit")).alias("mm_per_pt"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("support")).where("mm_per_pt is not null")
    default = plans.select("plan_id", F.lit(DEFAULT_RATIO * POINT_MM).alias("mm_per_pt"), F.lit(0.1).alias("confidence"), F.lit(0).cast("long").alias("support"))
    told = [("explicit", explicit), ("dimension", from_dimensions(texts, lines(primitives))), ("titleblock", from_titles(texts)), ("door", from_doors(primitives)), ("default", default)]
    every = None
    for rank, (source, df) in enumerate(told):
        row = df.select("plan_id", F.struct(F.lit(rank).alias("rank"), "mm_per_pt", F.lit(source).alias("source"), "confidence", "support").alias("s"))
        every = row if every is None else every.unionByName(row)
    best = every.groupBy("plan_id").agg(F.min("s").alias("s"))
    return plans.select("plan_id").distinct().join(best, "plan_id").select("plan_id", "s.mm_per_pt", "s.source", "s.confidence", "s.support")

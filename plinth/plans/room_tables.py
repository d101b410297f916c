"""Rooms, their openings and strokes as tables, for any number of plans.

Rules and constants are those of :mod:`plinth.plans.rooms` and :mod:`plinth.plans.extract`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators.joins import best_per, box_join, cells
from plinth.operators.segments import face_areas
from plinth.plans.owners import owners
from plinth.plans.rooms import MIN_AREA, ON_DART, OUTSIDE, SLIVER

#: Cells in which points meet boxes.
CELL = 2000.0
#: How far from an opening's middle a stroke counts, in widths along and across the wall.
ALONG, ACROSS = 1.4, 1.5


def rooms_of(faced: DataFrame, keys: list[str], min_area: float = MIN_AREA) -> DataFrame:
    """(key..., room, face, gross): faces that are no sliver and not too small, numbered in their order."""
    round_about = faced.groupBy(*keys, "face").agg(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("around"))
    kept = face_areas(faced, keys).join(round_about, [*keys, "face"]).where((F.col("area") / 1e6 >= min_area) & (F.col("area") / (F.col("around") * F.col("around")) >= SLIVER))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("face"))
    return kept.select(*keys, number.alias("room"), "face", (F.col("area") / 1e6).alias("gross"))


def room_edges(faced: DataFrame, rooms: DataFrame, openings: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., a, b, kind, via, shared_m): an edge for each opening between two rooms or to the
    outside (b is null), and a wall edge for neighbours without one.

    ``openings(key..., via, seg, px, py, kind)``: ``seg`` is the wall they are in, p their middle.  An
    opening counts once: for the first room, neighbour and dart, in the order of walks around rooms,
    whose dart it lies on.
    """
    across = faced.select(*keys, F.col("dart").bitwiseXOR(F.lit(1).cast("long")).alias("dart"), F.col("face").alias("other"))
    outer = face_areas(faced, keys).where("area <= 0").select(*keys, F.col("face").alias("other"), F.lit(True).alias("outside")).hint("merge")
    other = rooms.select(*keys, F.col("face").alias("other"), F.col("room").alias("b"))
    sides = faced.join(rooms.select(*keys, "face", F.col("room").alias("a")), [*keys, "face"]).join(across, [*keys, "dart"]).where("face <> other")
    sides = sides.join(other, [*keys, "other"], "left").join(outer, [*keys, "other"], "left")
    # a pair of rooms is looked at once, from the first of them
    sides = sides.where("(b is not null and a < b) or (b is null and outside)")
    met = Window.partitionBy(*keys, "a", "other")
    sides = sides.withColumn("first", F.min("place").over(met)).withColumn("shared_m", F.round(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).over(met) / 1000, 3))
    on = sides.join(openings.hint("merge"), [*keys, "seg"]).where(g.point_seg_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= ON_DART)
    once = best_per(on, [*keys, "via"], [F.asc("a"), F.asc("first"), F.asc("place")])
    through = once.select(*keys, "a", "b", "other", "kind", "via", "shared_m")
    pairs = sides.where("b is not null").select(*keys, "a", "b", "other", "shared_m").distinct()
    walls = pairs.hint("merge").join(through.select(*keys, "a", "other"), [*keys, "a", "other"], "left_anti").select(*keys, "a", "b", "other", F.lit("wall").alias("kind"), F.lit(None).cast(dict(openings.dtypes)["via"]).alias("via"), "shared_m")
    return through.unionByName(walls).drop("other")


def named(edges: DataFrame) -> DataFrame:
    """Edges with rooms named as in models."""
    name = lambda c: F.format_string("R%03d", c)
    return edges.withColumn("b", F.when(F.col("b").isNull(), OUTSIDE).otherwise(name("b"))).withColumn("a", name("a"))


def _vertices(strokes: DataFrame, keys: list[str]) -> DataFrame:
    boxed = strokes.select(*keys, "stroke", "points", F.size("points").alias("n"), g.bbox(F.col("points")).alias("box"))
    return boxed.select(*keys, "stroke", "n", "box", F.explode("points").alias("p")).select(*keys, "stroke", "n", "box", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def opening_strokes(openings: DataFrame, strokes: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """(key..., opening, stroke): strokes with a point in the window of an opening, which is turned with
    its wall.

    ``openings(key..., opening, ox, oy, ux, uy, width)``: middle, direction of the wall, width;
    ``strokes(key..., stroke, points)``.  Points meet windows in cells of ``size``; about a window's
    own size is best where both are crowded.
    """
    reach = (math.hypot(ALONG, ACROSS) + 1e-6) * F.col("width")  # a point in the very corner counts
    boxes = openings.withColumns({"x0": F.col("ox") - reach, "y0": F.col("oy") - reach, "x1": F.col("ox") + reach, "y1": F.col("oy") + reach})
    met = box_join(_vertices(strokes, keys).hint("merge"), boxes, keys, size)
    dx, dy, w = F.col("px") - F.col("ox"), F.col("py") - F.col("oy"), F.col("width")
    inside = (F.abs(dx * F.col("ux") + dy * F.col("uy")) <= ALONG * w) & (F.abs(dy * F.col("ux") - dx * F.col("uy")) <= ACROSS * w)
    # the stroke's own box must come near in both axes too
    r = max(ALONG, ACROSS) * w
    near = (F.col("box.x1") >= F.col("ox") - r) & (F.col("box.x0") <= F.col("ox") + r) & (F.col("box.y1") >= F.col("oy") - r) & (F.col("box.y0") <= F.col("oy") + r)
    return met.where(inside & near).select(*keys, "opening", "stroke").distinct()


def stroke_rooms(strokes: DataFrame, rooms: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """(key..., stroke, room, inside): the room that holds most points of a stroke (ties: the first), if it
    holds half of them.  ``rooms(key..., room, ring)``; strokes meet rooms in the cells of ``size`` of their points.

    A room that holds a point of a stroke is met in that point's cell and is tried on all points there, so
    each cell sends on one room of a stroke; of rooms with the same ring only the first can be the best.
    """
    kinds = dict(strokes.dtypes) | {"room": dict(rooms.dtypes)["room"]}
    axis = lambda points, k: F.transform(points, lambda p: p[k].cast("double")).alias(f"{k}s")
    row = lambda df, kind, points: df.select(*keys, "_c.*", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in ("room", "stroke")], axis(points, "x"), axis(points, "y"))
    first = rooms.where(F.size("ring") > 0).groupBy(*keys, "ring").agg(F.min("room").alias("room"))
    box = g.bbox(F.col("ring"))
    celled = first.withColumn("_b", box).withColumn("_c", F.explode(cells(F.col("_b.x0"), F.col("_b.y0"), F.col("_b.x1"), F.col("_b.y1"), size))).drop("_b")
    within = F.array_distinct(F.transform("points", lambda p: F.struct(F.floor(p["x"] / size).alias("cx"), F.floor(p["y"] / size).alias("cy"))))
    n = int(strokes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = strokes.select(*keys, "stroke", "points").repartition(n, *keys, "stroke").withColumn("_c", F.explode(within))
    together = row(celled, 0, F.col("ring")).unionByName(row(drawn, 1, F.col("points")))
    for k in [*keys, "cx", "cy"]:
        together = together.where(F.col(k).isNotNull())
    # few bytes and much work, so cells are dealt out by number and not merged by their size
    together = together.repartition(n, *keys, "cx", "cy").sortWithinPartitions(*keys, "cx", "cy", "kind", "room")
    told = together.mapInArrow(owners(len(keys)), ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, "stroke", "room"]], "inside long"]))
    best = told.groupBy(*keys, "stroke").agg(F.min(F.struct((-F.col("inside")).alias("less"), "room")).alias("_best"))
    return best.select(*keys, "stroke", F.col("_best.room").alias("room"), (-F.col("_best.less")).alias("inside"))

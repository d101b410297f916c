"""Walls as tables: lines, face pairs, suppression and corner bridging by joins, for any number of plans.

The rules and constants are those of :mod:`plinth.plans.walls`, which does the same for one plan in
memory.  Segments are ``(key..., seg, ax, ay, bx, by, layer)`` in millimetres, ``seg`` their order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import intervals
from plinth.operators.joins import box_join
from plinth.operators.rounds import elect, follow, match, settled, suppress
from plinth.operators.segments import CELL, cell_of, run_cells, touches
from plinth.plans.walls import (
    ANGLE_TOL, CORNER_ANGLES, FREE_TOL, JOIN_TOL, MAX_LEG, MAX_OPENING, MAX_THICKNESS, MIN_LENGTH, MIN_OPENING, MIN_SHARED, MIN_THICKNESS, OFFSET_TOL, PARALLEL,
)

#: Buckets of the angle about the half turn.
TURN = round(math.pi / ANGLE_TOL)
#: Stretches in which covers of two faces meet.
STRETCH = 5000.0


def lines_of(segs: DataFrame, keys: list[str]) -> DataFrame:
    """``segs`` with ``line`` (the leader's ``seg``), its ``theta`` and ``rho``, and the stretch ``lo`` to
    ``hi`` that the segment covers along its own direction: a segment joins the first leader within
    the tolerances of angle and offset, in the order of angle buckets and segments, or leads."""
    theta = F.pmod(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.lit(math.pi))
    theta = F.when(theta > math.pi - g.EPS, F.lit(0.0)).otherwise(theta)
    named = segs.withColumn("_theta", theta).withColumn("_rho", F.col("ay") * F.cos("_theta") - F.col("ax") * F.sin("_theta"))
    along = lambda x, y: F.col(x) * F.cos("_theta") + F.col(y) * F.sin("_theta")
    named = settled(named.withColumns({"lo": F.least(along("ax", "ay"), along("bx", "by")), "hi": F.greatest(along("ax", "ay"), along("bx", "by"))}))
    bucket = lambda c: F.floor(F.col(c) / ANGLE_TOL)
    points = settled(named.select(*keys, F.col("seg").alias("seq"), F.struct(bucket("_theta").alias("cx"), F.floor(F.col("_rho") / OFFSET_TOL).alias("cy")).alias("cell"), F.col("_theta").alias("x"), F.col("_rho").alias("y")))
    near = lambda a, b: (F.abs(F.col(f"{a}x") - F.col(f"{b}x")) <= ANGLE_TOL) & (F.abs(F.col(f"{a}y") - F.col(f"{b}y")) <= OFFSET_TOL)
    leaders = settled(elect(points, keys, near, 1))
    chosen = follow(points, leaders, keys, near, 1, lambda a, b: [bucket(f"{a}x")])
    told = leaders.select(*keys, F.col("seq").alias("line"), F.col("x").alias("theta"), F.col("y").alias("rho"))
    return named.drop("_theta", "_rho").join(chosen.select(*keys, F.col("seq").alias("seg"), F.col("leader").alias("line")), [*keys, "seg"]).join(told, [*keys, "line"])


def wall_pairs(segs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Walls (key..., wall, ax, ay, bx, by, thickness, layer) between pairs of parallel lines, over all
    that either covers, and openings (key..., wall, t0, t1): where not both do.

    ``wall`` is a struct of the two lines, that of the smaller angle first.
    """
    placed = settled(lines_of(segs, keys))
    lines = settled(placed.groupBy(*keys, "line").agg(F.first("theta").alias("theta"), F.first("rho").alias("rho"), F.min("layer").alias("layer")))
    cover = settled(intervals.merge(placed.select(*keys, "line", "lo", "hi"), [*keys, "line"], JOIN_TOL))
    sizes = cover.groupBy(*keys, "line").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"), F.min("lo").alias("from"), F.max("hi").alias("to"))
    known = settled(lines.join(sizes, [*keys, "line"]))
    bands = known.withColumn("_a", F.floor(F.col("theta") / ANGLE_TOL)).withColumn("_b", F.floor(F.col("rho") / MAX_THICKNESS))
    one = bands.select(*keys, *[F.col(c).alias(f"p_{c}") for c in known.columns if c not in keys], F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.pmod(F.col("_a") + i, F.lit(TURN)))).alias("_a"), "_b")
    one = one.withColumn("_b", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
    two = bands.select(*keys, *[F.col(c).alias(f"q_{c}") for c in known.columns if c not in keys], F.pmod(F.col("_a"), F.lit(TURN)).alias("_a"), "_b")
    turned = F.abs(F.col("p_theta") - F.col("q_theta"))
    first = (F.col("p_theta") < F.col("q_theta")) | ((F.col("p_theta") == F.col("q_theta")) & (F.col("p_line") < F.col("q_line")))
    thickness = F.abs(F.col("p_rho") - F.col("q_rho"))
    found = one.join(two, [*keys, "_a", "_b"]).where(first & (F.least(turned, math.pi - turned) <= ANGLE_TOL) & thickness.between(MIN_THICKNESS, MAX_THICKNESS))
    shorter = F.least("p_covered", "q_covered")
    found = found.withColumn("wall", F.struct(F.col("p_line").alias("one"), F.col("q_line").alias("two"))).withColumns({"from": F.least("p_from", "q_from"), "to": F.greatest("p_to", "q_to")})
    found = settled(found.where((F.col("to") - F.col("from") >= MIN_LENGTH) & (shorter >= g.EPS)))
    name = [*keys, "wall"]
    side = lambda p: found.select(*name, F.col(f"{p}_line").alias("line")).join(cover, [*keys, "line"]).drop("line").hint("merge")
    both = settled(intervals.intersect(side("p"), side("q"), name, STRETCH))
    solid = both.groupBy(*name).agg(F.sum(F.col("hi") - F.col("lo")).alias("solid"))
    kept = settled(found.join(solid, name).where(F.col("solid") >= MIN_SHARED * shorter))
    c, s, rho = F.cos("p_theta"), F.sin("p_theta"), (F.col("p_rho") + F.col("q_rho")) / 2
    at = lambda t: (c * F.col(t) - s * rho, s * F.col(t) + c * rho)
    (ax, ay), (bx, by) = at("from"), at("to")
    walls = kept.select(*name, ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), thickness.alias("thickness"), F.least("p_layer", "q_layer").alias("layer"))
    bounds = kept.select(*name, "from", "to")
    gaps = intervals.complement(both, name, bounds).where((F.col("hi") - F.col("lo")).between(MIN_OPENING, MAX_OPENING))
    openings = gaps.join(bounds, name).select(*name, (F.col("lo") - F.col("from")).alias("t0"), (F.col("hi") - F.col("from")).alias("t1"))
    return settled(walls), settled(openings)


def _sides(walls: DataFrame, keys: list[str], p: str) -> DataFrame:
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    named = walls.withColumn("length", length).withColumns({"ux": (F.col("bx") - F.col("ax")) / F.col("length"), "uy": (F.col("by") - F.col("ay")) / F.col("length")})
    return named.select(*keys, *[F.col(c).alias(p + c) for c in ("wall", "ax", "ay", "bx", "by", "thickness", "length", "ux", "uy")])


def _local(p: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Along and across wall ``p`` from its end a."""
    dx, dy = x - F.col(p + "ax"), y - F.col(p + "ay")
    return dx * F.col(p + "ux") + dy * F.col(p + "uy"), dy * F.col(p + "ux") - dx * F.col(p + "uy")


def _parallel() -> Column:
    return F.abs(F.col("k_ux") * F.col("w_uy") - F.col("k_uy") * F.col("w_ux")) <= math.sin(PARALLEL)


def suppress_nested(walls: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """Walls without those that run inside a kept thicker one, larger faces first."""
    strong = _sides(walls, keys, "k_")
    strong = strong.withColumn("_c", F.explode(run_cells(F.col("k_ax"), F.col("k_ay"), F.col("k_bx"), F.col("k_by"), size, F.col("k_thickness") / 2 + 1.0)))
    weak = _sides(walls, keys, "w_").withColumn("_c", F.explode(run_cells(F.col("w_ax"), F.col("w_ay"), F.col("w_bx"), F.col("w_by"), size)))
    met = strong.join(weak, [*keys, "_c"]).where((F.col("k_thickness") > F.col("w_thickness") + g.EPS) & _parallel())
    before = F.struct(-F.col("k_thickness") * F.col("k_length"), "k_wall") < F.struct(-F.col("w_thickness") * F.col("w_length"), "w_wall")
    (t0, d0), (t1, d1) = (_local("k_", F.col(f"w_{e}x"), F.col(f"w_{e}y")) for e in "ab")
    inside = (F.greatest(F.abs(d0), F.abs(d1)) <= F.col("k_thickness") / 2) & (F.least(t0, t1) <= F.col("k_length")) & (F.greatest(t0, t1) >= 0)
    return suppress(walls, met.where(before & inside).select(*keys, F.col("k_wall").alias("strong"), F.col("w_wall").alias("weak")), keys, "wall")


def dedupe_walls(walls: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """Walls without those that describe the run of a longer one again."""
    reach = F.greatest(F.lit(20.0), 0.1 * F.col("k_length"))
    mid = lambda p, k: (F.col(f"{p}a{k}") + F.col(f"{p}b{k}")) / 2
    strong = _sides(walls, keys, "k_")
    strong = strong.withColumns({"x0": mid("k_", "x") - reach, "y0": mid("k_", "y") - reach, "x1": mid("k_", "x") + reach, "y1": mid("k_", "y") + reach})
    weak = _sides(walls, keys, "w_").withColumns({"px": mid("w_", "x"), "py": mid("w_", "y")})
    met = box_join(weak, strong, keys, size).where((F.hypot(F.col("px") - mid("k_", "x"), F.col("py") - mid("k_", "y")) <= reach) & _parallel())
    met = met.where((F.abs(F.col("k_thickness") - F.col("w_thickness")) <= OFFSET_TOL) & (F.abs(_local("k_", F.col("w_ax"), F.col("w_ay"))[1]) <= OFFSET_TOL))
    rank = lambda p: F.struct(-F.col(f"{p}length"), -F.col(f"{p}thickness") * F.col(f"{p}length"), f"{p}wall")
    return suppress(walls, met.where(rank("k_") < rank("w_")).select(*keys, F.col("k_wall").alias("strong"), F.col("w_wall").alias("weak")), keys, "wall")


def free_ends(walls: DataFrame, keys: list[str], tol: float = FREE_TOL, size: float = CELL) -> DataFrame:
    """(key..., wall, end, px, py, ux, uy): ends of walls that no other wall comes within ``tol`` of, and
    the direction out of the wall there."""
    sided = _sides(walls, keys, "")
    ends = sided.select(*keys, "wall", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("ax").alias("px"), F.col("ay").alias("py"), (-F.col("ux")).alias("ux"), (-F.col("uy")).alias("uy")), F.struct(F.lit("b").alias("end"), F.col("bx").alias("px"), F.col("by").alias("py"), "ux", "uy"))).alias("e")).select(*keys, "wall", "e.*")
    spread = walls.hint("merge").select(*keys, F.col("wall").alias("o_wall"), *[F.col(c).alias(f"o_{c}") for c in ("ax", "ay", "bx", "by")])
    spread = spread.withColumn("_c", F.explode(run_cells(*[F.col(f"o_{c}") for c in ("ax", "ay", "bx", "by")], size, tol + 1.0)))
    met = ends.withColumn("_c", cell_of(F.col("px"), F.col("py"), size)).join(spread, [*keys, "_c"]).where("wall <> o_wall")
    joined = met.where(g.point_seg_distance(F.col("px"), F.col("py"), *[F.col(f"o_{c}") for c in ("ax", "ay", "bx", "by")]) <= tol)
    return ends.hint("merge").join(joined.select(*keys, "wall", "end"), [*keys, "wall", "end"], "left_anti")


def corners(free: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., one, two, total, legs..., x, y): pairs of free ends whose extensions meet at a corner;
    ``one`` and ``two`` are structs of wall and end."""
    size = 2 * MAX_LEG
    name = lambda p: free.hint("merge").select(*keys, F.struct("wall", "end").alias(f"{p}end"), *[F.col(c).alias(p + c) for c in ("px", "py", "ux", "uy")])
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.floor(F.col("i_px") / size) + i).alias("cx"), (F.floor(F.col("i_py") / size) + j).alias("cy"))))))
    met = name("i_").withColumn("_c", around).join(name("j_").withColumn("_c", cell_of(F.col("j_px"), F.col("j_py"), size)), [*keys, "_c"])
    met = met.where((F.col("i_end") < F.col("j_end")) & (F.col("i_end.wall") != F.col("j_end.wall")))
    ux, uy, vx, vy = (F.col(c) for c in ("i_ux", "i_uy", "j_ux", "j_uy"))
    det = F.when(F.abs(ux * vy - uy * vx) >= g.EPS, ux * vy - uy * vx)
    dx, dy = F.col("j_px") - F.col("i_px"), F.col("j_py") - F.col("i_py")
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ux * vx + uy * vy))))
    legs = met.withColumns({"leg_one": (dx * vy - dy * vx) / det, "leg_two": (dx * uy - dy * ux) / det, "turn": turn})
    fits = (F.col("leg_one") > 0) & (F.col("leg_one") <= MAX_LEG) & (F.col("leg_two") > 0) & (F.col("leg_two") <= MAX_LEG) & F.col("turn").between(*CORNER_ANGLES)
    return legs.where(fits).select(*keys, F.col("i_end").alias("one"), F.col("j_end").alias("two"), (F.col("leg_one") + F.col("leg_two")).alias("total"), "leg_one", "leg_two", (F.col("i_px") + ux * F.col("leg_one")).alias("x"), (F.col("i_py") + uy * F.col("leg_one")).alias("y"))


def bridge_corners(walls: DataFrame, openings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Walls extended to the corners that pairs of their free ends miss, shortest extension first and each
    end once, with ``source``; openings with ``bridged``: moved where end a moved, and those of the
    extensions."""
    taken = settled(match(settled(corners(settled(free_ends(walls, keys)), keys)), keys, ["total", "one", "two"]))
    side = lambda k: taken.select(*keys, F.col(f"{k}.wall").alias("wall"), F.col(f"{k}.end").alias("end"), F.col(f"leg_{k}").alias("leg"), "x", "y")
    moved = settled(side("one").unionByName(side("two")))
    at = lambda e: moved.where(F.col("end") == e).select(*keys, "wall", F.col("leg").alias(f"leg_{e}"), F.col("x").alias(f"{e}_x"), F.col("y").alias(f"{e}_y"))
    both = walls.join(at("a"), [*keys, "wall"], "left").join(at("b"), [*keys, "wall"], "left")
    both = settled(both.withColumn("_length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))))
    grown = both.withColumns({c: F.coalesce(f"{c[0]}_{c[1]}", c) for c in ("ax", "ay", "bx", "by")})
    source = F.when(F.col("leg_a").isNotNull() | F.col("leg_b").isNotNull(), "corner-bridged").otherwise("paired-faces")
    shift = both.select(*keys, "wall", F.coalesce("leg_a", F.lit(0.0)).alias("_shift"))
    old = openings.join(shift, [*keys, "wall"]).select(*keys, "wall", (F.col("t0") + F.col("_shift")).alias("t0"), (F.col("t1") + F.col("_shift")).alias("t1"), F.lit(False).alias("bridged"))
    end = F.col("_length") + F.coalesce("leg_a", F.lit(0.0))
    gaps = F.array(F.when(F.col("leg_a").isNotNull(), F.struct(F.lit(0.0).alias("t0"), F.col("leg_a").alias("t1"))), F.when(F.col("leg_b").isNotNull(), F.struct(end.alias("t0"), (end + F.col("leg_b")).alias("t1"))))
    new = both.select(*keys, "wall", F.explode(F.array_compact(gaps)).alias("o")).select(*keys, "wall", "o.t0", "o.t1", F.lit(True).alias("bridged"))
    return grown.withColumn("source", source).drop("leg_a", "leg_b", "a_x", "a_y", "b_x", "b_y", "_length"), old.unionByName(new)


def find_walls(segs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Walls and openings of segments: pairs, suppression, corners."""
    walls, openings = wall_pairs(segs, keys)
    kept = settled(dedupe_walls(settled(suppress_nested(walls, keys)), keys))
    return bridge_corners(kept, openings.join(kept.select(*keys, "wall"), [*keys, "wall"], "left_semi"), keys)

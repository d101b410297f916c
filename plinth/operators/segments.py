"""Segments on a grid: the cells that a segment runs through, crossings, splitting, welding, faces.

Rows are ``(key..., seg, ax, ay, bx, by)``; ``seg`` is a whole number, unique within a key, that
stands for the order in which a loop would see the segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators.cuts import COLUMNS, cut_runs
from plinth.operators.rounds import cycles, elect, follow, peel, settled

#: Edge of a grid cell.  A segment is in about length / CELL cells.
CELL = 1000.0
#: Points so near are one vertex, and shorter pieces are dropped.
WELD = 30.0
#: Edges are numbered by segment and, in so many bits, piece.
PIECE_BITS = 21
#: Half of what a square cell may measure so that its points are within 1 of each other.
_CLOSE = 0.7071


def cell_of(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def run_cells(ax: Column, ay: Column, bx: Column, by: Column, size: float, pad: Column | float = 1.0) -> Column:
    """array<struct<cx,cy>> of the cells that a segment, ``pad`` thick on each side, runs through:
    column by column of the grid the rows between its lowest and highest point there."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    swap = ax > bx
    (x0, y0), (x1, y1) = (F.when(swap, bx).otherwise(ax), F.when(swap, by).otherwise(ay)), (F.when(swap, ax).otherwise(bx), F.when(swap, ay).otherwise(by))
    slope = F.try_divide(y1 - y0, x1 - x0)
    # how far the edge of the thick segment is from its middle, up and down
    rise = F.coalesce(pad * F.sqrt(1 + slope * slope), pad)
    low, high = F.least(y0, y1) - pad, F.greatest(y0, y1) + pad

    def rows(i: Column) -> Column:
        left, right = F.greatest(i * size, x0), F.least((i + 1) * size, x1)
        at = lambda x: y0 + F.coalesce(slope, F.lit(0.0)) * (F.least(F.greatest(x, x0), x1) - x0)
        steep = slope.isNull() | (F.abs(slope) > 1e6)
        u = F.when(steep, low).otherwise(F.greatest(low, F.least(at(left), at(right)) - rise))
        v = F.when(steep, high).otherwise(F.least(high, F.greatest(at(left), at(right)) + rise))
        return F.transform(F.sequence(F.floor(u / size), F.floor(F.greatest(u, v) / size)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor((x0 - pad) / size), F.floor((x1 + pad) / size)), rows))


def _ends(p: str = "") -> list[Column]:
    return [F.col(p + c) for c in ("ax", "ay", "bx", "by")]


def _named(segs: DataFrame, keys: list[str], p: str) -> DataFrame:
    return segs.select(*keys, *[F.col(c).alias(p + c) for c in ("seg", "ax", "ay", "bx", "by")])


def crossings(segs: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """(key..., one, two, x, y) of segments that meet in a point, ``one < two``.  A pair meets in
    every cell that both run through and is told in the cell that holds the point."""
    run = lambda p: {p + "dx": F.col(p + "bx") - F.col(p + "ax"), p + "dy": F.col(p + "by") - F.col(p + "ay")}
    indexed = lambda p: _named(segs, keys, p).withColumns({**run(p), "_c": F.explode(run_cells(*_ends(p), size))}).drop(p + "bx", p + "by")
    both = indexed("p_").hint("merge").join(indexed("q_"), [*keys, "_c"]).where("p_seg < q_seg")
    # the arithmetic of seg_intersection on runs taken once a segment: written out on the ends, what a
    # pair costs becomes a method too long for the JVM to compile
    ax, ay, px, py, qx, qy = (F.col(c) for c in ("p_ax", "p_ay", "p_dx", "p_dy", "q_dx", "q_dy"))
    det, cx, cy = px * qy - py * qx, F.col("q_ax") - ax, F.col("q_ay") - ay
    s, t = F.try_divide(cx * qy - cy * qx, det), F.try_divide(cx * py - cy * px, det)
    both = both.where((F.abs(det) >= g.EPS) & (s >= -g.ON) & (s <= 1 + g.ON) & (t >= -g.ON) & (t <= 1 + g.ON))
    met = both.select(*keys, "_c", F.col("p_seg").alias("one"), F.col("q_seg").alias("two"), F.inline(F.array(F.struct((ax + s * px).alias("x"), (ay + s * py).alias("y")))))
    return met.where((F.floor(F.col("x") / size) == F.col("_c.cx")) & (F.floor(F.col("y") / size) == F.col("_c.cy"))).drop("_c")


def touches(segs: DataFrame, points: DataFrame, keys: list[str], reach: float, size: float = CELL) -> DataFrame:
    """(key..., seg, t, px, py) of ``points(key..., px, py)`` at most ``reach`` from the line of a segment
    and beside its run; t is the foot's place, 0 to 1."""
    ax, ay, bx, by = _ends()
    dx, dy = F.col("_dx"), F.col("_dy")
    # what project_param takes of a segment, once a segment and not once a pair
    spread = segs.hint("merge").withColumns({"_dx": bx - ax, "_dy": by - ay})
    spread = spread.select(*keys, "seg", "ax", "ay", "_dx", "_dy", F.when(F.hypot(dx, dy) >= g.EPS, dx * dx + dy * dy).alias("_d2"), F.explode(run_cells(*_ends(), size, reach + 1.0)).alias("_c"))
    met = spread.join(points.select(*keys, "px", "py").distinct().withColumn("_c", cell_of(F.col("px"), F.col("py"), size)), [*keys, "_c"])
    t = F.try_divide((F.col("px") - ax) * dx + (F.col("py") - ay) * dy, F.col("_d2"))
    met = met.where((t > 0) & (t < 1)).select(*keys, "seg", "ax", "ay", "_dx", "_dy", "px", "py", F.inline(F.array(F.struct(t.alias("t")))))
    return met.where(F.hypot(ax + dx * F.col("t") - F.col("px"), ay + dy * F.col("t") - F.col("py")) <= reach).select(*keys, "seg", "t", "px", "py")


def split(segs: DataFrame, keys: list[str], tol: float = WELD, size: float = CELL) -> DataFrame:
    """(key..., seg, piece, ax, ay, bx, by): the pieces of segments between crossings and ends of
    others on them; cuts within ``tol`` of an end, and pieces up to ``tol``, go.  ``piece`` grows along a segment.

    Crossings grow with the square of a crowd, but the pieces of a segment are at most its length over ``tol``;
    so crossings are neither written nor shuffled, only the runs of cuts are (see :mod:`plinth.operators.cuts`).
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    # few bytes and much work, so segments, and their cells, are dealt out by number and not merged by their size
    n = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segs = settled(segs.select(*keys, "seg", "ax", "ay", "bx", "by").where(length >= g.EPS).repartition(n, *keys, "seg"))
    spread = segs.select("*", length.alias("length"), F.explode(run_cells(*_ends(), size, tol + 1.0)).alias("_c")).select(*keys, "_c.*", *[c for c in COLUMNS if c not in ("cx", "cy")])
    celled = spread.repartition(n, *keys, "cx", "cy").sortWithinPartitions(*keys, "cx", "cy")
    kinds = dict(segs.dtypes)
    cuts = celled.mapInArrow(cut_runs(len(keys), tol, size), ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, "seg"]], "lo double", "hi double"]))
    whole = segs.select(*keys, "seg", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("lo")).withColumn("hi", F.col("lo"))
    runs = whole.unionByName(cuts.select(*keys, "seg", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi")))
    # what no run covers are the pieces
    line = Window.partitionBy(*keys, "seg").orderBy("lo", "hi")
    free = runs.withColumns({"_t": F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)), "piece": F.row_number().over(line)}).where("_t < lo").join(segs, [*keys, "seg"])
    ax, ay, bx, by = _ends()
    point = lambda a, b, t: a + (b - a) * F.col(t)
    cut_up = free.select(*keys, "seg", "piece", point(ax, bx, "_t").alias("ax"), point(ay, by, "_t").alias("ay"), point(ax, bx, "lo").alias("bx"), point(ay, by, "lo").alias("by"))
    return cut_up.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > tol)


def weld(points: DataFrame, keys: list[str], reach: float = WELD) -> DataFrame:
    """(key..., seq, vertex): the earliest points lead, and a point takes the nearest leader before
    it within ``reach`` (ties: the earliest); ``vertex`` is the leader's ``seq``.

    ``points(key..., seq, x, y)``; of equal points only the first can lead.
    """
    celled = settled(points.select(*keys, "seq", "x", "y").withColumn("cell", cell_of(F.col("x"), F.col("y"), reach * _CLOSE)))
    once = celled.groupBy(*keys, "x", "y").agg(F.min("seq").alias("seq"), F.first("cell").alias("cell"))
    apart = lambda a, b: F.hypot(F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y"))
    within = lambda a, b: apart(a, b) <= reach
    leaders = settled(elect(once, keys, within, 2))
    return follow(celled, leaders, keys, within, 2, lambda a, b: [apart(a, b)]).withColumnRenamed("leader", "vertex")


def arrangement(segs: DataFrame, keys: list[str], tol: float = WELD, size: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Vertices (key..., vertex, x, y) and edges (key..., edge, u, v, seg) of segments split and welded,
    without what leads nowhere.  Of pieces between the same vertices the first stays; edges are
    numbered in that order."""
    number = F.shiftleft(F.col("seg").cast("long"), PIECE_BITS) + F.col("piece")
    pieces = settled(split(segs, keys, tol, size).withColumn("_n", number))
    points = pieces.select(*keys, (2 * F.col("_n")).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(pieces.select(*keys, (2 * F.col("_n") + 1).alias("seq"), F.col("bx").alias("x"), F.col("by").alias("y")))
    welded = settled(weld(points, keys, tol))
    end = lambda k, name: welded.where(F.col("seq") % 2 == k).select(*keys, F.shiftright("seq", 1).alias("_n"), F.col("vertex").alias(name))
    welded_ends = [settled(end(0, "u")), settled(end(1, "v"))]
    both = pieces.join(welded_ends[0], [*keys, "_n"]).join(welded_ends[1], [*keys, "_n"]).where("u <> v")
    first = both.groupBy(*keys, F.least("u", "v").alias("_lo"), F.greatest("u", "v").alias("_hi")).agg(F.min(F.struct("_n", "u", "v", "seg")).alias("_e"))
    edges = settled(first.select(*keys, F.col("_e._n").alias("edge"), "_e.u", "_e.v", "_e.seg"))
    vertices = points.withColumnRenamed("seq", "vertex").join(welded.select(*keys, "vertex").distinct(), [*keys, "vertex"], "left_semi")
    return settled(vertices), settled(peel(edges, keys))


def darts_of(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., dart, origin, dest, seg, edge, x, y, x2, y2): each edge both ways, as dart 2 n and its
    twin 2 n + 1; (x, y) is the origin, (x2, y2) the destination."""
    there = edges.select(*keys, (2 * F.col("edge")).alias("dart"), F.col("u").alias("origin"), F.col("v").alias("dest"), "seg", "edge")
    back = edges.select(*keys, (2 * F.col("edge") + 1).alias("dart"), F.col("v").alias("origin"), F.col("u").alias("dest"), "seg", "edge")
    at = lambda name, x, y: vertices.select(*keys, F.col("vertex").alias(name), F.col("x").alias(x), F.col("y").alias(y))
    return there.unionByName(back).join(at("origin", "x", "y"), [*keys, "origin"]).join(at("dest", "x2", "y2"), [*keys, "dest"])


def faces_of(darts: DataFrame, keys: list[str]) -> DataFrame:
    """``darts`` with ``face`` (its least dart) and ``place`` in it: at its end a dart turns into the
    one that comes before its twin, counter-clockwise about the vertex, so inner faces lie left."""
    turn = Window.partitionBy(*keys, "origin").orderBy("_way", "dart")
    way = F.pmod(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")), F.lit(2 * 3.141592653589793))
    about = darts.withColumn("_way", way)
    last = F.last("dart").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = about.select(*keys, F.col("dart").bitwiseXOR(F.lit(1).cast("long")).alias("node"), F.coalesce(F.lag("dart").over(turn), last).alias("next"))
    found = cycles(steps, keys).select(*keys, F.col("node").alias("dart"), F.col("cycle").alias("face"), "place")
    return darts.hint("merge").join(found, [*keys, "dart"])


def face_areas(faced: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., face, darts, area): signed, so the outer face of a component has 0 or less."""
    # relative to the face's own corner, so that far from the origin nothing is lost
    far = F.struct("x", "y").alias("o")
    corner = faced.where("place = 0").select(*keys, "face", far)
    dx, dy = F.col("x") - F.col("o.x"), F.col("y") - F.col("o.y")
    part = (dx * (F.col("y2") - F.col("o.y")) - (F.col("x2") - F.col("o.x")) * dy) / 2
    return faced.join(corner, [*keys, "face"]).groupBy(*keys, "face").agg(F.count("*").alias("darts"), F.sum(part).alias("area"))


def rings(faced: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., face, ring): the corners of faces with positive area, from the least dart's origin on."""
    inner = face_areas(faced, keys).where("area > 0").select(*keys, "face")
    corners = faced.join(inner, [*keys, "face"]).groupBy(*keys, "face").agg(F.sort_array(F.collect_list(F.struct("place", F.struct("x", "y").alias("p")))).alias("_r"))
    return corners.select(*keys, "face", F.transform("_r", lambda c: c["p"]).alias("ring"))


def spacing(segs: DataFrame, keys: list[str]) -> float | None:
    """Side of the square that each segment would have to itself, over all keys; None without segments."""
    low, high = (F.min(F.least("ax", "bx")), F.min(F.least("ay", "by"))), (F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by")))
    each = segs.groupBy(*keys).agg(F.count("*").alias("n"), ((high[0] - low[0]) * (high[1] - low[1])).alias("area"))
    return each.agg(F.sqrt(F.sum("area") / F.sum("n"))).collect()[0][0]


def nearest_segment(points: DataFrame, segs: DataFrame, keys: list[str], size: float, fits: Column, by: list[Column], first: float | None = None) -> DataFrame:
    """``points(key..., point, px, py, reach, ...)`` with the nearest segment at most their own
    ``reach`` away for which ``fits`` holds, ties by ``by``; points without one don't appear.
    Columns of segments start with ``s_``; ``point`` is unique within a key.

    In a crowd of segments nearly all within reach are much farther than the nearest.  With ``first``
    (see :func:`spacing`) points look that far, and those that find none four times as far, up
    to their reach: whatever is nearer than a reach lies within it, so the results are the same.
    """
    if not first or first >= size:
        return _nearest_within(points, segs, keys, size, fits, by)
    left, segs, found, far = settled(points), settled(segs), [], first
    while (most := left.agg(F.max("reach")).collect()[0][0]) is not None:
        whole = far >= most
        looked = left if whole else left.withColumn("_whole", F.col("reach")).withColumn("reach", F.least("reach", F.lit(far)))
        near = settled(_nearest_within(looked, segs, keys, min(size, far), fits, by))
        found.append(near if whole else near.withColumn("reach", F.col("_whole")).drop("_whole"))
        if whole:
            break
        left = settled(left.join(near.select(*keys, "point"), [*keys, "point"], "left_anti").where(F.col("reach") > far))
        far *= 4
    return reduce(DataFrame.unionByName, found) if found else _nearest_within(points, segs, keys, size, fits, by)


def _nearest_within(points: DataFrame, segs: DataFrame, keys: list[str], size: float, fits: Column, by: list[Column]) -> DataFrame:
    named = segs.select(*keys, *[F.col(c).alias(f"s_{c}") for c in segs.columns if c not in keys])
    spread = named.hint("merge").withColumn("_c", F.explode(run_cells(*_ends("s_"), size, min(1.0, size / 100))))
    box = F.transform(F.sequence(F.floor((F.col("px") - F.col("reach")) / size), F.floor((F.col("px") + F.col("reach")) / size)), lambda i: F.transform(F.sequence(F.floor((F.col("py") - F.col("reach")) / size), F.floor((F.col("py") + F.col("reach")) / size)), lambda j: F.struct(i.alias("cx"), j.alias("cy"))))
    away = g.point_seg_distance(F.col("px"), F.col("py"), *_ends("s_"))
    met = points.withColumn("_c", F.explode(F.flatten(box))).join(spread, [*keys, "_c"]).withColumn("distance", away).where((F.col("distance") <= F.col("reach")) & fits)
    rank = F.row_number().over(Window.partitionBy(*keys, "point").orderBy("distance", *by))
    return met.drop("_c").withColumn("_r", rank).where("_r = 1").drop("_r")

"""Room symbols as aggregates over tables: outlines against a catalogue of sizes, rhythms of what fits,
and rhythms of parallel lines.

A detector is a row of :data:`CATALOGUE`: what sizes count, how many it needs, how even they must
be, what pitch their centres have, and what raises its confidence.  The rules are those of
:mod:`plinth.symbols.rooms`.  ``strokes(key..., stroke, points)`` are in millimetres, stroke their
order; ``rooms(key..., category, ring)`` has one row a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators.rounds import elect, follow, settled
from plinth.operators.segments import cell_of
from plinth.symbols.rooms import SANITARY

ANY = (0.0, math.inf)
#: How far apart the ends of a closed stroke may be.
CLOSED = 80.0


@dataclass(frozen=True)
class Item:
    """Sizes that count: longer and shorter side, area, least ratio of the sides."""

    name: str
    long: tuple[float, float]
    short: tuple[float, float]
    area: tuple[float, float] = ANY
    aspect: float = 0.0


@dataclass(frozen=True)
class Pitch:
    """The rhythm of centres along an axis: those within ``apart`` are one row; the axis with most rows
    counts, or the first that fits; ``half`` asks for half as many steps as items."""

    apart: float
    span: tuple[float, float]
    most: float
    axes: tuple[str, str]
    by_rows: bool
    half: bool


@dataclass(frozen=True)
class Detector:
    symbol: str
    kind: str
    items: tuple[Item, ...]
    least: int
    uneven: float
    pitch: Pitch | None
    having: Callable[[], Column]
    told: Callable[[], Column]


def _is(category: str) -> Column:
    return F.when(F.col("category") == category, 1.0).otherwise(0.0)


def _has(*names: str) -> Column:
    return F.arrays_overlap("kinds", F.array(*map(F.lit, names)))


def _upto(most: float, value: Column) -> Column:
    return F.least(F.lit(float(most)), value.cast("double"))


# Sizes, counts and confidences of the detectors.
CATALOGUE = (
    Detector(
        "sanitary", "sanitary", tuple(Item(n, long, short, (0.06, math.inf), aspect) for n, long, short, aspect in SANITARY), 1, math.inf, None,
        lambda: (F.col("room_area") <= 30) & (F.col("category") != "kitchen") & (_has("wc", "bath", "bidet") | (F.col("n") >= 2) | (F.col("category") == "bathroom")),
        lambda: _upto(0.92, 0.55 + 0.12 * _upto(2, F.col("n") - 1) + F.when(_has("wc", "bath"), 0.08).otherwise(0.0)),
    ),
    Detector(
        "parking_bay", "parking", (Item("bay", (4200.0, 6500.0), (2100.0, 3700.0), (8.0, math.inf)),), 1, 0.12, None,
        lambda: (F.col("n") >= 2) | (F.col("category") == "garage"),
        lambda: _upto(0.92, 0.66 + 0.08 * _upto(2, F.col("n") - 1) + 0.10 * _is("garage")),
    ),
    Detector(
        "theatre_seating", "seating", (Item("seat", (400.0, 800.0), (420.0, 700.0), (0.15, 0.6)),), 12, 0.12, Pitch(250.0, (600.0, 1400.0), 0.25, ("y", "x"), True, False),
        lambda: F.lit(True),
        lambda: _upto(0.93, 0.68 + 0.10 * _upto(1, (F.col("n") - 12) / 40) + 0.08 * (1 - _upto(1, F.col("cv") / 0.25)) + 0.08 * _is("auditorium")),
    ),
    Detector(
        "ward_bay", "ward", (Item("bed", (1800.0, 2300.0), (800.0, 1200.0), (1.2, math.inf)),), 3, 0.10, Pitch(0.0, (1800.0, 4200.0), 0.20, ("x", "y"), False, True),
        lambda: F.lit(True),
        lambda: _upto(0.92, 0.68 + 0.08 * _upto(2, F.col("n") - 3) + 0.08 * (1 - _upto(1, F.col("cv") / 0.20)) + 0.08 * _is("ward")),
    ),
)


def outlines(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., stroke, long, short, area, x, y) of closed strokes; (x, y) is the middle of the box."""
    p = F.col("points")
    closed = strokes.where((F.size(p) >= 4) & (F.hypot(p[0]["x"] - F.element_at(p, -1)["x"], p[0]["y"] - F.element_at(p, -1)["y"]) <= CLOSED))
    sized = closed.select(*keys, "stroke", g.oriented_extent(p).alias("e"), (F.abs(g.polygon_area(p)) / 1e6).alias("area"), g.bbox(p).alias("box"))
    return sized.select(*keys, "stroke", "e.long", "e.short", "area", ((F.col("box.x0") + F.col("box.x1")) / 2).alias("x"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("y"))


def _fits(i: Item) -> Column:
    return F.col("long").between(*i.long) & F.col("short").between(*i.short) & F.col("area").between(*i.area) & (F.col("long") >= i.aspect * F.col("short"))


def fitting(loops: DataFrame, keys: list[str]) -> DataFrame:
    """Outlines that a detector counts, with ``symbol`` and ``item``: the first of its sizes that fits."""
    told = []
    for d in CATALOGUE:
        name = F.lit(None).cast("string")
        for i in reversed(d.items):
            name = F.when(_fits(i), i.name).otherwise(name)
        told.append(F.when(name.isNotNull(), F.struct(F.lit(d.symbol).alias("symbol"), name.alias("item"))))
    return loops.withColumn("_t", F.explode(F.array_compact(F.array(*told)))).select(*loops.columns, "_t.symbol", "_t.item")


def _of_symbol(value: Callable[[Detector], object]) -> Column:
    """A detector's own value, by the column ``symbol``."""
    told = F.lit(None)
    for d in CATALOGUE:
        told = F.when(F.col("symbol") == d.symbol, value(d) if isinstance(value(d), Column) else F.lit(value(d))).otherwise(told)
    return told


def _spread(c: str) -> Column:
    return F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))


def pitches(found: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., symbol, rows, steps, pitch, cv) along the axis that counts."""
    paced = [d for d in CATALOGUE if d.pitch]
    name = [*keys, "symbol"]
    axes = found.where(F.col("symbol").isin(*[d.symbol for d in paced])).select(*name, F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("a")).select(*name, "a.*")
    of = lambda f: _of_symbol(lambda d: f(d.pitch) if d.pitch else None)
    along = Window.partitionBy(*name, "axis").orderBy("v")
    fresh = F.when(F.col("v") - F.lag("v").over(along) <= of(lambda p: p.apart), 0).otherwise(1)
    rows = axes.withColumn("_fresh", fresh).withColumn("_row", F.sum("_fresh").over(along)).groupBy(*name, "axis", "_row").agg(F.avg("v").alias("v"))
    step = F.col("v") - F.lag("v").over(along)
    steps = rows.withColumn("step", F.when(step > 1.0, step)).groupBy(*name, "axis").agg(F.count("*").alias("rows"), F.count("step").alias("steps"), F.avg("step").alias("pitch"), _spread("step").alias("cv"))
    n = found.groupBy(*name).agg(F.count("*").alias("n"))
    fits = steps.join(n, name).where((F.col("steps") > 0) & F.col("pitch").between(of(lambda p: p.span[0]), of(lambda p: p.span[1])) & (F.col("cv") <= of(lambda p: p.most)) & (~of(lambda p: p.half) | (F.col("steps") >= F.col("n") / 2 - 1)))
    first = F.struct(F.when(of(lambda p: p.by_rows), -F.col("rows")).otherwise(F.lit(0)).alias("_r"), (F.col("axis") != of(lambda p: p.axes[0])).alias("_a"), "rows", "steps", "pitch", "cv")
    return fits.groupBy(*name).agg(F.min(first).alias("_p")).select(*name, "_p.rows", "_p.steps", "_p.pitch", "_p.cv")


def catalogued(strokes: DataFrame, rooms: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., symbol, kind, confidence, n): the detectors of the catalogue."""
    found = settled(fitting(outlines(strokes, keys), keys))
    name = [*keys, "symbol"]
    sums = found.groupBy(*name).agg(F.count("*").alias("n"), _spread("long").alias("uneven"), F.collect_set("item").alias("kinds"))
    known = rooms.select(*keys, F.coalesce("category", F.lit("unknown")).alias("category"), (F.abs(g.polygon_area(F.col("ring"))) / 1e6).alias("room_area"))
    every = sums.join(pitches(found, keys), name, "left").join(known, keys)
    paced = _of_symbol(lambda d: d.pitch is not None)
    kept = every.where((F.col("n") >= _of_symbol(lambda d: d.least)) & (F.col("uneven") <= _of_symbol(lambda d: d.uneven)) & (~paced | F.col("pitch").isNotNull()))
    kept = kept.where(_of_symbol(lambda d: d.having()))
    return kept.select(*name, _of_symbol(lambda d: d.kind).alias("kind"), _of_symbol(lambda d: d.told()).alias("confidence"), "n")


def _lines(strokes: DataFrame, keys: list[str], least: Column | float) -> DataFrame:
    """(key..., seq, ax, ay, bx, by, length, theta) of the strokes' lines of ``least`` or more."""
    p = F.col("points")
    steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    each = strokes.where(F.size(p) > 1).select(*keys, "stroke", F.posexplode(steps).alias("_k", "s")).select(*keys, (F.shiftleft(F.col("stroke").cast("long"), 24) + F.col("_k")).alias("seq"), "s.*")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return each.withColumns({"length": F.hypot(dx, dy), "theta": F.pmod(F.atan2(dy, dx), F.lit(math.pi))}).where(F.col("length") >= least)


# Treads, their going and how even it is, and escalators' long rails.
TREAD, GOING, UNEVEN_GOING, FAMILY = (600.0, 2400.0), (200.0, 400.0), 0.30, 5.0
LONG_RUN, MANY_TREADS, RAIL_SHARE, RAIL_DEGREES = 4000.0, 8, 0.75, 80.0


def stairs(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., symbol, kind, confidence, n): a family of parallel treads at an even going.  Lines join
    the first family whose first line is within FAMILY degrees: on the circle of doubled angles
    that is a distance."""
    lines = settled(_lines(strokes, keys, TREAD[0]))
    treads = lines.where(F.col("length") <= TREAD[1]).withColumns({"x": F.cos(2 * F.col("theta")), "y": F.sin(2 * F.col("theta"))})
    reach = 2 * math.sin(math.radians(FAMILY))
    points = settled(treads.withColumn("cell", cell_of(F.col("x"), F.col("y"), reach * 0.7071)))
    near = lambda a, b: F.hypot(F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")) <= reach
    # lines of one heading are one point: the first of them can lead, and what leads it leads them all
    once = settled(points.groupBy(*keys, "x", "y").agg(F.min("seq").alias("seq"), F.first("cell").alias("cell")))
    first = settled(elect(once, keys, near, 2))
    home = follow(once, first, keys, near, 2, lambda a, b: [F.col(f"{a}seq")]).join(once.select(*keys, "seq", "x", "y"), [*keys, "seq"]).drop("seq")
    heading = lines.select(*keys, F.col("seq").alias("leader"), F.col("theta").alias("way"))
    placed = points.join(home, [*keys, "x", "y"]).join(heading, [*keys, "leader"])
    across = (F.col("ay") + F.col("by")) / 2 * F.cos("way") - (F.col("ax") + F.col("bx")) / 2 * F.sin("way")
    family = [*keys, "leader"]
    step = F.col("v") - F.lag("v").over(Window.partitionBy(*family).orderBy("v"))
    placed = placed.withColumn("v", across).withColumn("step", step)
    flights = placed.groupBy(*family).agg(F.first("way").alias("way"), F.count("*").alias("lines"), F.count(F.when(F.col("step") > 1e-6, 1)).alias("steps"), F.avg(F.when(F.col("step") > 1e-6, F.col("step"))).alias("going"), F.coalesce(F.try_divide(F.stddev_pop(F.when(F.col("step") > 1e-6, F.col("step"))), F.avg(F.when(F.col("step") > 1e-6, F.col("step")))), F.lit(0.0)).alias("cv"), (F.max("v") - F.min("v")).alias("run"))
    fits = settled(flights.where((F.col("lines") >= 3) & (F.col("steps") >= 2) & F.col("going").between(*GOING) & (F.col("cv") <= UNEVEN_GOING)).withColumn("n", F.col("steps") + 1))
    long = fits.where((F.col("run") >= LONG_RUN) & (F.col("n") >= MANY_TREADS))
    rails = lines.select(*keys, F.col("theta").alias("_t"), F.col("length").alias("_l")).join(long, keys).where((g.fold_gap(F.col("_t"), F.col("way")) >= math.radians(RAIL_DEGREES)) & (F.col("_l") >= RAIL_SHARE * F.col("run")))
    railed = rails.groupBy(*family).agg(F.count("*").alias("_rails")).where("_rails >= 2").drop("_rails")
    told = _upto(0.95, 0.55 + 0.25 * _upto(1, (F.col("n") - 3) / 6) + 0.15 * (1 - F.col("cv") / UNEVEN_GOING))
    kept = fits.join(railed, family, "left_anti").withColumn("confidence", told)
    best = kept.groupBy(*keys).agg(F.min(F.struct((-F.col("confidence")).alias("_c"), "leader", "n")).alias("_b"))
    return best.select(*keys, F.lit("stairs").alias("symbol"), F.lit("stairs").alias("kind"), (-F.col("_b._c")).alias("confidence"), F.col("_b.n").alias("n"))


# Floor tiles and how even they are.
TILE, UNEVEN_TILE, SAME_LINE, LEAST_LINES, TILE_DEGREES = (450.0, 750.0), 0.15, 50.0, 4, 3.0


def raised_floor(strokes: DataFrame, rooms: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., symbol, kind, confidence, n): a grid of lines at one pitch both ways, each at least half
    as long as the room's shorter side; n is the fewer lines of the two ways."""
    box = g.bbox(F.col("ring"))
    sides = rooms.select(*keys, F.least(box["x1"] - box["x0"], box["y1"] - box["y0"]).alias("side"))
    lines = _lines(strokes, keys, 0.0).join(sides, keys).where(F.col("length") >= 0.5 * F.col("side"))
    axis = F.when(g.fold_gap(F.col("theta"), F.lit(math.pi / 2)) <= math.radians(TILE_DEGREES), F.struct(F.lit("x").alias("axis"), ((F.col("ax") + F.col("bx")) / 2).alias("v"))).when(g.fold_gap(F.col("theta"), F.lit(0.0)) <= math.radians(TILE_DEGREES), F.struct(F.lit("y").alias("axis"), ((F.col("ay") + F.col("by")) / 2).alias("v")))
    placed = lines.withColumn("_a", axis).where("_a is not null").select(*keys, "_a.axis", "_a.v")
    along = Window.partitionBy(*keys, "axis").orderBy("v")
    fresh = F.when(F.col("v") - F.lag("v").over(along) <= SAME_LINE, 0).otherwise(1)
    rows = placed.withColumn("_f", fresh).withColumn("_row", F.sum("_f").over(along)).groupBy(*keys, "axis", "_row").agg(F.avg("v").alias("v"))
    step = F.col("v") - F.lag("v").over(along)
    ways = rows.withColumn("step", F.when(step > SAME_LINE, step)).groupBy(*keys, "axis").agg(F.count("*").alias("n"), F.avg("step").alias("pitch"), _spread("step").alias("cv"))
    good = ways.where((F.col("n") >= LEAST_LINES) & F.col("pitch").between(*TILE) & (F.col("cv") <= UNEVEN_TILE))
    both = good.groupBy(*keys).agg(F.count("*").alias("_ways"), F.min("n").alias("n"), F.avg("pitch").alias("tile")).where("_ways = 2")
    told = _upto(0.90, 0.70 + 0.10 * _upto(1, (F.col("n") - 4) / 6) + F.when(F.abs(F.col("tile") - 600) <= 40, 0.08).otherwise(0.0))
    return both.select(*keys, F.lit("raised_floor").alias("symbol"), F.lit("raised_floor").alias("kind"), told.alias("confidence"), "n")


def room_symbols(strokes: DataFrame, rooms: DataFrame, keys: list[str]) -> DataFrame:
    """All of these in one table."""
    return catalogued(strokes, rooms, keys).unionByName(stairs(strokes, keys)).unionByName(raised_floor(strokes, rooms, keys))

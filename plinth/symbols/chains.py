"""Chains of facets from jamb to jamb of openings, for any number of openings.

An opening has a few strokes, so its rows are brought together and searched by a kernel, in one shuffle;
crowded ones are bounded paths by joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.cuts import starts_of, whole_groups
from plinth.operators.rounds import settled
from plinth.operators.segments import weld

#: Ends so near are one corner; a chain starts within REACH widths of a jamb.
SNAP, REACH = 40.0, 0.28
#: Segments of an opening that is searched by the kernel.
FEW = 200


def facet_chains(segs: DataFrame, openings: DataFrame, keys: list[str], most: int, snap: float = SNAP) -> DataFrame:
    """(key..., place, node, x, y): the corners of the first chain of at most ``most`` facets from one jamb to the
    other, in order; openings without one don't appear.  ``segs(key..., seq, ax, ay, bx, by)`` are in the
    opening's frame (x along the wall, 0 in its middle), ``openings(key..., width)``; ``keys`` name an
    opening.

    Corners are numbered as they are met.  Of chains that visit no corner twice the first is the one
    a search takes that tries the least corner first, which is the least array of corners.
    """
    crowded = settled(segs.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*keys))
    if crowded.isEmpty():
        return _searched(segs, openings, keys, most, snap)
    rest = _searched(segs.hint("merge").join(crowded, keys, "left_anti"), openings, keys, most, snap)
    return rest.unionByName(_by_rounds(segs.hint("merge").join(crowded, keys, "left_semi"), openings, keys, most, snap))


def _searched(segs: DataFrame, openings: DataFrame, keys: list[str], most: int, snap: float) -> DataFrame:
    """An opening's row comes before its segments, with the width where they have ax."""
    n = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lambda c: F.col(c).cast("double").alias(c)
    drawn = segs.select(*keys, F.col("seq").cast("long").alias("seq"), d("ax"), d("ay"), d("bx"), d("by"))
    none = F.lit(None).cast("double")
    widths = openings.select(*keys, F.lit(None).cast("long").alias("seq"), F.col("width").cast("double").alias("ax"), none.alias("ay"), none.alias("bx"), none.alias("by"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    together = widths.unionByName(drawn).where(whole).repartition(n, *keys).sortWithinPartitions(*keys, F.asc_nulls_first("seq"))
    kinds = dict(segs.dtypes)
    return together.mapInArrow(_search(len(keys), most, snap), ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "place int, node long, x double, y double"]))


def _search(keys: int, most: int, snap: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            starts = starts_of(rows, keys).tolist()
            seq, *ends = (rows.column(keys + k).to_pylist() for k in range(5))
            own, place, corners = [], [], []
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                if seq[a] is None and ends[0][a] is not None:
                    found = chain_of(ends[0][a], list(zip(seq[a + 1 : b], *[e[a + 1 : b] for e in ends], strict=True)), most, snap)
                    own += [a] * len(found)
                    place += range(len(found))
                    corners += found
            if own:
                node, x, y = zip(*corners, strict=True)
                taken = pa.array(np.array(own))
                values = [*[c.take(taken) for c in rows.columns[:keys]], pa.array(place, pa.int32()), pa.array(node, pa.int64()), pa.array(x, pa.float64()), pa.array(y, pa.float64())]
                yield pa.RecordBatch.from_arrays(values, [*rows.schema.names[:keys], "place", "node", "x", "y"])

    return run


def chain_of(width: float, segs: list[tuple], most: int, snap: float) -> list[tuple[int, float, float]]:
    """The corners (node, x, y) of the first chain of ``segs(seq, ax, ay, bx, by)``, in order; none without one."""
    nodes: list[tuple[int, float, float]] = []
    at: dict[int, int] = {}
    for seq, ax, ay, bx, by in segs:
        for end, x, y in ((2 * seq, ax, ay), (2 * seq + 1, bx, by)):
            if x is None or y is None:
                continue
            best, near = snap, None
            for node, u, v in nodes:  # of those as near the first
                away = math.hypot(u - x, v - y)
                if away < best or (near is None and away <= best):
                    best, near = away, node
            if near is None:
                near = end
                nodes.append((end, x, y))
            at[end] = near
    if not nodes:
        return []
    reach = max(REACH * width, snap)
    jambs = [min((math.hypot(x - sign * width / 2, y), node) for node, x, y in nodes) for sign in (-1, 1)]
    (_, start), (_, goal) = jambs
    if start == goal or max(jambs)[0] > reach:
        return []
    ways: dict[int, set[int]] = {}
    for seq, *_ in segs:
        u, v = at.get(2 * seq), at.get(2 * seq + 1)
        if u is not None and v is not None and u != v:
            ways.setdefault(u, set()).add(v)
            ways.setdefault(v, set()).add(u)
    # how many facets lead from a corner to the goal at least
    left, edge = {goal: 0}, [goal]
    while edge and len(left) < len(ways):
        edge = [v for u in edge for v in ways.get(u, ()) if v not in left and left.setdefault(v, left[u] + 1)]
    todo = [[start]]
    while todo:
        path = todo.pop()
        if path[-1] == goal:
            if len(path) > 2:
                corner = {node: (node, x, y) for node, x, y in nodes}
                return [corner[node] for node in path]
            continue
        done = len(path)
        todo += [[*path, n] for n in sorted(ways.get(path[-1], ()), reverse=True) if n not in path and done + left.get(n, most) <= most]
    return []


def _by_rounds(segs: DataFrame, openings: DataFrame, keys: list[str], most: int, snap: float) -> DataFrame:
    """A round adds a facet to every path that can still come before the best chain known."""
    both = segs.select(*keys, (2 * F.col("seq").cast("long")).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(segs.select(*keys, (2 * F.col("seq").cast("long") + 1).alias("seq"), F.col("bx").alias("x"), F.col("by").alias("y")))
    both = settled(both)
    welded = settled(weld(both, keys, snap))
    nodes = settled(both.join(welded.where("seq = vertex").select(*keys, "seq"), [*keys, "seq"]).withColumnRenamed("seq", "node"))
    end = lambda k, name: welded.where(F.col("seq") % 2 == k).select(*keys, F.shiftright("seq", 1).alias("_n"), F.col("vertex").alias(name))
    steps = end(0, "u").join(end(1, "v"), [*keys, "_n"]).where("u <> v")
    ways = settled(steps.select(*keys, "u", "v").unionByName(steps.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())

    def nearest(sign: int, name: str) -> DataFrame:
        away = F.hypot(F.col("x") - sign * F.col("width") / 2, F.col("y"))
        best = nodes.join(openings, keys).groupBy(*keys, "width").agg(F.min(F.struct(away.alias("away"), "node")).alias("_b"))
        return best.where(F.col("_b.away") <= F.greatest(REACH * F.col("width"), F.lit(snap))).select(*keys, F.col("_b.node").alias(name))

    ends = settled(nearest(-1, "start").join(nearest(1, "goal"), keys).where("start <> goal"))
    open_paths = ends.select(*keys, "goal", F.array("start").alias("path"), F.col("start").alias("u"))
    found: DataFrame | None = None
    for facets in range(1, most + 1):
        longer = open_paths.join(ways, [*keys, "u"]).where(~F.array_contains("path", F.col("v"))).select(*keys, "goal", F.concat("path", F.array("v")).alias("path"), F.col("v").alias("u"))
        longer = settled(longer)
        if facets > 1:
            done = longer.where("u = goal").groupBy(*keys).agg(F.min("path").alias("path"))
            found = settled(done if found is None else found.unionByName(done).groupBy(*keys).agg(F.min("path").alias("path")))
        open_paths = longer.where("u <> goal")
        if found is not None:
            best = found.select(*keys, F.col("path").alias("_best"))
            open_paths = open_paths.join(best, keys, "left").where("_best is null or path < _best").drop("_best")
        if open_paths.isEmpty():
            break
    if found is None:
        found = open_paths.select(*keys, "path").limit(0)
    corners = found.select(*keys, F.posexplode("path").alias("place", "node"))
    return corners.join(nodes, [*keys, "node"]).select(*keys, "place", "node", "x", "y")

"""What grows with the input stays off the driver, and tasks stay small."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import joins, rounds, segments
from plinth.plans import wall_tables


@pytest.fixture(scope="module")
def points(spark):
    key = F.col("id")
    return spark.range(200).select(F.lit(1).alias("plan"), key, (key * 37 % 100).cast("double").alias("x"), (key * 91 % 100).cast("double").alias("y"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_rounds_are_never_broadcast(spark, points):
    one, two = rounds.settled(points), rounds.settled(points.select("plan", F.col("x").alias("u")))
    spread = two.groupBy("plan", "u").count().withColumn("u", F.explode(F.array("u", F.col("u") + 1)))
    assert "Broadcast" not in _plan(one.join(spread, "plan"))


def test_radius_join_sends_no_side_through_the_driver(points):
    left, right = points.select("plan", F.col("x").alias("px"), F.col("y").alias("py")), points.select("plan", F.col("x").alias("qx"), F.col("y").alias("qy"))
    assert "Broadcast" not in _plan(joins.radius_join(left, right, ["plan"], 5.0))


def test_cells_of_segments_are_never_broadcast(points):
    segs = points.select("plan", F.col("id").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 9).alias("bx"), F.col("y").alias("by"))
    assert "Broadcast" not in _plan(segments.crossings(segs, ["plan"], 10.0))
    walls = segs.withColumnRenamed("seg", "wall").withColumn("thickness", F.lit(100.0))
    free = wall_tables.free_ends(walls, ["plan"])
    assert "Broadcast" not in _plan(free) and "Broadcast" not in _plan(wall_tables.corners(free, ["plan"]))


def test_mode_cluster_counts_repeated_values_once_each(spark, tmp_path):
    """Support is the number of values about one of them, however many rows share that one."""
    import duckdb

    from plinth.plans import queries

    spark.createDataFrame([(1, 100.0)] * 3 + [(1, 110.0)] * 2 + [(1, 500.0), (2, 7.0)], "o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    found = {tuple(r) for r in queries.QUERIES["mode_cluster"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert found == {(1, 100000, 5), (2, 7000, 1)} == set(con.execute(queries.ORACLES["mode_cluster"]).fetchall())


def test_greedy_suppression_forms_no_pairs_in_a_crowd(spark, tmp_path, monkeypatch):
    from plinth.plans import table_queries

    def pairs(*_):
        raise AssertionError("pairs of a crowd")

    monkeypatch.setattr(rounds, "suppress", pairs)
    parts = [(i, "B", i * 7 % 50, round(900 + i * 137 % 400 * 0.5, 2)) for i in range(400)] + [(i, "B", 9, 1000.0) for i in range(400, 460)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    kept = []
    for i, _, size, price in sorted(parts, key=lambda r: (-r[3], r[0])):
        if not any(abs(s - size) <= 6 and p - price <= 40 for _, s, p in kept):
            kept.append((i, size, price))
    assert {r[0] for r in table_queries.greedy_suppression(spark, str(tmp_path)).collect()} == {k[0] for k in kept}


def test_strokes_meet_windows_and_rooms_in_cells_of_the_asked_size(points):
    """In cells of their own size points meet few windows; the size changes no result."""
    from plinth.functions import geometry as g
    from plinth.plans import room_tables

    at = lambda x, y: g.point(F.col("x") + x, F.col("y") + y)
    strokes = points.select("plan", F.col("id").alias("stroke"), F.array(at(0, 0), at(3, 2)).alias("points"))
    openings = points.where("id % 5 = 0").select("plan", F.col("id").alias("opening"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.lit(0.6).alias("ux"), F.lit(0.8).alias("uy"), F.lit(4.0).alias("width"))
    owners = points.where("id % 9 = 0").select("plan", F.col("id").alias("room"), F.array(at(-9.5, -9.5), at(9.5, -9.5), at(9.5, 9.5), at(-9.5, 9.5)).alias("ring"))
    told = lambda df: sorted(map(tuple, df.collect()))
    for operator, other in ((room_tables.opening_strokes, (openings, strokes)), (room_tables.stroke_rooms, (strokes, owners))):
        fine = operator(*other, ["plan"], 5.0)
        assert told(fine) == told(operator(*other, ["plan"])) and "Broadcast" not in _plan(fine)


def test_decoded_pages_are_given_back_in_small_frames():
    import pandas as pd

    from plinth.sources import reader

    files = pd.DataFrame({"path": [str(i) for i in range(200)], "content": [b"no drawing"] * 200})
    sizes = [len(f) for f in reader._decode(0)(iter([files]))]
    assert sum(sizes) == 200 and max(sizes) <= 64


def test_heavy_rows_of_a_small_file_are_dealt_out(spark, tmp_path):
    from plinth.plans import queries

    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("polygon_measures", "decode_texts", "decode_pages", "decode_primitives"):
        assert "REPARTITION_BY_NUM" in _plan(queries.QUERIES[name](spark, str(tmp_path))), name


def test_band_join_of_two_growing_sides_is_shuffled(spark, tmp_path):
    from plinth.plans import queries

    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.col("id").cast("double").alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    assert "Broadcast" not in _plan(queries.QUERIES["band_join"](spark, str(tmp_path)))


def _largest_method(spark, df):
    """Bytes of the longest method that Spark makes for ``df``; the JVM compiles none over 8,000."""
    import re

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else code is made stage by stage
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", made))


def test_pairs_of_segments_run_in_methods_that_the_jvm_compiles(spark, points):
    segs = points.select("plan", F.col("id").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 9).alias("bx"), (F.col("y") + 4).alias("by"))
    ends = segs.select("plan", F.col("bx").alias("px"), F.col("by").alias("py"))
    pairs = {"crossings": segments.crossings(segs, ["plan"], 10.0), "touches": segments.touches(segs, ends, ["plan"], 1.0, 10.0)}
    sizes = {name: _largest_method(spark, df.select("seg" if name == "touches" else "one")) for name, df in pairs.items()}
    assert max(sizes.values()) < 8000, sizes


def test_splitting_sends_on_runs_of_cuts_and_no_crossings(spark):
    """In a crowd a segment has many crossings and few pieces; crossings are neither shuffled nor written."""
    k = F.col("id")
    at = lambda a, n: (k * a % n).cast("double")
    segs = spark.range(400).select((k % 2).alias("plan"), k.alias("seg"), at(37, 100).alias("ax"), at(91, 100).alias("ay"), (at(37, 100) + k * 53 % 301 - 150).alias("bx"), (at(91, 100) + k * 71 % 301 - 150).alias("by"))
    found = segments.split(segs, ["plan"], 3.0, 100.0)
    assert "Join" not in _plan(found).split("Window")[-1] and found.count() > 400


def test_runs_of_cuts_are_those_of_all_pairs():
    """Cell by cell, in batches and blocks of any size, crowded or not: the loop over pairs gives the same runs."""
    import numpy as np
    import pyarrow as pa

    from plinth.operators import cuts

    rng = np.random.default_rng(4)
    n, size, tol = 300, 50.0, 2.0
    cell = np.sort(rng.choice([0, 0, 0, 1, 2], n))  # one of 180 or so and two of 60
    a, run = rng.integers(0, 60, (n, 2)).astype(float), rng.integers(-40, 41, (n, 2)).astype(float)
    run[(run == 0).all(axis=1)] = 1.0
    b, long = a + run, np.hypot(*run.T)
    expected = set()
    for i in range(n):
        own = []
        for j in np.flatnonzero(cell == cell[i]):
            p, q = (i, j) if i < j else (j, i)
            det = run[p][0] * run[q][1] - run[p][1] * run[q][0]
            if det:
                gap = a[q] - a[p]
                s, t = (gap[0] * run[q][1] - gap[1] * run[q][0]) / det, (gap[0] * run[p][1] - gap[1] * run[p][0]) / det
                x = a[p] + s * run[p]
                if -1e-7 <= min(s, t) and max(s, t) <= 1 + 1e-7 and (np.floor(x / size) == (cell[i], 0)).all():
                    own.append((x - a[i]) @ run[i] / (run[i] @ run[i]))
        ends = [p for j in np.flatnonzero(cell == cell[i]) for p in (a[j], b[j]) if (np.floor(p / size) == (cell[i], 0)).all()]
        feet = [(t, p) for p in ends if 0 < (t := (p - a[i]) @ run[i] / (run[i] @ run[i])) < 1]
        for found in (own, [t for t, p in feet if np.hypot(*(a[i] + run[i] * t - p)) <= tol]):
            t = np.sort([t for t in found if tol / long[i] < t < 1 - tol / long[i]])
            if len(t):
                new = np.flatnonzero(np.diff(t) * long[i] > cuts.SHARE * tol)
                expected |= {(i, round(lo, 9), round(hi, 9)) for lo, hi in zip(t[[0, *new + 1]], t[[*new, -1]], strict=True)}
    columns = dict(zip(cuts.COLUMNS, (cell, np.zeros(n, np.int64), np.arange(n), *a.T, *b.T, long), strict=True))
    rows = pa.RecordBatch.from_pydict({"plan": ["a"] * n, **{k: np.ascontiguousarray(v) for k, v in columns.items()}})
    for batch, held in ((n, 1 << 15), (7, 100), (150, 1)):
        made = cuts.cut_runs(1, tol, size, held)(iter([rows.slice(k, batch) for k in range(0, n, batch)]))
        assert {(r["seg"], round(r["lo"], 9), round(r["hi"], 9)) for out in made for r in out.to_pylist()} == expected


def test_of_rooms_one_over_the_other_few_are_tried(monkeypatch):
    """A stroke that a room holds whole meets no later ones; the owner is that of all pairs, in batches of any size."""
    import numpy as np
    import pyarrow as pa

    from plinth.functions.planar import point_in_polygon
    from plinth.plans import owners

    rng, size = np.random.default_rng(8), 50.0
    rings = [[complex(x, y), complex(x + w, y), complex(x + w, y + 45), *([complex(x + w / 2, y + 20)] if k % 3 == 0 else []), complex(x, y + 45)] for k, (x, y, w) in enumerate(zip(*rng.integers(-30, 40, (2, 150)) + 0.25, rng.integers(10, 50, 150), strict=True))]
    strokes = [[complex(*p) for p in rng.integers(-25, 90, (m, 2))] for m in rng.integers(1, 6, 80)]
    expected = set()
    for i, points in enumerate(strokes):
        counts = [sum(point_in_polygon(p, ring) for p in points) for ring in rings]
        if (most := max(counts)) >= max(1, len(points) // 2):
            expected.add((i, counts.index(most), most))
    rows = []
    for kind, shapes in enumerate((rings, strokes)):
        for k, shape in enumerate(shapes):
            lo, hi = (f(p.real for p in shape) // size for f in (min, max)), (f(p.imag for p in shape) // size for f in (min, max))
            (x0, x1), (y0, y1) = lo, hi
            near = {(p.real // size, p.imag // size) for p in shape} if kind else {(i, j) for i in np.arange(x0, x1 + 1) for j in np.arange(y0, y1 + 1)}
            rows += [{"plan": "a", "cx": int(i), "cy": int(j), "kind": kind, "room": None if kind else k, "stroke": k if kind else None, "xs": [p.real for p in shape], "ys": [p.imag for p in shape]} for i, j in near]
    rows.sort(key=lambda r: (r["cx"], r["cy"], r["kind"], r["room"] or 0))
    table = pa.RecordBatch.from_pylist(rows)
    tried = []
    monkeypatch.setattr(owners, "_in_ring", lambda *given, test=owners._in_ring: tried.append(len(given[0])) or test(*given))
    for batch, held in ((len(rows), 1 << 16), (7, 1), (100, 500)):
        tried.clear()
        made = owners.owners(1, held)(iter([table.slice(k, batch) for k in range(0, len(rows), batch)]))
        told = {}
        for r in (r for out in made for r in out.to_pylist()):
            told[r["stroke"]] = min(told.get(r["stroke"], (0, 0)), (-r["inside"], r["room"]))
        assert {(i, room, -less) for i, (less, room) in told.items()} == expected and len(expected) > 40
    # one stroke in a thousand rooms
    crowd = [{**rows[0], "cx": 0, "cy": 0, "kind": 0, "room": k, "stroke": None, "xs": [0.0, 9.0, 9.0, 0.0], "ys": [0.0, 0.0, 9.0, 9.0]} for k in range(1000)]
    crowd.append({**crowd[0], "kind": 1, "room": None, "stroke": 5, "xs": [3.0, 4.0], "ys": [3.0, 4.0]})
    tried.clear()
    (out,) = owners.owners(1)(iter([pa.RecordBatch.from_pylist(crowd)]))
    assert out.to_pylist() == [{"plan": "a", "stroke": 5, "room": 0, "inside": 2}] and sum(tried) <= 2 * owners.ROOMS


def test_rooms_with_one_ring_and_null_corners_or_points(spark):
    from plinth.plans import room_tables

    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 9D, 'y', 9D), named_struct('x', 0D, 'y', 9D))"
    rooms = spark.sql(f"select 'a' as plan, id as room, case when id = 1 then null when id = 2 then slice({ring}, 1, 0) else {ring} end as ring from range(1, 9)")
    strokes = spark.sql("select 'a' as plan, id as stroke, case id when 0 then array(named_struct('x', 1D, 'y', 1D)) when 1 then array(named_struct('x', 1D, 'y', 1D), named_struct('x', double(null), 'y', 1D)) when 2 then null else array(named_struct('x', 99D, 'y', 1D)) end as points from range(4)")
    assert sorted(map(tuple, room_tables.stroke_rooms(strokes, rooms, ["plan"], 5.0).collect())) == [("a", 0, 3, 1), ("a", 1, 3, 1)]

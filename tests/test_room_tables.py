"""Scale, rooms, openings and strokes as tables against the kernels' loops, on turned plans too."""

import cmath
import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.functions.planar import bbox, fit_circle, point_in_polygon
from plinth.operators import rounds, segments
from plinth.plans import arrangement, room_tables, rooms, scale, scale_tables, walls

K = ["plan"]
POINTS = "array<struct<x:double,y:double>>"


def _xy(points):
    return [(p.real, p.imag) for p in points]


def _plan(seed):
    """A turned grid of rooms with some partitions left out, and openings on walls, by corners and double."""
    rng, turn = random.Random(seed), cmath.rect(1, random.Random(seed).choice([0, 0.4, 1.1]))
    xs, ys = ([0] + [sum(steps[: i + 1]) for i in range(len(steps))] for steps in ([rng.choice([2500, 3300, 4100]) for _ in range(n)] for n in (3, 2)))
    segs = [(complex(x, 0), complex(x, ys[-1])) for x in (xs[0], xs[-1])] + [(complex(0, y), complex(xs[-1], y)) for y in (ys[0], ys[-1])]
    segs += [(complex(x, ys[j]), complex(x, ys[j + 1])) for x in xs[1:-1] for j in range(len(ys) - 1) if rng.random() < 0.85]
    segs += [(complex(xs[i], y), complex(xs[i + 1], y)) for y in ys[1:-1] for i in range(len(xs) - 1) if rng.random() < 0.85]
    made = [walls.Wall(a * turn, b * turn, 200.0) for a, b in segs]
    openings = []
    for i, w in enumerate(made):
        for _ in range(rng.choice([0, 1, 2, 2])):
            at = rng.choice([rng.uniform(0, w.length), rng.choice([0.0, w.length / 2, w.length])])
            openings.append(walls.Opening(at - 450, at + 450, kind=rng.choice(["door", "window"]), wall=i))
    return made, openings


def test_room_edges_are_the_kernels(spark):
    plans = {p: _plan(p) for p in range(6)}
    segs = [(p, i, w.a.real, w.a.imag, w.b.real, w.b.imag) for p, (made, _) in plans.items() for i, w in enumerate(made)]
    holes = [(p, n, o.wall, made[o.wall].at(o.middle).real, made[o.wall].at(o.middle).imag, o.kind) for p, (made, openings) in plans.items() for n, o in enumerate(openings, 1)]
    df = spark.createDataFrame(segs, "plan int, seg long, ax double, ay double, bx double, by double")
    openings = spark.createDataFrame(holes, "plan int, via int, seg long, px double, py double, kind string")
    faced = rounds.settled(segments.faces_of(segments.darts_of(*segments.arrangement(df, K), K), K))
    kept = rounds.settled(room_tables.rooms_of(faced, K))
    found = sorted((r["plan"], r["a"], r["b"], r["kind"], r["via"] or 0, r["shared_m"]) for r in room_tables.named(room_tables.room_edges(faced, kept, openings, K)).collect())
    expected, gross = [], []
    for p, (made, openings) in plans.items():
        plan = arrangement.arrange([w.seg for w in made])
        built = rooms.build_rooms(plan, made, [])
        gross += [(p, i, r.gross) for i, r in enumerate(built, 1)]
        expected += [(p, e.a, e.b, e.kind, int(e.via[1:]) if e.via else 0, e.shared_m) for e in rooms.room_graph(plan, built, made, openings)]
    assert [r[:5] for r in found] == [r[:5] for r in sorted(expected)] and len(found) > 30
    assert [r[5] for r in found] == pytest.approx([r[5] for r in sorted(expected)], abs=2e-3)
    assert sorted((r["plan"], r["room"], round(r["gross"], 3)) for r in kept.collect()) == gross
    doubled = [r for r in found if r[3] == "door"]
    assert len(doubled) > len({r[:3] for r in doubled})  # two doors in one wall are two edges


def _strokes(rng, n):
    return [[complex(rng.uniform(0, 6000), rng.uniform(0, 6000))] + [complex(rng.uniform(0, 6000), rng.uniform(0, 6000)) for _ in range(rng.choice([0, 1, 3]))] if rng.random() < 0.3 else [(z := complex(rng.uniform(0, 6000), rng.uniform(0, 6000))) + complex(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(rng.choice([2, 3, 5]))] for _ in range(n)]


def test_strokes_in_turned_windows_are_the_loops(spark):
    rng, expected = random.Random(21), set()
    strokes = {(p, i): s for p in range(2) for i, s in enumerate(_strokes(rng, 90))}
    openings = [(p, n, rng.uniform(0, 6000), rng.uniform(0, 6000), math.cos(a := rng.choice([0.0, math.pi / 2, rng.uniform(0, 7)])), math.sin(a), rng.choice([700.0, 900.0, 1800.0])) for p in range(2) for n in range(12)]
    for p, n, ox, oy, ux, uy, w in openings:
        for (q, i), s in strokes.items():
            x0, y0, x1, y1 = bbox(s)
            local = [(z - complex(ox, oy)) * complex(ux, -uy) for z in s]
            near = x1 >= ox - 1.5 * w and x0 <= ox + 1.5 * w and y1 >= oy - 1.5 * w and y0 <= oy + 1.5 * w
            if p == q and near and any(abs(z.real) <= 1.4 * w and abs(z.imag) <= 1.5 * w for z in local):
                expected.add((p, n, i))
    drawn = spark.createDataFrame([(p, i, _xy(s)) for (p, i), s in strokes.items()], f"plan int, stroke int, points {POINTS}")
    made = spark.createDataFrame(openings, "plan int, opening int, ox double, oy double, ux double, uy double, width double")
    found = {tuple(r) for r in room_tables.opening_strokes(made, drawn, K).select("plan", "opening", "stroke").collect()}
    assert found == expected and len(expected) > 50


def test_owners_of_strokes_are_the_loops(spark):
    rng, expected = random.Random(22), set()
    strokes = {(p, i): s for p in range(2) for i, s in enumerate(_strokes(rng, 120))}
    rings = {(p, r): [c + 1500 * cmath.rect(rng.uniform(0.5, 1), 2 * math.pi * k / 7) for k in range(7)] for p in range(2) for r in range(9) for c in [complex(rng.uniform(0, 6000), rng.uniform(0, 6000))]}
    for (p, i), s in strokes.items():
        best, most = None, 0
        for (q, r), ring in rings.items():
            inside = sum(point_in_polygon(z, ring) for z in s)
            if p == q and inside > most:
                best, most = r, inside
        if best is not None and most >= max(1, len(s) // 2):
            expected.add((p, i, best, most))
    drawn = spark.createDataFrame([(p, i, _xy(s)) for (p, i), s in strokes.items()], f"plan int, stroke int, points {POINTS}")
    made = spark.createDataFrame([(p, r, _xy(ring)) for (p, r), ring in rings.items()], f"plan int, room int, ring {POINTS}")
    found = {tuple(r) for r in room_tables.stroke_rooms(drawn, made, K).select("plan", "stroke", "room", "inside").collect()}
    assert found == expected and len({r for _, _, r, _ in expected}) > 5


def _sheet(seed):
    """Dimensions beside turned lines, others across and farther, a title, arcs of doors."""
    rng = random.Random(seed)
    prims, texts = [], []
    mm = rng.choice([17.64, 35.28, 50.0])
    for _ in range(rng.choice([0, 2, 6])):
        a, way = complex(rng.uniform(50, 500), rng.uniform(50, 700)), cmath.rect(1, rng.choice([0, math.pi / 2, 0.5, rng.uniform(-3, 3)]))
        size, off = rng.uniform(20, 150), rng.uniform(1, 9)
        prims.append([a, a + way * size])
        prims.append([a + way * 1j * 2 * off, a + way * (size * 0.7 + 2j * off)])
        at = a + way * (size * rng.uniform(0.1, 0.9) + 1j * off)
        texts.append((str(max(100, round(size * mm * rng.choice([1, 1, 1, 1.5])))) + rng.choice(["", " mm", "*"]), at, 2.5, cmath.phase(way) + rng.choice([0, math.pi, 0.05, 0.3])))
    for _ in range(rng.choice([0, 1, 3])):
        c, r, span = complex(rng.uniform(0, 600), rng.uniform(0, 800)), rng.choice([18.0, 25.5, 25.6, 90.0]), rng.choice([0.4, 1.57])
        prims.append([c + cmath.rect(r, span * k / 8) for k in range(9)])
    prims.append([complex(10 * k, 10 * k) for k in range(6)])
    if rng.random() < 0.5:
        texts.append((rng.choice(["Scale 1:100", "1 / 50", "1:4", "11:100"]), complex(500, 20), 8.0, 0.0))
    return [{"points": p, "closed": rng.random() < 0.1} for p in prims], [{"text": t, "x": p.real, "y": p.imag, "height": h, "angle": a} for t, p, h, a in texts], rng.choice([None, None, None, "1:50", "17.64mm", "50", "4", "one to fifty", "1 / 20"])


def test_scales_are_the_kernels(spark):
    sheets = {str(p): _sheet(100 + p) for p in range(40)}
    plans = spark.createDataFrame([(p, e) for p, (_, _, e) in sheets.items()], "plan_id string, explicit string")
    prims = spark.createDataFrame([(p, i, _xy(x["points"]), x["closed"]) for p, (ps, _, _) in sheets.items() for i, x in enumerate(ps)], f"plan_id string, prim_id int, points {POINTS}, closed boolean")
    texts = spark.createDataFrame([(p, i, t["text"], t["x"], t["y"], t["height"], t["angle"]) for p, (_, ts, _) in sheets.items() for i, t in enumerate(ts)], "plan_id string, text_id int, text string, x double, y double, height double, angle double")
    found = {r["plan_id"]: r for r in scale_tables.find_scale(plans, prims, texts).collect()}
    sources = set()
    for p, (ps, ts, explicit) in sheets.items():
        rings = [[*x["points"], x["points"][0]] if x["closed"] and len(x["points"]) > 2 else x["points"] for x in ps]
        segs = [(a, b) for r in rings for a, b in zip(r, r[1:], strict=False) if abs(b - a) > 1e-6]
        want = scale.find_scale(ps, segs, ts, explicit)
        got = found[p]
        assert (got["source"], got["support"]) == (want.source, want.support), p
        assert (got["mm_per_pt"], got["confidence"]) == pytest.approx((want.mm_per_pt, want.confidence)), p
        sources.add(want.source)
    assert sources == {"explicit", "dimension", "titleblock", "door", "default"}


def test_circles_through_points_are_the_loops(spark):
    from plinth.functions import geometry as g

    rng = random.Random(23)
    sets = [[complex(5e5, 3e5) + cmath.rect(rng.uniform(99, 101), rng.uniform(0, 2)) for _ in range(rng.choice([3, 5, 20]))] for _ in range(20)] + [[0j, 1 + 1j, 2 + 2j], [0j, 1j]]
    df = spark.createDataFrame([(i, _xy(s)) for i, s in enumerate(sets)], f"i int, p {POINTS}")
    for r in df.select("i", g.circle_of(F.col("p")).alias("c")).collect():
        want = fit_circle(sets[r["i"]])
        assert (r["c"] is None) == (not want)
        if want:
            assert (r["c"]["cx"], r["c"]["cy"], r["c"]["r"], r["c"]["rms"]) == pytest.approx((want[0].real, want[0].imag, want[1], want[2]), rel=1e-6, abs=1e-5)

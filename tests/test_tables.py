"""Operators on tables against plain loops, and plans as tables against the kernels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import rounds, segments
from plinth.plans import arrangement, wall_tables, walls

K = ["plan"]


def _rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_suppress_is_the_greedy_loop_also_in_chains(spark):
    rng = random.Random(1)
    pairs = {(0, a, a + 1) for a in range(40)} | {(1, *sorted(rng.sample(range(60), 2))) for _ in range(150)}
    rows = [(p, n) for p, top in ((0, 41), (1, 60), (2, 3)) for n in range(top)]
    kept = []
    for p, n in rows:
        if not any((p, k, n) in pairs for q, k in kept if q == p):
            kept.append((p, n))
    found = rounds.suppress(spark.createDataFrame(rows, "plan int, n int"), spark.createDataFrame(sorted(pairs), "plan int, strong int, weak int"), K, "n")
    assert _rows(found, "plan", "n") == sorted(kept)


def test_match_is_the_sorted_loop(spark):
    rng = random.Random(2)
    pairs = [(p, a, b, rng.randint(1, 30), i) for p in range(3) for i, (a, b) in enumerate(rng.sample(range(25), 2) for _ in range(60))]
    used, taken = set(), []
    for p, a, b, total, i in sorted(pairs, key=lambda r: (r[3], r[4])):
        if (p, a) not in used and (p, b) not in used:
            used |= {(p, a), (p, b)}
            taken.append((p, i))
    df = spark.createDataFrame(pairs, "plan int, one int, two int, total int, i int")
    assert _rows(rounds.match(df, K, ["total", "i"]), "plan", "i") == sorted(taken)
    assert rounds.match(df.limit(0), K, ["total", "i"]).isEmpty()


def test_peeling_leaves_rings_and_what_joins_them(spark):
    rng = random.Random(3)
    edges = {(0, n, n + 1) for n in range(30)} | {(1, n, (n + 1) % 6) for n in range(6)} | {(1, n, n + 6) for n in range(6)} | {(1, 20, 21)}
    edges |= {(2, *sorted(rng.sample(range(40), 2))) for _ in range(45)}
    edges = {(p, min(u, v), max(u, v)) for p, u, v in edges}
    alive = set(edges)
    while True:
        degree = {}
        for p, u, v in alive:
            degree[p, u], degree[p, v] = degree.get((p, u), 0) + 1, degree.get((p, v), 0) + 1
        loose = {e for e in alive if degree[e[0], e[1]] == 1 or degree[e[0], e[2]] == 1}
        if not loose:
            break
        alive -= loose
    df = spark.createDataFrame(sorted(edges), "plan int, u long, v long")
    assert _rows(rounds.peel(df, K), "plan", "u", "v") == sorted(alive)


def test_cycles_name_the_least_and_count_from_it(spark):
    rng = random.Random(4)
    nodes = list(range(70))
    rng.shuffle(nodes)
    steps, expected = [], []
    for lo, hi in ((0, 1), (1, 3), (3, 40), (40, 70)):
        ring = nodes[lo:hi]
        steps += [(0, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        at = ring.index(min(ring))
        expected += [(n, min(ring), i) for i, n in enumerate(ring[at:] + ring[:at])]
    assert _rows(rounds.cycles(spark.createDataFrame(steps, "plan int, node long, next long"), K), "node", "cycle", "place") == sorted(expected)


def test_welding_is_first_come_first_kept(spark):
    rng = random.Random(5)
    points = [(p, i, rng.choice([rng.uniform(0, 300), rng.uniform(0, 40)]), rng.uniform(0, 300)) for p in range(3) for i in range(150)]
    points += [(0, 200 + i, *points[i][2:]) for i in range(20)]
    expected = []
    for p in range(3):
        weld, first = arrangement.Weld(30.0), {}
        for _, i, x, y in sorted(r for r in points if r[0] == p):
            leader = weld(complex(x, y))
            expected.append((p, i, first.setdefault(leader, i)))
    df = spark.createDataFrame(points, "plan int, seq long, x double, y double")
    assert _rows(segments.weld(df, K, 30.0), "plan", "seq", "vertex") == sorted(expected)


def _random_segments(seed, n, plans=2):
    """Grid lines, turned ones, T-junctions and loose ends; the same in both forms."""
    rng = random.Random(seed)
    rows = []
    for p in range(plans):
        for i in range(n):
            a = complex(rng.randrange(0, 9000, 500), rng.randrange(0, 9000, 500))
            way = rng.choice([1, 1j, 1, 1j, complex(math.cos(0.3), math.sin(0.3)), complex(rng.uniform(-1, 1), rng.uniform(-1, 1))])
            b = a + way * rng.choice([500, 1500, 4000, rng.uniform(100, 6000)])
            rows.append((p, i, a.real, a.imag, b.real, b.imag))
    return rows


def test_splitting_is_the_loop(spark):
    rows = _random_segments(6, 60)
    expected = []
    for p in (0, 1):
        segs = [(complex(*r[2:4]), complex(*r[4:6])) for r in rows if r[0] == p]
        expected += [(p, i, *(round(v, 3) for v in (a.real, a.imag, b.real, b.imag))) for (a, b), i in arrangement.split(segs)]
    df = spark.createDataFrame(rows, "plan int, seg long, ax double, ay double, bx double, by double")
    for size in (700.0, 20000.0):
        found = [(p, i, *(round(v, 3) for v in rest)) for p, i, *rest in _rows(segments.split(df, K, size=size), "plan", "seg", "ax", "ay", "bx", "by")]
        assert sorted(found) == sorted(expected)


def test_cells_hold_every_point_of_a_segment(spark):
    rng = random.Random(7)
    rows = [(i, *(rng.choice([rng.uniform(-900, 900), 100.0 * rng.randrange(-9, 9)]) for _ in range(4))) for i in range(300)] + [(300, 5.0, -800.0, 5.0, 800.0), (301, -3.0, 7.0, -3.0, 7.0)]
    df = spark.createDataFrame(rows, "seg long, ax double, ay double, bx double, by double")
    cells = df.select("seg", segments.run_cells(*[F.col(c) for c in ("ax", "ay", "bx", "by")], 100.0, 5.0).alias("c")).collect()
    held = {r["seg"]: {(c["cx"], c["cy"]) for c in r["c"]} for r in cells}
    for i, ax, ay, bx, by in rows:
        for t in range(101):
            x, y = ax + (bx - ax) * t / 100, ay + (by - ay) * t / 100
            for turn in range(8):
                u, v = x + 4.9 * math.cos(turn), y + 4.9 * math.sin(turn)
                assert (math.floor(u / 100), math.floor(v / 100)) in held[i]
    longest = max(rows, key=lambda r: math.hypot(r[3] - r[1], r[4] - r[2]))
    assert len(held[longest[0]]) < 80


@pytest.mark.parametrize("seed", [8, 9])
def test_arrangement_and_faces_are_the_kernels(spark, seed):
    rows = _random_segments(seed, 50)
    df = spark.createDataFrame(rows, "plan int, seg long, ax double, ay double, bx double, by double")
    vertices, edges = segments.arrangement(df, K)
    faced = rounds.settled(segments.faces_of(segments.darts_of(vertices, edges, K), K))
    areas = sorted((r["plan"], r["darts"], round(r["area"], 1)) for r in segments.face_areas(faced, K).collect())
    rings = sorted((r["plan"], [(round(p["x"], 2), round(p["y"], 2)) for p in r["ring"]]) for r in segments.rings(faced, K).collect())
    expected, corners = [], []
    for p in (0, 1):
        plan = arrangement.arrange([(complex(*r[2:4]), complex(*r[4:6])) for r in rows if r[0] == p])
        expected += [(p, len(f.darts), round(f.area, 1)) for f in plan.faces]
        corners += [(p, [(round(q.real, 2), round(q.imag, 2)) for q in f.ring]) for f in plan.faces if f.area > 0]
    assert [(p, n) for p, n, _ in areas] == [(p, n) for p, n, _ in sorted(expected)]
    assert [a for *_, a in areas] == pytest.approx([a for *_, a in sorted(expected)], abs=1.0)
    assert rings == sorted(corners)


def _wall_segments(seed):
    """Faces of walls of several thicknesses: nested, doubled, broken, of unequal length, free corners."""
    rng = random.Random(seed)
    segs = []
    for _ in range(14):
        a, way = complex(rng.randrange(0, 12000, 300), rng.randrange(0, 12000, 300)), rng.choice([1, 1j, 1, 1j, complex(math.cos(0.5), math.sin(0.5))])
        size, thick = rng.choice([1200, 3000, 5000]), rng.choice([70, 110, 200, 220, 300])
        for side in (0, thick):
            lo, hi = rng.choice([0, 0, 150, 400]), size - rng.choice([0, 0, 200, 1000])
            marks = [lo, hi] if rng.random() < 0.6 else [lo, lo + (hi - lo) * 0.3, lo + (hi - lo) * 0.3 + 900, hi]
            for s, t in zip(marks[::2], marks[1::2], strict=True):
                if t > s:
                    segs.append((a + way * (s + 1j * side), a + way * (t + 1j * side)))
        if rng.random() < 0.3:
            segs.append((a + way * (100 + 1j * thick * 0.3), a + way * (size - 100 + 1j * thick * 0.3)))
    return [(s, rng.choice([None, "b", "a"])) for s in segs]


def _kernel(segs):
    return walls.bridge_corners(walls.dedupe_walls(walls.suppress_nested(walls.pair_lines(walls.cluster_lines(segs)))))


@pytest.mark.parametrize("seed", [10, 11])
def test_walls_as_tables_are_the_kernels(spark, seed):
    plans = {p: _wall_segments(seed * 10 + p) for p in range(3)}
    rows = [(p, i, a.real, a.imag, b.real, b.imag, layer) for p, segs in plans.items() for i, ((a, b), layer) in enumerate(segs)]
    df = spark.createDataFrame(rows, "plan int, seg long, ax double, ay double, bx double, by double, layer string")
    found, openings = wall_tables.find_walls(df, K)
    near = lambda *v: tuple(round(x, 2) for x in v)
    tabled = sorted((r["plan"], *near(r["ax"], r["ay"], r["bx"], r["by"], r["thickness"]), r["layer"] or "", r["source"]) for r in found.collect())
    expected, gaps = [], []
    for p, segs in plans.items():
        for w in _kernel(segs):
            expected.append((p, *near(w.a.real, w.a.imag, w.b.real, w.b.imag, w.thickness), w.layer or "", w.source))
            gaps += [(p, *near(w.a.real, w.a.imag, o.start, o.end), o.bridged) for o in w.openings]
    assert tabled == sorted(expected)
    assert any(w[-1] == "corner-bridged" for w in tabled) and len(tabled) > 12
    named = openings.join(found.select("plan", "wall", "ax", "ay"), ["plan", "wall"])
    assert sorted((r["plan"], *near(r["ax"], r["ay"], r["t0"], r["t1"]), r["bridged"]) for r in named.collect()) == sorted(gaps)


def test_a_wall_runs_over_all_that_either_face_covers(spark):
    rows = [(0, 0, 0.0, 0.0, 5000.0, 0.0, "z"), (0, 1, 200.0, 100.0, 4000.0, 100.0, "a")]
    df = spark.createDataFrame(rows, "plan int, seg long, ax double, ay double, bx double, by double, layer string")
    found, openings = wall_tables.wall_pairs(df, K)
    wall = found.collect()[0]
    assert (wall["ax"], wall["bx"], wall["thickness"], wall["layer"]) == (0.0, 5000.0, 100.0, "a")
    assert _rows(openings, "t0", "t1") == [(4000.0, 5000.0)]


def test_a_wall_that_crosses_out_of_a_thicker_one_stays():
    thick = walls.Wall(0j, 4000 + 0j, 200.0)
    turn = math.radians(2.9)
    out = walls.Wall(complex(0, -60), complex(0, -60) + 4000 * complex(math.cos(turn), math.sin(turn)), 70.0)
    inside = walls.Wall(complex(100, 20), complex(3900, 20), 70.0)
    assert walls.suppress_nested([thick, out, inside]) == [thick, out]

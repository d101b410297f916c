"""Detectors on tables against the detectors on one room."""

import cmath
import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.symbols import detectors
from plinth.symbols.tables import symbols_of

POINTS = "array<struct<x:double,y:double>>"
NAMES = ("sanitary", "parking_bay", "theatre_seating", "ward_bay", "stairs", "raised_floor")


def _box(at, w, h, turn=1, closed=True):
    ring = [at + turn * z for z in (0, w, complex(w, h), complex(0, h))]
    return [*ring, ring[0]] if closed else ring


def _room(seed):
    rng = random.Random(seed)
    strokes, kind = [], rng.randrange(7)
    at = lambda: complex(rng.uniform(0, 9000), rng.uniform(0, 9000))
    turn = rng.choice([1, 1, 1j, cmath.rect(1, 0.3)])
    if kind in (0, 6):
        strokes += [_box(at(), *rng.choice([(1700, 750), (900, 900), (700, 380), (600, 350), (500, 400), (100, 100)]), turn, rng.random() < 0.9) for _ in range(rng.randint(1, 4))]
    if kind in (1, 6):
        strokes += [_box(complex(i * 2700, 0), 2500 + rng.choice([0, 0, 300]), rng.choice([5000, 5000, 6400]), turn) for i in range(rng.randint(1, 4))]
    if kind == 2:
        nx, ny, px, py = rng.randint(2, 9), rng.randint(1, 5), rng.choice([550, 600, 700]), rng.choice([800, 900, 1500])
        strokes += [_box(complex(i * px + rng.uniform(0, 20), j * py), 500, rng.choice([450, 500])) for i in range(nx) for j in range(ny)]
    if kind in (3, 6):
        x = 0.0
        for _ in range(rng.randint(2, 6)):
            strokes.append(_box(complex(x, rng.choice([0, 0, 30])), 2000, 900, rng.choice([1, 1, 1j])))
            x += rng.choice([2400, 2400, 2400, 3900])
    if kind in (4, 6):
        going, n = rng.choice([150, 250, 300, 390]), rng.randint(2, 20)
        lean = cmath.rect(1, rng.choice([0, 0.7, math.pi / 2, 3.1]))
        strokes += [[lean * complex(0, i * going), lean * complex(1100, i * going + rng.uniform(0, 30))] for i in range(n)]
        if rng.random() < 0.5:
            strokes += [[lean * complex(x, 0), lean * complex(x, n * going)] for x in (0, 1100)]
    if kind == 5:
        t = rng.choice([500, 600, 620, 900])
        strokes += [[complex(i * t, 0), complex(i * t + rng.choice([0, 5]), 5500)] for i in range(rng.randint(3, 9))] + [[complex(0, i * t), complex(5500, i * t)] for i in range(rng.randint(3, 9))]
    rng.shuffle(strokes)
    side = rng.choice([5000, 6000, 9000])
    return strokes, rng.choice(["bathroom", "kitchen", "garage", "auditorium", "ward", "other", None]), _box(0j, side, side, 1, False)


def test_detectors_on_tables_are_those_on_rooms(spark):
    made = {str(i): _room(i) for i in range(120)}
    xy = lambda s: [(p.real, p.imag) for p in s]
    strokes = spark.createDataFrame([(r, i, xy(s)) for r, (ss, _, _) in made.items() for i, s in enumerate(ss)], f"room string, stroke int, points {POINTS}")
    rooms = spark.createDataFrame([(r, c, xy(ring)) for r, (_, c, ring) in made.items()], f"room string, category string, ring {POINTS}")
    found = {(r["room"], r["symbol"]): (r["kind"], r["confidence"]) for r in detectors.room_symbols(strokes, rooms, ["room"]).collect()}
    nested = strokes.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("stroke", "points"))).alias("s")).join(rooms, "room")
    contexts = nested.select(F.col("room").alias("id"), F.transform("s", lambda x: x["points"]).alias("strokes"), F.col("ring").alias("polygon"), "category")
    expected = {(r["id"], r["symbol"]): (r["kind"], r["confidence"]) for r in symbols_of(contexts, "room").collect() if r["symbol"] in NAMES}
    assert found.keys() == expected.keys()
    for k, (kind, told) in expected.items():
        assert found[k][0] == kind and found[k][1] == pytest.approx(told, abs=1e-6), k
    assert {s for _, s in expected} == set(NAMES)


def test_facet_chains_are_the_search(spark):
    from plinth.symbols import chains
    from plinth.symbols.base import OpeningContext
    from plinth.symbols.openings import facet_chain

    rng, rows, openings, expected = random.Random(31), [], [], {}
    for i in range(60):
        width, n = 1000.0, rng.randint(2, 9)
        line = [complex(-width / 2 + width * k / n, rng.choice([0, 150, 300]) if 0 < k < n else 0) for k in range(n + 1)]
        segs = [(a, b + rng.uniform(-15, 15)) for a, b in zip(line, line[1:], strict=False)]
        segs += [(rng.choice(line), rng.choice([*line, complex(rng.uniform(-700, 700), 500)])) for _ in range(rng.randint(0, 4))]
        segs = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in segs if abs(b - a) >= 60 and rng.random() < 0.95]
        rng.shuffle(segs)
        chain = facet_chain(OpeningContext(width, 100.0, [[a, b] for a, b in segs]), 60.0, 8)
        if chain:
            expected[i] = [chain[0][0], *[b for _, b in chain]]
        rows += [(i, k, a.real, a.imag, b.real, b.imag) for k, (a, b) in enumerate(segs)]
        openings.append((i, width))
    segs = spark.createDataFrame([tuple(map(float, r)) for r in rows], "o double, seq double, ax double, ay double, bx double, by double").withColumns({"o": F.col("o").cast("int"), "seq": F.col("seq").cast("int")})
    found = {}
    for r in sorted(chains.facet_chains(segs, spark.createDataFrame(openings, "o int, width double"), ["o"], 8).collect(), key=lambda r: r["place"]):
        found.setdefault(r["o"], []).append(complex(r["x"], r["y"]))
    assert found == expected and 20 < len(expected) < 60


def test_few_strokes_of_openings_are_searched_in_one_shuffle(spark, monkeypatch):
    """Openings with few strokes write no rounds; crowded ones do, and both ways give the same chains."""
    from plinth.symbols import chains

    rng, rows = random.Random(7), []
    for i in range(40):
        n = rng.randint(2, 9)
        line = [(-500 + 1000 * k / n, rng.choice([0.0, 150.0]) if 0 < k < n else 0.0) for k in range(n + 1)]
        drawn = [*zip(line, line[1:], strict=False), *[(rng.choice(line), rng.choice(line)) for _ in range(rng.randint(0, 4))]]
        rng.shuffle(drawn)
        rows += [(i, k, *map(float, a), b[0] + rng.uniform(-9, 9), float(b[1])) for k, (a, b) in enumerate(drawn) if rng.random() < 0.95]
    segs = spark.createDataFrame([*rows, (None, 0, 0.0, 0.0, 9.0, 9.0), (41, 0, 0.0, 0.0, 9.0, 9.0)], "o int, seq int, ax double, ay double, bx double, by double")
    openings = spark.createDataFrame([(i, 1000.0 if i != 5 else None) for i in range(41)], "o int, width double")
    written = []
    monkeypatch.setattr(chains, "settled", lambda df, write=chains.settled: written.append(1) or write(df))
    told = lambda: sorted(map(tuple, chains.facet_chains(segs, openings, ["o"], 8).select("o", "place", "node", "x", "y").collect()))
    found = told()
    assert len(written) == 1 and len({r[0] for r in found}) > 10
    monkeypatch.setattr(chains, "FEW", 7)
    assert told() == found and len(written) > 5

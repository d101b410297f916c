import cmath
import math

import pytest

from plinth.functions.planar import arc_points
from plinth.symbols import OpeningContext, PlanContext, RoomContext, best_match, registry
from plinth.symbols.base import Label, Match, Symbol, all_matches, symbol, tried

TAU = math.tau


def seg(a, b):
    return [complex(a), complex(b)]


def box(x, y, w, h):
    p = complex(x, y)
    return [p, p + w, p + complex(w, h), p + 1j * h, p]


def ring(c, r, n=32):
    return arc_points(complex(c), r, 0, TAU, n)


def blob(c, r, n=24, depth=0.06):
    return [complex(c) + cmath.rect(r * (1 + depth * (-1) ** i), TAU * i / n) for i in range(n + 1)]


def opening(*strokes, width=900, thick=110, **kw):
    return OpeningContext(width, thick, [list(map(complex, s)) for s in strokes], kw.pop("layers", [None] * len(strokes)), **kw)


ROOM = box(0, 0, 6000, 5000)[:-1]


def room(*strokes, polygon=ROOM, layer=None, **kw):
    return RoomContext([list(map(complex, s)) for s in strokes], [layer] * len(strokes), kw.pop("filled", [False] * len(strokes)), polygon, **kw)


def plan(*strokes, texts=(), layer=None):
    pts = [p for s in strokes for p in map(complex, s)] or [0j]
    bounds = (min(p.real for p in pts), min(p.imag for p in pts), max(p.real for p in pts), max(p.imag for p in pts))
    return PlanContext([list(map(complex, s)) for s in strokes], [layer] * len(strokes), [False] * len(strokes), [Label(*t) for t in texts], bounds)


SWING = [arc_points(-450, 900, 0, math.pi / 2), seg(-450, -450 + 900j)]
DOUBLE = [arc_points(-450, 450, 0, math.pi / 2), arc_points(450, 450, math.pi / 2, math.pi)]
PANES = [seg(-450 + 1j * y, 450 + 1j * y) for y in (-40, 0, 40)]
FOLD = [[complex(-900 + 450 * i, 300 * (i % 2)) for i in range(5)]]
SPOKES = [seg(0, cmath.rect(1000, TAU * i / 4 + 0.3)) for i in range(4)]
SLATS = [[complex(-1500 + 3000 * i / 24, 60 * (i % 2)) for i in range(25)]]
BAY = [[-1200, -800 + 700j, 800 + 700j, 1200]]
CORNER = [seg(-800 + 1j * y, 800 + 1j * y) for y in (-30, 30)] + [seg(800, 800 + 1600j)]
WALLING = [seg(-3000 + 1j * y, 3000 + 1j * y) for y in (-40, 40)] + [seg(x - 100j, x + 100j) for x in (-1800, -600, 600, 1800)]
TREADS = [seg(1j * 280 * i, 1000 + 280j * i) for i in range(10)]
FAN = [seg(cmath.rect(100, TAU * i / 12), cmath.rect(900, TAU * i / 12)) for i in range(12)]
STEPS = [seg(1j * 400 * i, 1000 + 400j * i) for i in range(24)] + [seg(x, x + 9200j) for x in (0, 1000)]
RAILS = [seg(0, 14000), seg(1400j, 14000 + 1400j)]
RAMP = [seg(0, 11000), seg(2400j, 11000 + 2400j)]
CAR = [box(0, 0, 1600, 1400), seg(0, 1600 + 1400j), seg(1400j, 1600)]
SMALL_CAR = [box(0, 0, 600, 600), seg(0, 600 + 600j), seg(600j, 600)]
SEATS = [box(600 * c, 900 * r, 500, 480) for r in range(4) for c in range(8)]
TILES = [seg(600 * i, 600 * i + 5000j) for i in range(1, 9)] + [seg(600j * i, 6000 + 600j * i) for i in range(1, 8)]
GRID = [seg(x, x + 8000j) for x in (0, 4000, 8000)] + [seg(1j * y, 8000 + 1j * y) for y in (0, 8000)] + [ring(x - 400j, 400) for x in (0, 4000, 8000)] + [ring(-400 + 1j * y, 400) for y in (0, 8000)]
GRID_TEXT = [("1", -400j), ("2", 4000 - 400j), ("3", 8000 - 400j), ("A", -400 + 0j), ("B", -400 + 8000j)]
SECTION = [ring(0, 400), ring(9000, 400), seg(400, 8600)]
ELEVATION = [ring(0, 300), [300 - 150j, 700, 300 + 150j, 300 - 150j]]
NORTH = [[-300, 1000j, 300, -300]]
BAR = [box(2000 * i, 0, 2000, 250) for i in range(5)]
CHAIN = [seg(6000 * i, 6000 * (i + 1)) for i in range(3)]
CHAIN_TEXT = [("6000", 3000 + 6000 * i + 100j) for i in range(3)]
LEGEND = [box(0, -800 * i, 600, 400) for i in range(1, 4)]
LEGEND_TEXT = [("LEGEND", 100 + 300j), *[(t, complex(900, -800 * i + 200)) for i, t in enumerate(("BRICKWORK", "BLOCKWORK", "INSULATION"), 1)]]
HATCH = [seg(complex(120 * i * math.sqrt(2), 0) + max(0, i - 20) * 0, complex(120 * i * math.sqrt(2), 0) + (800 + 37 * (i % 5)) * (1 + 1j) / math.sqrt(2)) for i in range(30)]

POSITIVE = {
    "door_swing": opening(*SWING),
    "door_double": opening(*DOUBLE),
    "door_sliding": opening(seg(-450 + 120j, 650 + 120j)),
    "door_folding": opening(*FOLD, width=1800),
    "door_revolving": opening(*SPOKES, ring(0, 1000), width=2000, thick=300),
    "door_roller": opening(*SLATS, width=3000, thick=250),
    "door_fire_shutter": opening(*SLATS, width=3000, thick=250, layers=["A-FIRE-SHUT"]),
    "window": opening(*PANES),
    "window_bay": opening(*BAY, width=2400, thick=200),
    "window_corner": opening(*CORNER, width=1600, thick=200, wall_length=5000, middle=4200, bridged=True),
    "curtain_wall": opening(*WALLING, width=6000, thick=250),
    "opening_plain": opening(),
    "stairs": room(*TREADS),
    "stairs_spiral": room(*FAN),
    "escalator": room(*STEPS),
    "travelator": room(*RAILS, texts=["TRAVELATOR 1"]),
    "ramp": room(*RAMP, texts=["RAMP 1:12"]),
    "turning_circle": room(ring(2000 + 2000j, 750)),
    "kitchen": room(*[box(1200 * i, 0, 1200, 600) for i in range(4)], category="kitchen"),
    "column": room(box(1000, 1000, 400, 400), box(4000, 1000, 400, 400), filled=[True, False]),
    "sanitary": room(box(0, 0, 1700, 750), box(3000, 0, 700, 380), box(3000, 2000, 550, 450), category="bathroom"),
    "lift": room(*CAR),
    "dumbwaiter": room(*SMALL_CAR),
    "parking_bay": room(*[box(2500 * i, 0, 2400, 5000) for i in range(4)]),
    "furniture_layout": room(box(0, 0, 2000, 1500), box(3000, 0, 1400, 700), category="bedroom"),
    "fire_equipment": room(box(0, 0, 800, 300), layer="A-FIRE-EQPM"),
    "planting": room(blob(2000 + 2000j, 1200), layer="L-PLNT-SHRB"),
    "lab_bench": room(box(0, 0, 4000, 850), box(0, 4000, 4000, 850), box(0, 2000, 4000, 1700), category="lab"),
    "theatre_seating": room(*SEATS, category="auditorium"),
    "ward_bay": room(*[box(3000 * i, 0, 1000, 2000) for i in range(4)], category="ward"),
    "plant_equipment": room(box(0, 0, 2400, 1200), layer="M-EQPM-AHU", texts=["AHU-01"]),
    "drainage": room(box(0, 0, 250, 250), box(0, 1000, 2000, 150), layer="P-DRAI-FLOR", texts=["fall 1:80"]),
    "extract_canopy": room(box(0, 0, 3000, 1400), layer="M-EXTR-KEF"),
    "loading_dock": room(*[box(4000 * i, 0, 2400, 2000) for i in range(3)], layer="A-DOCK"),
    "raised_floor": room(*TILES),
    "structural_grid": plan(*GRID, texts=GRID_TEXT),
    "section_mark": plan(*SECTION, texts=[("S", 0j), ("S", 9000 + 0j)]),
    "elevation_mark": plan(*ELEVATION, texts=[("E1", 0j)]),
    "north_arrow": plan(*NORTH, texts=[("N", 1400j)]),
    "scale_bar": plan(*BAR, texts=[("0", -300j), ("10 m", 10000 - 300j)]),
    "dimension_chain": plan(*CHAIN, texts=CHAIN_TEXT),
    "door_schedule": plan(texts=[("DOOR SCHEDULE", 0j), ("D1", 1j), ("D02", 2j), ("D-3", 3j)]),
    "level_spot": plan(texts=[("FFL +0.15", 0j), ("+0.00", 1j)]),
    "escape_route": plan([0, 20000, 20000 + 16000j], texts=[("Travel dist 36 m", 0j)], layer="A-FIRE-ESCP-ESCAPE"),
    "revision_cloud": plan(blob(0, 1500), texts=[("REV 2", 0j)], layer="A-REVC"),
    "hatch_legend": plan(*LEGEND, texts=LEGEND_TEXT),
    "hatch_pattern": plan(*HATCH),
}
NEGATIVE = {
    "door_swing": [opening(), opening(*PANES), opening(ring(0, 450)), opening(*DOUBLE)],
    "door_double": [opening(), opening(*SWING), opening(*PANES)],
    "door_sliding": [opening(), opening(*PANES)],
    "door_folding": [opening(*BAY, width=2400, thick=200), opening(*SWING)],
    "door_revolving": [opening(*SPOKES[:2], width=2000), opening(*SWING)],
    "door_roller": [opening(*PANES), opening(*FOLD, width=1800)],
    "door_fire_shutter": [POSITIVE["door_roller"]],
    "window": [opening(), opening(*PANES[:1]), opening(*SWING)],
    "window_bay": [opening(*FOLD, width=1800), opening(*PANES)],
    "window_corner": [opening(*CORNER, width=1600, thick=200), opening(*PANES, bridged=True)],
    "curtain_wall": [opening(*PANES), opening(*WALLING[:2], width=6000, thick=250)],
    "opening_plain": [opening(*SWING), opening(*PANES), opening(width=5000)],
    "stairs": [room(), room(*STEPS), room(*TILES)],
    "stairs_spiral": [room(*TREADS), room(*FAN[:4])],
    "escalator": [room(*TREADS), room(*STEPS[:24])],
    "travelator": [room(*RAILS), room(*STEPS)],
    "ramp": [room(*RAMP), room(texts=["RAMP 1:12"])],
    "turning_circle": [room(ring(0, 400)), room(ring(2000 + 2000j, 750), seg(1900 + 2000j, 2100 + 2000j))],
    "kitchen": [room(*[box(1200 * i, 0, 1200, 600) for i in range(4)], category="bathroom"), room(*SEATS)],
    "column": [room(box(0, 0, 400, 400)), room(box(0, 0, 2000, 600), box(2100, 0, 400, 400), box(2600, 0, 400, 400))],
    "sanitary": [room(box(0, 0, 1700, 750), category="kitchen"), room(box(0, 0, 2000, 1500))],
    "lift": [room(*SMALL_CAR), room(CAR[0]), room(*CAR[:2])],
    "dumbwaiter": [room(*CAR), room(SMALL_CAR[0])],
    "parking_bay": [room(box(0, 0, 2400, 5000)), room(*SEATS)],
    "furniture_layout": [room(box(0, 0, 1400, 700), category="kitchen"), room(*SEATS)],
    "fire_equipment": [room(box(0, 0, 800, 300)), room(layer="A-FIRE")],
    "planting": [room(ring(0, 1000), layer="L-PLNT"), room(blob(0, 1200), layer="A-REVC")],
    "lab_bench": [room(*[box(1200 * i, 0, 1200, 600) for i in range(4)]), room(box(0, 0, 4000, 850), box(0, 4000, 4000, 850), category="kitchen")],
    "theatre_seating": [room(*SEATS[:6]), room(*TILES)],
    "ward_bay": [room(*[box(3000 * i, 0, 1000, 2000) for i in range(2)]), room(*SEATS)],
    "plant_equipment": [room(box(0, 0, 2400, 1200)), room(box(0, 0, 9000, 500), layer="M-EQPM-AHU")],
    "drainage": [room(box(0, 0, 250, 250)), room(box(0, 0, 900, 900), layer="P-DRAI")],
    "extract_canopy": [room(box(0, 0, 3000, 1400)), room(box(0, 0, 800, 600), layer="M-EXTR")],
    "loading_dock": [room(*[box(4000 * i, 0, 2400, 2000) for i in range(3)]), room(box(0, 0, 2400, 2000), layer="A-DOCK")],
    "raised_floor": [room(*TILES[:8]), room(*TREADS)],
    "structural_grid": [plan(*GRID[:5]), plan(*SECTION, texts=[("S", 0j), ("S", 9000 + 0j)])],
    "section_mark": [plan(*SECTION, texts=[("S", 0j), ("T", 9000 + 0j)]), plan(*SECTION[:2], texts=[("S", 0j), ("S", 9000 + 0j)])],
    "elevation_mark": [plan(ELEVATION[0], texts=[("E1", 0j)]), plan(*GRID, texts=GRID_TEXT)],
    "north_arrow": [plan(*NORTH), plan(*NORTH, texts=[("KITCHEN", 0j)])],
    "scale_bar": [plan(*BAR[:2]), plan(*[box(600 * i, 0, 500, 480) for i in range(6)])],
    "dimension_chain": [plan(*CHAIN), plan(CHAIN[0], texts=CHAIN_TEXT[:1])],
    "door_schedule": [plan(texts=[("D1", 0j), ("D2", 1j)]), plan(texts=[("DOOR SCHEDULE", 0j)])],
    "level_spot": [plan(texts=[("room 12", 0j)]), plan()],
    "escape_route": [plan([0, 20000]), plan([0, 2000], layer="A-FIRE-ESCAPE")],
    "revision_cloud": [plan(blob(0, 1500)), plan(ring(0, 1500), layer="A-REVC")],
    "hatch_legend": [plan(*LEGEND), plan(LEGEND[0], texts=LEGEND_TEXT)],
    "hatch_pattern": [plan(*HATCH[:6]), plan(*CHAIN)],
}


def test_every_symbol_has_cases():
    assert set(POSITIVE) == set(NEGATIVE) == set(registry()) and len(registry()) == 47


@pytest.mark.parametrize("name", sorted(POSITIVE))
def test_fires(name):
    s = registry()[name]
    m = s.detect(POSITIVE[name])
    assert m and m.kind == s.kind and 0.2 <= m.confidence <= 0.98


@pytest.mark.parametrize("name", sorted(NEGATIVE))
def test_stays_quiet(name):
    assert [i for i, c in enumerate(NEGATIVE[name]) if registry()[name].detect(c)] == []


@pytest.mark.parametrize("name", sorted(n for n, s in registry().items() if s.scope == "opening"))
def test_opening_symbols_win_their_own(name):
    assert best_match(POSITIVE[name])[0].id == name


@pytest.mark.parametrize("name", sorted(registry()))
def test_empty_contexts(name):
    empty = {"opening": opening(), "room": room(), "plan": plan()}[registry()[name].scope]
    m = registry()[name].detect(empty)
    assert m is None or name == "opening_plain"


def test_details():
    assert registry()["stairs_spiral"].detect(POSITIVE["stairs_spiral"]).meta["sweep"] == 360
    assert registry()["scale_bar"].detect(POSITIVE["scale_bar"]).meta["confirms_scale"]
    assert registry()["dimension_chain"].detect(POSITIVE["dimension_chain"]).meta["adds_up"]
    assert registry()["hatch_legend"].detect(POSITIVE["hatch_legend"]).meta["entries"] == ["BRICKWORK", "BLOCKWORK", "INSULATION"]
    assert registry()["structural_grid"].detect(POSITIVE["structural_grid"]).meta["references"] == ["1", "2", "3", "A", "B"]
    assert registry()["north_arrow"].detect(POSITIVE["north_arrow"]).meta["bearing"] == 0
    assert registry()["escape_route"].detect(POSITIVE["escape_route"]).meta["agrees"]
    assert registry()["window_bay"].detect(POSITIVE["window_bay"]).meta["style"] == "canted"


def test_room_symbols_add_up():
    both = room(*CAR, *[[p + 3000 for p in s] for s in TREADS])
    assert {"lift", "stairs"} <= {s.id for s, _ in all_matches(both, "room")}


def test_registry_refuses_repeats_and_scopes():
    with pytest.raises(ValueError):
        symbol("lift", "room", "lift", 1, "")(lambda c: None)
    with pytest.raises(ValueError):
        symbol("new", "street", "x", 1, "")

    def broken(c):
        raise ZeroDivisionError

    assert tried(Symbol("b", "room", "x", 0, "", broken), room()) is None
    assert tried(Symbol("b", "room", "x", 0, "", lambda c: Match("x", 1.0)), room()).kind == "x"


def test_label_rules_of_plan_symbols():
    """References by letter case, the first pattern that tells a level, runs of punctuation."""
    from plinth.functions.words import classify
    from plinth.symbols.plans import level_values

    assert [classify(x) for x in ("VỆ--SINH", "ban.-cong", "zz")] == ["bathroom", "balcony", "other"]
    assert [v for v, _ in level_values("+1.00 / +1.00 / -0.45")] == [1.0, 1.0, -0.45]


def test_a_plan_that_cannot_be_read_is_told_and_the_others_are_written(spark):
    from plinth.plans import extract as ex

    shape = "plan_id string, primitives array<struct<prim_id:int,points:array<struct<x:double,y:double>>,closed:boolean,stroked:boolean,filled:boolean,width:double,layer:string,color:struct<r:double,g:double,b:double>>>, texts array<struct<text_id:int,text:string,x:double,y:double,height:double,angle:double,layer:string>>"
    point = {"x": None, "y": None}
    line = {"prim_id": 1, "points": [point, point], "closed": False, "stroked": True, "filled": False, "width": 1.0, "layer": "A-WALL", "color": None}
    rows = spark.createDataFrame([("odd", [line], []), ("empty", [], [])], shape)
    got = {r["plan_id"]: r for r in ex.extract(rows, "1mm").collect()}
    assert set(got) == {"odd", "empty"} and any("not extracted" in w for w in got["odd"]["warnings"])

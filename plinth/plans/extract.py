"""From decoded pages to plan models: one row per plan, with its tables nested.

A plan's steps depend on each other's order, so each plan is one call of a kernel; a page is
already one row after decoding, so no shuffle is needed, and plans spread over all executors.
Child tables (rooms, walls, openings, ...) are ``inline`` views of the model rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.planar import bbox, point_in_polygon
from plinth.plans.arrangement import arrange
from plinth.plans.rooms import MIN_AREA, Text, audit, build_rooms, is_connected, opening_ids, room_graph
from plinth.plans.scale import find_scale
from plinth.plans.walls import find_walls
from plinth.symbols import OpeningContext, PlanContext, RoomContext, best_match
from plinth.symbols.base import Label, all_matches

SEARCH_ALONG, SEARCH_ACROSS = 1.4, 1.5
POINT = "struct<x:double,y:double>"
ROOM = f"id:string,name:string,category:string,area_gross_m2:double,area_net_m2:double,perimeter_m:double,centroid_mm:{POINT},label_point_mm:{POINT},polygon_mm:array<{POINT}>,labelled_area_m2:double,area_delta_pct:double,area_check:string,texts:array<string>"
WALL = f"id:string,start_mm:{POINT},end_mm:{POINT},length_mm:double,thickness_mm:double,layer:string,source:string,openings:array<string>"
OPENING = f"id:string,kind:string,symbol:string,confidence:double,wall:string,width_mm:double,bridged:boolean,centre_mm:{POINT},start_mm:{POINT},end_mm:{POINT},meta:string"
EDGE = "a:string,b:string,kind:string,via:string,symbol:string,confidence:double,shared_length_m:double,exterior:boolean"
FEATURE = "room:string,symbol:string,kind:string,confidence:double,meta:string"
SCALE = "struct<mm_per_pt:double,source:string,confidence:double,support:int,detail:string,drawing_scale:double>"
MODEL = (
    f"plan_id string, scale {SCALE}, bounds_mm struct<x0:double,y0:double,x1:double,y1:double>, rooms array<struct<{ROOM}>>, walls array<struct<{WALL}>>, "
    f"openings array<struct<{OPENING}>>, edges array<struct<{EDGE}>>, features array<struct<{FEATURE}>>, plan_features array<struct<{FEATURE}>>, connected boolean, warnings array<string>"
)


def _xy(p: complex) -> dict:
    return {"x": round(p.real, 1), "y": round(p.imag, 1)}


def classify_openings(walls, strokes, layers) -> list:
    """Names every opening by the best symbol drawn near it; a stroke counts if one of its
    points is near, in the opening's own frame."""
    boxes = np.array([bbox(s) for s in strokes]) if strokes else np.empty((0, 4))
    out = []
    for w in walls:
        d = w.way
        for o in w.openings:
            at, rx, ry = w.at(o.middle), o.width * SEARCH_ALONG, o.width * SEARCH_ACROSS
            r = max(rx, ry)
            near = np.flatnonzero((boxes[:, 2] >= at.real - r) & (boxes[:, 0] <= at.real + r) & (boxes[:, 3] >= at.imag - r) & (boxes[:, 1] <= at.imag + r))
            local, names = [], []
            for i in near:
                q = [(p - at) * d.conjugate() for p in strokes[i]]
                if any(abs(p.real) <= rx and abs(p.imag) <= ry for p in q):
                    local.append(q)
                    names.append(layers[i])
            hit = best_match(OpeningContext(o.width, w.thickness, local, names, w.length, o.middle, o.bridged))
            if hit:
                o.kind, o.symbol, o.confidence, o.meta = hit[1].kind, hit[0].id, round(hit[1].confidence, 3), dict(hit[1].meta)
            else:
                o.kind, o.symbol, o.confidence, o.meta = "opening", None, 0.15, {"reason": "no symbol matched"}
            out.append(o)
    return out


def room_features(rooms, strokes, layers, filled) -> list[dict]:
    owned: dict[str, list[int]] = {}
    frames = [(r, bbox(r.polygon)) for r in rooms]
    for i, pts in enumerate(strokes):
        counts = [(sum(x0 <= p.real <= x1 and y0 <= p.imag <= y1 and point_in_polygon(p, r.polygon) for p in pts), r.id) for r, (x0, y0, x1, y1) in frames]
        n, home = max(counts, key=lambda c: c[0], default=(0, ""))
        if n >= max(1, len(pts) // 2):
            owned.setdefault(home, []).append(i)
    out = []
    for r in rooms:
        mine = owned.get(r.id, [])
        c = RoomContext([strokes[i] for i in mine], [layers[i] for i in mine], [filled[i] for i in mine], r.polygon, r.category, r.texts)
        out += [{"room": r.id, "symbol": s.id, "kind": m.kind, "confidence": round(m.confidence, 3), "meta": m.meta} for s, m in all_matches(c, "room")]
    return out


def extract_plan(plan_id: str, primitives: list[dict], texts: list[dict], scale: str | None = None, min_room_area: float = MIN_AREA) -> dict:
    """The model of one plan; points of primitives are complex numbers in page points."""
    rings = [[*p["points"], p["points"][0]] if p["closed"] and len(p["points"]) > 2 and p["points"][0] != p["points"][-1] else list(p["points"]) for p in primitives]
    segs = [[(a, b) for a, b in zip(r, r[1:], strict=False) if abs(b - a) > 1e-6] for r in rings]
    found = find_scale(primitives, [s for own in segs for s in own], texts, scale)
    k = found.mm_per_pt
    drawn = [((a * k, b * k), p["layer"]) for own, p in zip(segs, primitives, strict=True) if p["stroked"] or p["filled"] for a, b in own if abs(b - a) * k > 1]
    walls = find_walls(drawn)
    plan = arrange([w.seg for w in walls])
    labels = [Text(t["text"], complex(t["x"], t["y"]) * k, t["height"] * k, t["layer"]) for t in texts]
    rooms = build_rooms(plan, walls, labels, min_room_area)
    strokes, layers, filled = [[p * k for p in r] for r in rings], [p["layer"] for p in primitives], [p["filled"] for p in primitives]
    openings = classify_openings(walls, strokes, layers)
    edges = room_graph(plan, rooms, walls, openings)
    features = room_features(rooms, strokes, layers, filled)
    everywhere = [p for s in strokes for p in s]
    sheet = PlanContext(strokes, layers, filled, [Label(t.text, t.at, t.height) for t in labels], bbox(everywhere))
    plan_features = [{"room": None, "symbol": s.id, "kind": m.kind, "confidence": round(m.confidence, 3), "meta": m.meta} for s, m in all_matches(sheet, "plan")]
    names = opening_ids(openings)
    corners = [p for w in walls for p in w.seg] or everywhere
    said = audit(found.row(), walls, rooms, openings, edges, plan_features)
    told = lambda fs: [{**f, "meta": json.dumps(f["meta"], ensure_ascii=False)} for f in fs]
    return {
        "plan_id": plan_id,
        "scale": found.row(),
        "bounds_mm": dict(zip(("x0", "y0", "x1", "y1"), (round(v, 1) for v in bbox(corners)), strict=True)),
        "rooms": [
            {
                "id": r.id, "name": r.name, "category": r.category, "area_gross_m2": r.gross, "area_net_m2": r.net, "perimeter_m": r.perimeter,
                "centroid_mm": _xy(r.centroid), "label_point_mm": _xy(r.label_point), "polygon_mm": [_xy(p) for p in r.polygon],
                "labelled_area_m2": r.labelled, "area_delta_pct": r.delta_pct, "area_check": r.area_check, "texts": r.texts,
            }
            for r in rooms
        ],
        "walls": [
            {"id": f"W{i:03d}", "start_mm": _xy(w.a), "end_mm": _xy(w.b), "length_mm": round(w.length, 1), "thickness_mm": round(w.thickness, 1), "layer": w.layer, "source": w.source, "openings": [names[id(o)] for o in w.openings]}
            for i, w in enumerate(walls, 1)
        ],
        "openings": [
            {
                "id": names[id(o)], "kind": o.kind, "symbol": o.symbol, "confidence": o.confidence, "wall": f"W{o.wall + 1:03d}", "width_mm": round(o.width, 1), "bridged": o.bridged,
                "centre_mm": _xy(walls[o.wall].at(o.middle)), "start_mm": _xy(walls[o.wall].at(o.start)), "end_mm": _xy(walls[o.wall].at(o.end)), "meta": json.dumps(o.meta, ensure_ascii=False),
            }
            for o in openings
        ],
        "edges": [{"a": e.a, "b": e.b, "kind": e.kind, "via": e.via, "symbol": e.symbol, "confidence": e.confidence, "shared_length_m": e.shared_m, "exterior": e.exterior} for e in edges],
        "features": told(features),
        "plan_features": told(plan_features),
        "connected": is_connected([r.id for r in rooms], edges),
        "warnings": said,
    }


def _points(value) -> list[complex]:
    return [complex(p["x"], p["y"]) for p in value]


_KINDS = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), POINT: pa.struct([("x", pa.float64()), ("y", pa.float64())])}
_KINDS |= {"array<string>": pa.list_(pa.string()), f"array<{POINT}>": pa.list_(_KINDS[POINT])}


def _arrow(fields: str) -> pa.StructType:
    """The Arrow type of a row of ``name:type`` fields."""
    parts = re.findall(r"(\w+):((?:array<)?struct<[^>]*>>?|array<\w+>|\w+)", fields)
    return pa.struct([(name, _KINDS[kind]) for name, kind in parts])


#: MODEL as Arrow has it, so that nested rows are not converted one by one.
MADE = pa.schema(
    [("plan_id", pa.string()), ("scale", _arrow(SCALE[7:-1])), ("bounds_mm", _arrow("x0:double,y0:double,x1:double,y1:double"))]
    + [(name, pa.list_(_arrow(row))) for name, row in (("rooms", ROOM), ("walls", WALL), ("openings", OPENING), ("edges", EDGE), ("features", FEATURE), ("plan_features", FEATURE))]
    + [("connected", pa.bool_()), ("warnings", pa.list_(pa.string()))]
)
#: Models that are held before they are given back.
MODELS_HELD = 16


def _model(plan_id, primitives, texts, scale: str | None, min_room_area: float) -> dict:
    """The model of one plan; of one that can't be read, an empty model whose warning says why."""
    try:
        shapes = [dict(p) | {"points": _points(p["points"])} for p in ([] if primitives is None else primitives)]
        return extract_plan(plan_id, [p for p in shapes if p["points"]], [dict(t) for t in ([] if texts is None else texts)], scale, min_room_area)
    except (ArithmeticError, LookupError, TypeError, ValueError, AttributeError) as e:
        lists = dict.fromkeys(("rooms", "walls", "openings", "edges", "features", "plan_features"), [])
        return lists | {"plan_id": plan_id, "scale": None, "bounds_mm": None, "connected": True, "warnings": [f"not extracted: {type(e).__name__}: {e}"]}


def _extract(scale: str | None, min_room_area: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), MODELS_HELD):
                some = rows.slice(at, MODELS_HELD).to_pylist()
                yield pa.RecordBatch.from_pylist([_model(r["plan_id"], r["primitives"], r["texts"], scale, min_room_area) for r in some], MADE)

    return run


def extract(pages: DataFrame, scale: str | None = None, min_room_area: float = MIN_AREA) -> DataFrame:
    """The models of ``pages(plan_id, primitives, texts)``, one row per plan."""
    # a plan is few bytes and much work, so plans are dealt out anew: partitions merged by their
    # size, or one large file of plans, would leave most cores idle
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("plan_id", "primitives", "texts").repartition(n).mapInArrow(_extract(scale, min_room_area), MODEL)


def nest(primitives: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Pages from tables of primitives (and texts) with plan_id, in the order of their numbers."""
    row = F.struct("prim_id", "points", "closed", "stroked", "filled", "width", "layer", "color")
    pages = primitives.groupBy("plan_id").agg(F.sort_array(F.collect_list(row)).alias("primitives"))
    empty = F.array().cast("array<struct<text_id:int,text:string,x:double,y:double,height:double,angle:double,layer:string>>")
    if texts is None:
        return pages.withColumn("texts", empty)
    own = texts.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("text_id", "text", "x", "y", "height", "angle", "layer"))).alias("texts"))
    return pages.join(own, "plan_id", "left").withColumn("texts", F.coalesce("texts", empty))


def child(models: DataFrame, name: str) -> DataFrame:
    """One of the nested tables: rooms, walls, openings, edges, features, plan_features."""
    return models.select("plan_id", F.inline(name))


def warnings_of(models: DataFrame) -> DataFrame:
    return models.select("plan_id", F.posexplode("warnings").alias("ord", "warning"))



"""IFC, SVG and GIF of plan models: one file per plan and format.

A file is written from one model, in order, so this is a map over the model rows; the result is
a table (plan_id, format, content) that ``save`` writes without collecting it.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.functions.planar import smoothstep
from plinth.sinks.raster import INK, MUTED, PAPER, Film, colour_for, hex_of, kind_colour, material_colour, mix

MARGIN = 600.0
MADE = pa.schema([("plan_id", pa.string()), ("format", pa.string()), ("content", pa.binary())])
#: Models whose files are held before they are given back.
MODELS_HELD = 16
GUID_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


@dataclass(frozen=True)
class IfcOptions:
    storey_height: float = 3000.0
    wall_height: float = 2700.0
    door_height: float = 2100.0
    window_height: float = 1500.0
    window_sill: float = 900.0
    project: str = "plinth extraction"
    site: str = "Site"
    building: str = "Building"
    storey: str = "Level 0"


def guid(seed: str) -> str:
    """22 letters of the seed's digest, the first of two bits, the others of six."""
    n = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:16], "big")
    return "".join(GUID_LETTERS[n >> 6 * i & 63] for i in reversed(range(22)))


def _number(x: float) -> str:
    text = f"{x:.6f}".rstrip("0")
    return text + "0" if text.endswith(".") and len(text) == 1 else text


def _text(s: str | None) -> str:
    if s is None:
        return "$"
    plain = "".join(c if " " <= c <= "~" else "?" for c in s)
    return "'" + plain.replace("\\", "\\\\").replace("'", "''") + "'"


class _Step:
    """Entities with dense numbers."""

    def __init__(self):
        self.lines: list[str] = []

    def add(self, kind: str, *args) -> str:
        self.lines.append(f"#{len(self.lines) + 1}={kind}({','.join(args)});")
        return f"#{len(self.lines)}"

    def point(self, *xyz: float) -> str:
        return self.add("IFCCARTESIANPOINT", "(" + ",".join(map(_number, xyz)) + ")")

    def polyline(self, points: list[tuple[float, float]]) -> str:
        return self.add("IFCPOLYLINE", "(" + ",".join([self.point(*p) for p in points]) + ")")


def ifc(model: dict, options: IfcOptions = IfcOptions()) -> str:
    """IFC4 STEP text in metres: spaces with quantities, walls with voids, doors and windows."""
    s, pid = _Step(), model["plan_id"]
    root = lambda kind, key, *rest: s.add(kind, _text(guid(f"{pid}/{key}")), "$", *rest)
    m = lambda p: (p["x"] / 1000, p["y"] / 1000)
    refs = lambda xs: "(" + ",".join(xs) + ")"
    origin = s.point(0, 0, 0)
    up, ahead = s.add("IFCDIRECTION", "(0.,0.,1.)"), s.add("IFCDIRECTION", "(1.,0.,0.)")
    axes = s.add("IFCAXIS2PLACEMENT3D", origin, up, ahead)
    context = s.add("IFCGEOMETRICREPRESENTATIONCONTEXT", "$", "'Model'", "3", "1.E-05", axes, "$")
    body = s.add("IFCGEOMETRICREPRESENTATIONSUBCONTEXT", "'Body'", "'Model'", "*", "*", "*", "*", context, "$", ".MODEL_VIEW.", "$")
    axis = s.add("IFCGEOMETRICREPRESENTATIONSUBCONTEXT", "'Axis'", "'Model'", "*", "*", "*", "*", context, "$", ".GRAPH_VIEW.", "$")
    units = [s.add("IFCSIUNIT", "*", *u) for u in ((".LENGTHUNIT.", "$", ".METRE."), (".AREAUNIT.", "$", ".SQUARE_METRE."), (".PLANEANGLEUNIT.", "$", ".RADIAN."))]
    project = root("IFCPROJECT", "project", _text(options.project), "$", "$", "$", "$", refs([context]), s.add("IFCUNITASSIGNMENT", refs(units)))
    place = s.add("IFCLOCALPLACEMENT", "$", axes)
    site = root("IFCSITE", "site", _text(options.site), "$", "$", place, "$", "$", ".ELEMENT.", "$", "$", "$", "$", "$")
    building = root("IFCBUILDING", "building", _text(options.building), "$", "$", place, "$", "$", ".ELEMENT.", "$", "$", "$")
    storey = root("IFCBUILDINGSTOREY", "storey", _text(options.storey), "$", "$", place, "$", "$", ".ELEMENT.", "0.")
    for a, b in ((project, site), (site, building), (building, storey)):
        root("IFCRELAGGREGATES", f"{a}{b}", "$", "$", a, refs([b]))

    def solid(ring: list[tuple[float, float]], low: float, high: float) -> str:
        profile = s.add("IFCARBITRARYCLOSEDPROFILEDEF", ".AREA.", "$", s.polyline([*ring, ring[0]]))
        base = s.add("IFCAXIS2PLACEMENT3D", s.point(0, 0, low / 1000), up, ahead)
        return s.add("IFCEXTRUDEDAREASOLID", profile, base, up, _number((high - low) / 1000))

    def shape(*items: tuple[str, str, str, str]) -> str:
        made = [s.add("IFCSHAPEREPRESENTATION", c, f"'{name}'", f"'{kind}'", refs([item])) for c, name, kind, item in items]
        return s.add("IFCPRODUCTDEFINITIONSHAPE", "$", "$", refs(made))

    def strip(a: dict, b: dict, thick: float) -> list[tuple[float, float]]:
        (x, y), (u, v) = m(a), m(b)
        size = math.hypot(u - x, v - y) or 1.0
        nx, ny = -(v - y) / size * thick / 2000, (u - x) / size * thick / 2000
        return [(x + nx, y + ny), (x - nx, y - ny), (u - nx, v - ny), (u + nx, v + ny)]

    spaces = []
    for r in model["rooms"]:
        ring = [m(p) for p in r["polygon_mm"]]
        look = shape((body, "Body", "SweptSolid", solid(ring, 0, options.storey_height)))
        space = root("IFCSPACE", f"space/{r['id']}", _text(r["id"]), "$", "$", place, look, _text(r["name"] or r["category"]), ".ELEMENT.", ".INTERNAL.", "$")
        spaces.append(space)
        areas = [s.add("IFCQUANTITYAREA", f"'{n}'", "$", "$", _number(r[k]), "$") for n, k in (("GrossFloorArea", "area_gross_m2"), ("NetFloorArea", "area_net_m2"))]
        quantities = root("IFCELEMENTQUANTITY", f"quantity/{r['id']}", "'Qto_SpaceBaseQuantities'", "$", "$", refs(areas))
        root("IFCRELDEFINESBYPROPERTIES", f"defines/{r['id']}", "$", "$", refs([space]), quantities)
    if spaces:
        root("IFCRELAGGREGATES", "spaces", "$", "$", storey, refs(spaces))
    held, walls = [], {}
    for w in model["walls"]:
        line = s.polyline([m(w["start_mm"]), m(w["end_mm"])])
        look = shape((axis, "Axis", "Curve2D", line), (body, "Body", "SweptSolid", solid(strip(w["start_mm"], w["end_mm"], w["thickness_mm"]), 0, options.wall_height)))
        made = root("IFCWALLSTANDARDCASE", f"wall/{w['id']}", _text(w["id"]), "$", "$", place, look, "$", "$")
        walls[w["id"]] = (made, w["thickness_mm"])
        held.append(made)
    for o in model["openings"]:
        made, thick = walls[o["wall"]]
        low = options.window_sill if o["kind"] == "window" else 0.0
        high = low + options.window_height if o["kind"] == "window" else options.door_height
        look = shape((body, "Body", "SweptSolid", solid(strip(o["start_mm"], o["end_mm"], thick + 20), low, high)))
        void = root("IFCOPENINGELEMENT", f"void/{o['id']}", _text(o["id"]), "$", "$", place, look, "$", ".OPENING.")
        root("IFCRELVOIDSELEMENT", f"voids/{o['id']}", "$", "$", made, void)
        if o["kind"] in ("door", "window"):
            fill = shape((body, "Body", "SweptSolid", solid(strip(o["start_mm"], o["end_mm"], min(thick, 60)), low, high)))
            kind = "IFCDOOR" if o["kind"] == "door" else "IFCWINDOW"
            leaf = root(kind, f"fill/{o['id']}", _text(o["id"]), "$", _text(o["symbol"]), place, fill, "$", _number((high - low) / 1000), _number(o["width_mm"] / 1000), "$", "$", "$")
            root("IFCRELFILLSELEMENT", f"fills/{o['id']}", "$", "$", void, leaf)
            held.append(leaf)
    if held:
        root("IFCRELCONTAINEDINSPATIALSTRUCTURE", "contained", "$", "$", refs(held), storey)
    head = ["ISO-10303-21;", "HEADER;", "FILE_DESCRIPTION(('ViewDefinition [CoordinationView]'),'2;1');", f"FILE_NAME({_text(pid)},'1970-01-01T00:00:00',(''),(''),'plinth','plinth','');", "FILE_SCHEMA(('IFC4'));", "ENDSEC;", "DATA;"]
    return "\n".join([*head, *s.lines, "ENDSEC;", "END-ISO-10303-21;", ""])


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def svg(model: dict, width: int = 1000, show_graph: bool = True, show_labels: bool = True) -> str:
    b = model["bounds_mm"]
    w, h = b["x1"] - b["x0"] + 2 * MARGIN, b["y1"] - b["y0"] + 2 * MARGIN
    at = lambda p: (round(p["x"] - b["x0"] + MARGIN, 1), round(b["y1"] + MARGIN - p["y"], 1))
    pts = lambda ring: " ".join(f"{x},{y}" for x, y in map(at, ring))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{max(1, round(width * h / w))}" viewBox="0 0 {w:.1f} {h:.1f}">', f'<rect width="100%" height="100%" fill="{hex_of(PAPER)}"/>']
    for r in model["rooms"]:
        out.append(f'<polygon class="room" id="{escape(r["id"])}" points="{pts(r["polygon_mm"])}" fill="{hex_of(colour_for(r["category"]))}" fill-opacity="0.6"/>')
    for x in model["walls"]:
        (ax, ay), (bx, by) = at(x["start_mm"]), at(x["end_mm"])
        out.append(f'<line class="wall" x1="{ax}" y1="{ay}" x2="{bx}" y2="{by}" stroke="{hex_of(INK)}" stroke-width="{x["thickness_mm"]}"/>')
    for o in model["openings"]:
        (ax, ay), (bx, by) = at(o["start_mm"]), at(o["end_mm"])
        out.append(f'<line class="{escape(o["kind"])}" x1="{ax}" y1="{ay}" x2="{bx}" y2="{by}" stroke="{hex_of(kind_colour(o["kind"]))}" stroke-width="160"/>')
    centre = {r["id"]: at(r["label_point_mm"]) for r in model["rooms"]}
    for e in model["edges"] if show_graph else ():
        if not e["exterior"] and e["kind"] != "wall":
            (ax, ay), (bx, by) = centre[e["a"]], centre[e["b"]]
            out.append(f'<line class="edge" x1="{ax}" y1="{ay}" x2="{bx}" y2="{by}" stroke="{hex_of(MUTED)}" stroke-width="40" stroke-dasharray="120 80"/>')
    for r in model["rooms"] if show_labels else ():
        x, y = centre[r["id"]]
        out.append(f'<text x="{x}" y="{y}" font-size="220" text-anchor="middle">{escape(r["name"] or r["id"])}</text><text x="{x}" y="{y + 260}" font-size="160" text-anchor="middle">{r["area_gross_m2"]:.2f} m²</text>')
    total = sum(r["area_gross_m2"] for r in model["rooms"])
    out.append(f'<text x="{MARGIN}" y="{h - 150:.1f}" font-size="180">{len(model["rooms"])} rooms, {total:.2f} m², scale 1:{model["scale"]["drawing_scale"]:.0f}</text></svg>')
    return "\n".join(out)


def storyboard(model: dict, size: int = 120, steps: int = 2) -> tuple[Film, list[int]]:
    """Frames and how long they stay: walls, openings, rooms, graph, labels, and materials if regions are hatched."""
    b = model["bounds_mm"]
    span = max(b["x1"] - b["x0"], b["y1"] - b["y0"], 1.0) + 2 * MARGIN
    at = lambda p: ((p["x"] - b["x0"] + MARGIN) / span * size, size - (p["y"] - b["y0"] + MARGIN) / span * size)
    regions = [r for f in model["plan_features"] if f["symbol"] == "hatch_pattern" for r in json.loads(f["meta"])["regions"]]
    beats = ["walls", "openings", "rooms", "graph", "labels", *(["materials"] if regions else [])]
    shown = [(k, smoothstep((step + 1) / steps)) for k in range(len(beats)) for step in range(steps)]
    film = Film(size, size, len(shown))
    level = lambda beat: [1.0 if beats.index(beat) < k else t if beats.index(beat) == k else 0.0 for k, t in shown]
    mixed = lambda a, b, beat, floor=-1.0: [mix(a, b, t) for t in level(beat) if t > floor]
    for r in model["rooms"]:
        film.polygon([at(p) for p in r["polygon_mm"]], mixed(PAPER, colour_for(r["category"]), "rooms"))
    for i, r in enumerate(regions):
        x, y = at({"x": r["at"][0], "y": r["at"][1]})
        film.circle(x, y, 6, mixed(PAPER, material_colour(i), "materials"))
    ink = mixed(PAPER, INK, "walls")
    for w in model["walls"]:
        film.line(at(w["start_mm"]), at(w["end_mm"]), ink, max(2.0, w["thickness_mm"] / span * size))
    for o in model["openings"]:
        film.line(at(o["start_mm"]), at(o["end_mm"]), mixed(INK, kind_colour(o["kind"]), "openings"), 3)
    centre = {r["id"]: at(r["label_point_mm"]) for r in model["rooms"]}
    # edges and labels are shown by the frames from their beat on
    muted, said = mixed(PAPER, MUTED, "graph", 0), mixed(PAPER, INK, "labels", 0)
    for e in model["edges"]:
        if not e["exterior"] and e["kind"] != "wall":
            film.line(centre[e["a"]], centre[e["b"]], muted, 1.5)
    for r in model["rooms"]:
        x, y = centre[r["id"]]
        film.ring(x, y - 8, 3, said)
        film.text(x, y, r["id"], said)
        film.text(x, y + 9, f"{r['area_gross_m2']:.1f}", said)
    return film, [80 if n % steps == steps - 1 else 8 for n in range(len(shown))]


def _gif(model: dict) -> bytes:
    film, delays = storyboard(model)
    return film.gif(delays)


_RENDER = {"ifc": lambda m: ifc(m).encode("ascii"), "svg": lambda m: svg(m).encode(), "gif": _gif}


def render(models: DataFrame, formats: list[str]) -> DataFrame:
    """(plan_id, format, content) of each plan and format."""
    unknown = set(formats) - set(_RENDER)
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), MODELS_HELD):
                models = rows.slice(at, MODELS_HELD).to_pylist()
                made = [{"plan_id": m["plan_id"], "format": f, "content": _RENDER[f](m)} for m in models for f in formats]
                yield pa.RecordBatch.from_pylist(made, MADE)

    return models.mapInArrow(run, "plan_id string, format string, content binary")

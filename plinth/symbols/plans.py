"""Plan symbols: what a sheet says about itself.  Every one that fits adds a feature."""

from __future__ import annotations

import cmath
import math
import re
from statistics import median

from plinth.functions.planar import Point, Seg, fold_gap, heading, length, point_seg_distance, project_param, ring_corners, spread
from plinth.functions.words import fold_text
from plinth.symbols.base import Arc, Label, Loop, Match, PlanContext, arcs_of, gaps, named, parallel_groups, positive, symbol, within

# Words in layer names, and patterns of labels.
REVISION_LAYERS = ("rev", "cloud", "delta", "sua doi", "thay doi")
REVISION_TAG = r"\b(rev(?:ision)?\s*\d+|rev\s*[a-z]\b|sua\s*doi)\b"
ESCAPE_LAYERS = ("escape", "egress", "fire", "exit", "thoat hiem", "thoat nan", "evac")
ESCAPE_DISTANCE = r"(\d{1,3}(?:[.,]\d)?)\s*m\b"
ESCAPE_WORDS = r"\b(travel\s*dist\w*|escape|egress|exit\s*route|thoat\s*hiem|thoat\s*nan)\b"
SCHEDULE_TITLE = r"\b(door\s*schedule|schedule\s*of\s*doors|bang\s*(thong\s*ke\s*)?cua|door\s*list)\b"
SCHEDULE_REFERENCE = r"^(?:d|dr|cua)\s*[-_]?\s*(\d{1,3})[a-z]?$"
NORTH = r"^(n|north|bac|huong\s*bac)$"
BAR_NUMBER = r"^\+?(\d{1,3}(?:[.,]\d)?)\s*(m|km|mm)?$"
LEGEND_TITLE = r"\b(legend|key|hatch\s*legend|chu\s*thich|ghi\s*chu\s*vat\s*lieu)\b"
CHAIN_VALUE = r"^[^\d]{0,2}(\d{3,6})(?:\s*mm)?[^\d]{0,2}$"
LEVEL_PREFIX = r"(?:ffl|ssl|sfl|toc|cl|cos|cot|level|lvl)"
LEVEL_SIGNED = rf"(?:{LEVEL_PREFIX})?\s*([+-]\s?\d{{1,3}}(?:[.,]\d{{2,3}}))(?!\d)"
LEVEL_PREFIXED = rf"\b(?:{LEVEL_PREFIX})\s*([+-]?\d{{1,3}}(?:[.,]\d{{2,3}}))\b"


def _bubbles(c: PlanContext, low: float, high: float) -> list[Arc]:
    return [a for a in arcs_of(c.strokes, 300.0, 0.08) if low <= 2 * a.radius <= high]


def _label_in(c: PlanContext, a: Arc, reach: float = 1.0) -> str | None:
    near = sorted(c.near(a.centre, reach * a.radius), key=lambda t: abs(t.at - a.centre))
    return near[0].text.strip().upper() if near else None


def _bearing(v: Point) -> float:
    """Degrees clockwise from sheet-up."""
    return math.degrees(math.atan2(v.real, v.imag)) % 360


@symbol("structural_grid", "plan", "grid", 10, "grid lines that end at bubbles")
def structural_grid(c: PlanContext) -> Match | None:
    x0, y0, x1, y1 = c.bounds
    bubbles = [(a, _label_in(c, a)) for a in _bubbles(c, 300.0, 1200.0)]
    letters = [t for _, t in bubbles if t and t.isalpha()]
    bubbles = [(a, t) for a, t in bubbles if not (t and t.isalpha() and letters.count(t) > 1)]
    lines: dict[float, list[tuple[float, Arc, str | None]]] = {0.0: [], math.pi / 2: []}
    for s in c.straight(0.0):
        for axis, extent in ((0.0, x1 - x0), (math.pi / 2, y1 - y0)):
            if extent <= 0 or fold_gap(heading(s), axis) > math.radians(3) or length(s) < 0.55 * extent:
                continue
            near = [(a, t) for a, t in bubbles if min(abs(p - a.centre) for p in s) <= 1.6 * a.radius]
            d = cmath.rect(1, -heading(s))
            hit = min(near, key=lambda x, s=s, d=d: abs(((x[0].centre - s[0]) * d).imag), default=None)
            if hit:
                lines[axis].append(((s[0].imag + s[1].imag) / 2 if axis == 0 else (s[0].real + s[1].real) / 2, *hit))
    found = [x for axis in lines.values() for x in axis]
    used = {id(a): t for _, a, t in found}
    if len(found) < 4 or len(used) < 3:
        return None
    bays = [gaps([x[0] for x in axis], 200.0) for axis in lines.values()]
    cvs = [spread(b) for b in bays if b]
    if not cvs or max(cvs) > 0.45:
        return None
    refs = sorted({t for t in used.values() if t})
    told = min(0.94, 0.70 + 0.10 * min(1, len(used) / 6) + 0.12 * bool(refs))
    meta = {"gridlines": len(found), "bubbles": len(used), "references": refs, "bay": round(median(x for b in bays for x in b), 1), "bay_spread": round(max(cvs), 3)}
    return Match("grid", told, meta)


@symbol("section_mark", "plan", "section_mark", 12, "a pair of lettered section bubbles")
def section_mark(c: PlanContext) -> Match | None:
    by_letter: dict[str, list[Arc]] = {}
    for a in _bubbles(c, 300.0, 1600.0):
        t = _label_in(c, a, 2.2)
        if t and len(t) == 1 and t.isalpha():
            by_letter.setdefault(t, []).append(a)
    segs, found = c.straight(200.0), []
    for letter, pair in sorted(by_letter.items()):
        if len(pair) != 2:
            continue
        a, b = pair[0].centre, pair[1].centre
        apart = abs(b - a)
        ends = lambda s, a=a, b=b: max(abs(s[0] - a), abs(s[1] - b)) <= 1200 or max(abs(s[0] - b), abs(s[1] - a)) <= 1200
        if apart >= 2000 and any(length(s) >= 0.4 * apart and ends(s) for s in segs):
            found.append({"label": f"{letter}-{letter}", "length": round(apart, 1), "bearing": round(_bearing(b - a) % 180, 1)})
    if not found:
        return None
    return Match("section_mark", min(0.90, 0.74 + 0.08 * min(2, len(found) - 1)), {"sections": found, "count": len(found)})


@symbol("elevation_mark", "plan", "elevation_mark", 11, "a bubble with an arrow, one of its name")
def elevation_mark(c: PlanContext) -> Match | None:
    bubbles = [(a, t) for a in _bubbles(c, 300.0, 1600.0) if (t := _label_in(c, a)) and len(t) <= 2]
    names = [t for _, t in bubbles]
    found = []
    for a, t in bubbles:
        r = a.radius
        if names.count(t) != 1 or any(length(s) >= 6 * r and min(abs(p - a.centre) for p in s) <= 2 * r for s in c.straight(6 * r)):
            continue
        for i, pts in enumerate(c.strokes):
            if i == a.stroke or not 3 <= len(pts) <= 6:
                continue
            middle = sum(pts) / len(pts)
            size = max(abs(p - q) for p in pts for q in pts)
            if 200 <= size <= 3000 and abs(middle - a.centre) <= 3 * r:
                tip = max(pts, key=lambda p: abs(p - a.centre))
                found.append({"label": t, "bearing": round(_bearing(tip - a.centre), 1)})
                break
    if not found:
        return None
    return Match("elevation_mark", min(0.90, 0.72 + 0.06 * min(3, len(found) - 1)), {"marks": found, "count": len(found)})


@symbol("north_arrow", "plan", "north_arrow", 10, "a glyph labelled north")
def north_arrow(c: PlanContext) -> Match | None:
    best = None
    labels = [t for t in c.texts if re.fullmatch(NORTH, fold_text(t.text).strip())]
    for pts in map(ring_corners, c.strokes) if labels else ():
        if len(pts) < 3:
            continue
        middle = sum(pts) / len(pts)
        size = max(abs(p - q) for p in pts for q in pts)
        near = next((t for t in labels if abs(t.at - middle) <= 3 * size), None)
        if not within(size, (300.0, 6000.0)) or not near:
            continue
        far = max(pts, key=lambda p: (abs(p - middle), -abs(p - near.at)))
        tips = [p for p in pts if abs(abs(p - middle) - abs(far - middle)) <= 0.02 * size]
        tip = min(tips, key=lambda p: abs(p - near.at))
        told = min(0.92, 0.78 + 0.08 * min(1, positive(3 * size - abs(near.at - middle)) / (3 * size)))
        if best is None or told > best.confidence:
            best = Match("north_arrow", told, {"bearing": round(_bearing(tip - middle), 1), "glyph": round(size, 1), "label": near.text})
    return best


def _metres(text: str) -> float | None:
    m = re.fullmatch(BAR_NUMBER, fold_text(text).strip())
    return float(m[1].replace(",", ".")) * {"km": 1000.0, "mm": 0.001}.get(m[2] or "m", 1.0) if m else None


@symbol("scale_bar", "plan", "scale_bar", 15, "equal divisions with a stated length")
def scale_bar(c: PlanContext) -> Match | None:
    bars = [x for x in c.loops() if x.long >= 1.8 * max(x.short, 1e-9) and x.short > 1]
    for axis in (0, 1):
        flat = [x for x in bars if abs((x.box[2 + axis] - x.box[axis]) - x.long) <= 0.1 * x.long]
        for first in flat:
            row = sorted((x for x in flat if abs(x.box[1 - axis] - first.box[1 - axis]) <= 0.5 * first.short and abs(x.long - first.long) <= 0.12 * first.long and abs(x.short - first.short) <= 0.3 * first.short), key=lambda x: x.box[axis])
            run: list[Loop] = []
            for x in row:
                if run and abs(x.box[axis] - run[-1].box[axis] - first.long) > 0.25 * first.long:
                    if len(run) >= 3:
                        break
                    run = []
                run.append(x)
            if len(run) < 3 or spread([x.long for x in run]) > 0.12:
                continue
            measured = (run[-1].box[2 + axis] - run[0].box[axis]) / 1000
            centre = (run[0].centre + run[-1].centre) / 2
            stated = max((v for t in c.near(centre, 0.75 * measured * 1000 + 4 * first.short) if (v := _metres(t.text)) and v > 0), default=None)
            delta = (measured - stated) / stated * 100 if stated else None
            ok = delta is not None and abs(delta) <= 6
            told = min(0.92, 0.72 + 0.10 * min(1, (len(run) - 3) / 4) + 0.10 * ok)
            return Match("scale_bar", told, {"divisions": len(run), "measured_m": round(measured, 2), "stated_m": stated, "delta_pct": None if delta is None else round(delta, 2), "confirms_scale": ok})
    return None


@symbol("dimension_chain", "plan", "dimension_chain", 10, "dimensions in a row that should add up")
def dimension_chain(c: PlanContext) -> Match | None:
    links: list[tuple[float, Seg]] = []
    segs = c.straight(200.0)
    for t in c.texts:
        m = re.fullmatch(CHAIN_VALUE, fold_text(t.text).strip())
        if not m or not 200 <= int(m[1]) <= 100_000:
            continue
        reach = max(6 * t.height, 1200.0)
        near = [(point_seg_distance(t.at, s), i) for i, s in enumerate(segs) if 0 <= project_param(t.at, s) <= 1]
        near = [x for x in near if x[0] <= reach]
        if near:
            links.append((float(m[1]), segs[min(near)[1]]))
    chains: list[list[tuple[float, Seg]]] = []
    for link in links:
        for chain in chains:
            first = chain[0][1]
            d = (first[1] - first[0]) / length(first)
            if fold_gap(heading(link[1]), heading(first)) <= math.radians(3) and abs((((link[1][0] + link[1][1]) / 2 - first[0]) * d.conjugate()).imag) <= 400:
                chain.append(link)
                break
        else:
            chains.append([link])
    best = None
    for chain in chains:
        if len(chain) < 2:
            continue
        d = cmath.rect(1, heading(chain[0][1]))
        places = [(p * d.conjugate()).real for _, s in chain for p in s]
        stated, measured = sum(v for v, _ in chain), max(places) - min(places)
        delta = (measured - stated) / stated * 100
        ok = abs(delta) <= 2
        told = min(0.92, 0.70 + 0.08 * min(2, len(chain) - 2) + 0.10 * ok)
        meta = {"links": len(chain), "stated_mm": round(stated, 1), "measured_mm": round(measured, 1), "delta_pct": round(delta, 2), "adds_up": ok}
        if best is None or told > best.confidence:
            best = Match("dimension_chain", told, meta | {"bearing": round(math.degrees(heading(chain[0][1])), 1), "values": [v for v, _ in chain]})
    return best


@symbol("door_schedule", "plan", "door_schedule", 10, "a list of door references")
def door_schedule(c: PlanContext) -> Match | None:
    title = next((t.text for t in c.texts if re.search(SCHEDULE_TITLE, fold_text(t.text))), None)
    refs = sorted({t.text.strip().upper() for t in c.texts if re.fullmatch(SCHEDULE_REFERENCE, fold_text(t.text).strip())})
    if not title or len(refs) < 2:
        return None
    return Match("door_schedule", min(0.90, 0.74 + 0.08 * min(2, (len(refs) - 2) / 4)), {"title": title, "references": refs, "listed": len(refs)})


def level_values(text: str) -> list[tuple[float, bool]]:
    """(metres, with a prefix) of the levels in a label."""
    folded, out = fold_text(text), []
    for pattern, prefixed in ((LEVEL_PREFIXED, True), (LEVEL_SIGNED, False)):
        for m in re.finditer(pattern, folded):
            v = float(m[1].replace(" ", "").replace(",", "."))
            if -60 <= v <= 400:
                out.append((v, prefixed or bool(re.match(LEVEL_PREFIX, m[0].strip()))))
        if out:
            break
    return out


@symbol("level_spot", "plan", "level", 10, "spot levels")
def level_spot(c: PlanContext) -> Match | None:
    told_by = [level_values(t.text) for t in c.texts]
    found = [x for xs in told_by for x in xs]
    levels = sorted({v for v, _ in found})
    if not levels:
        return None
    prefixed = sum(any(p for _, p in xs) for xs in told_by)
    told = min(0.92, 0.62 + 0.10 * min(2, len(levels) - 1) + 0.12 * bool(prefixed))
    return Match("level", told, {"levels_m": levels, "count": len(found), "datum": levels[0], "range": round(levels[-1] - levels[0], 3), "prefixed": prefixed})


@symbol("escape_route", "plan", "escape_route", 10, "routes out with a travel distance")
def escape_route(c: PlanContext) -> Match | None:
    routes = []
    for i, pts in enumerate(c.strokes):
        size = sum(abs(b - a) for a, b in zip(pts, pts[1:], strict=False))
        if len(pts) > 1 and named(c.layer(i), ESCAPE_LAYERS) and size >= 3000 and abs(pts[0] - pts[-1]) > 80:
            routes.append((size / 1000, c.layer(i)))
    if not routes:
        return None
    said = next(((t.text, m) for t in c.texts if re.search(ESCAPE_WORDS, f := fold_text(t.text)) and (m := re.search(ESCAPE_DISTANCE, f))), None)
    stated = float(said[1][1].replace(",", ".")) if said else None
    longest = max(r[0] for r in routes)
    delta = (longest - stated) / stated * 100 if stated else None
    told = min(0.92, 0.72 + 0.10 * min(2, len(routes) - 1) + 0.10 * (stated is not None))
    meta = {"routes": len(routes), "longest_m": round(longest, 2), "stated_m": stated, "delta_pct": None if delta is None else round(delta, 2)}
    return Match("escape_route", told, meta | {"agrees": None if delta is None else abs(delta) <= 10, "layers": sorted({r[1] for r in routes}), "label": said[0] if said else None})


@symbol("revision_cloud", "plan", "revision", 10, "scalloped outlines of a revision")
def revision_cloud(c: PlanContext) -> Match | None:
    clouds = [x for x in c.outlines(12) if named(c.layer(x.stroke), REVISION_LAYERS) and within(x.area, (0.5, 400.0)) and within(x.compact, (0.25, 0.86))]
    if not clouds:
        return None
    tag = next((m[1].upper() for t in c.texts if (m := re.search(REVISION_TAG, fold_text(t.text)))), None)
    told = min(0.90, 0.70 + 0.08 * min(2, len(clouds) - 1) + 0.10 * bool(tag))
    return Match("revision", told, {"clouds": len(clouds), "area": round(sum(x.area for x in clouds), 2), "layers": sorted({c.layer(x.stroke) for x in clouds}), "tag": tag})


def legend_swatches(c: PlanContext) -> tuple[Label | None, list[tuple[Loop, str]]]:
    """The legend's title, and its swatches from top to bottom with their captions."""
    title = next((t for t in c.texts if re.search(LEGEND_TITLE, fold_text(t.text))), None)
    if not title:
        return None, []
    boxes = [x for x in c.loops() if within(x.long, (150.0, 1600.0)) and x.long <= 3 * max(x.short, 1e-9) and x.centre.imag < title.at.imag]
    columns = [[y for y in boxes if abs(y.centre.real - x.centre.real) <= 1.5 * x.long and title.at.imag - y.centre.imag <= 20 * x.long and abs(x.centre.real - title.at.real) <= 20 * x.long and abs(y.long - x.long) <= 0.3 * x.long] for x in boxes]
    column = max(columns, key=len, default=[])
    if len(column) < 2:
        return title, []
    out = []
    for x in sorted(column, key=lambda x: -x.centre.imag):
        right = [t for t in c.texts if t is not title and 0 < t.at.real - x.centre.real <= 6 * x.long and abs(t.at.imag - x.centre.imag) <= x.long]
        if right:
            out.append((x, min(right, key=lambda t: abs(t.at.imag - x.centre.imag)).text))
    return title, out


@symbol("hatch_legend", "plan", "hatch_legend", 10, "swatches with captions")
def hatch_legend(c: PlanContext) -> Match | None:
    title, rows = legend_swatches(c)
    if len(rows) < 2:
        return None
    even = len(rows) < 3 or spread(gaps([x.centre.imag for x, _ in rows])) <= 0.30
    told = min(0.90, 0.72 + 0.08 * min(2, len(rows) - 2) + 0.08 * even)
    return Match("hatch_legend", told, {"title": title.text, "entries": [t for _, t in rows], "count": len(rows)})


def families(rulings: list[Seg]) -> list[dict]:
    """Families of even parallel rulings: angle and spacing."""
    out = []
    for g in parallel_groups(rulings, 6.0):
        d = cmath.rect(1, -heading(g[0]))
        places = sorted((((a + b) / 2) * d).imag for a, b in g)
        steps = [b - a for a, b in zip(places, places[1:], strict=False) if b - a > 1]
        if len(g) < 5 or not steps:
            continue
        typical = median(steps)
        tight = [x for x in steps if abs(x - typical) <= 0.35 * typical]
        if within(typical, (15.0, 400.0)) and len(tight) >= 0.6 * len(steps) and spread(tight) <= 0.35:
            out.append({"angle": round(math.degrees(heading(g[0])), 1), "spacing": round(typical, 1), "rulings": len(g)})
    return sorted(out, key=lambda f: f["angle"])


def _same_family(a: list[dict], b: list[dict]) -> bool:
    if len(a) != len(b) or not a:
        return False
    close = lambda x, y: min(abs(x["angle"] - y["angle"]), 180 - abs(x["angle"] - y["angle"])) <= 8 and abs(x["spacing"] - y["spacing"]) <= 0.3 * max(x["spacing"], y["spacing"])
    return all(any(close(x, y) for y in b) for x in a)


def _components(points: list[Point], cell: float) -> list[list[int]]:
    """Points whose cells touch, as lists of their numbers."""
    cells: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(points):
        cells.setdefault((int(p.real // cell), int(p.imag // cell)), []).append(i)
    out, seen = [], set()
    for start in cells:
        if start in seen:
            continue
        seen.add(start)
        todo, members = [start], []
        while todo:
            x, y = todo.pop()
            members += cells[x, y]
            for n in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in cells and n not in seen:
                    seen.add(n)
                    todo.append(n)
        out.append(sorted(members))
    return out


def region_rulings(c: PlanContext) -> tuple[list[list[Seg]], list[tuple[str, list[Seg]]]]:
    """Rulings of each hatched region of the plan, and those of each legend swatch."""
    _, swatches = legend_swatches(c)
    segs = [(s, (s[0] + s[1]) / 2) for s in c.straight(30.0) if length(s) <= 4000]
    inside = lambda p, box, m=0.0: box[0] - m <= p.real <= box[2] + m and box[1] - m <= p.imag <= box[3] + m
    specimens = [(t, [s for s, p in segs if inside(p, x.box) and length(s) < 0.98 * x.long * 1.5 and all(inside(q, x.box, 1.0) for q in s)]) for x, t in swatches]
    specimens = [(t, [s for s in found if not _on_box(s, x.box)]) for (t, found), (x, _) in zip(specimens, swatches, strict=True)]
    body = [(s, p) for s, p in segs if not any(inside(p, x.box, 1.0) for x, _ in swatches)]
    if len(body) < 12:
        return [], specimens
    steps = []
    for g in parallel_groups([s for s, _ in body], 6.0):
        d = cmath.rect(1, -heading(g[0]))
        steps += [x for x in gaps([(((a + b) / 2) * d).imag for a, b in g])]
    cell = max(2.5 * median(steps), 60.0) if steps else 60.0
    regions = []
    for members in _components([p for _, p in body], cell):
        found = [body[i][0] for i in members]
        if len(found) >= 12 and (spread([length(s) for s in found]) >= 0.08 or len(found) >= 20):
            regions.append(found)
    return regions, specimens


def _on_box(s: Seg, box: tuple) -> bool:
    on = lambda a, b, lo, hi: min(abs(a - lo), abs(a - hi)) < 1 and abs(a - b) < 1
    return on(s[0].real, s[1].real, box[0], box[2]) or on(s[0].imag, s[1].imag, box[1], box[3])


@symbol("hatch_pattern", "plan", "hatch", 5, "hatched regions and what the legend calls them")
def hatch_pattern(c: PlanContext) -> Match | None:
    regions, specimens = region_rulings(c)
    known = [(t, families(s)) for t, s in specimens]
    out = []
    for found in regions:
        f = families(found)
        if not f:
            continue
        angles = [x["angle"] for x in f]
        apart = abs(angles[0] - angles[-1])
        square = len(f) == 2 and min(apart, 180 - apart) > 30
        style = "single" if len(f) == 1 else "cross" if square else "double" if len(f) == 2 else "compound"
        material = next((t for t, g in known if _same_family(f, g)), None)
        xs, ys = [p.real for s in found for p in s], [p.imag for s in found for p in s]
        at = [round((min(xs) + max(xs)) / 2, 1), round((min(ys) + max(ys)) / 2, 1)]
        out.append({"material": material, "style": style, "families": f, "rulings": len(found), "extent": [round(max(xs) - min(xs), 1), round(max(ys) - min(ys), 1)], "at": at})
    if not out:
        return None
    told = sum(r["material"] is not None for r in out)
    confidence = min(0.92, 0.62 + 0.10 * min(2, len(out) - 1) + 0.16 * told / len(out))
    return Match("hatch", confidence, {"regions": out, "count": len(out), "named": told, "legend_entries": len(known)})



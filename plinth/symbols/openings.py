"""Opening symbols: doors, windows, plain gaps.  The best one names an opening."""

from __future__ import annotations

import cmath
import math
from itertools import pairwise
from statistics import mean

from plinth.functions.planar import Seg, coverage_of, is_parallel, length, spread
from plinth.plans.arrangement import Weld
from plinth.symbols.base import Match, OpeningContext, named, positive, symbol, within

# Words in layer names of fire shutters.
FIRE_LAYERS = ("fire", "-fs", "fs-", "pccc", "chong chay", "chongchay", "smoke", "brand", "rf-")


def _along(s: Seg, tol: float = 8.0) -> bool:
    return is_parallel(s[1] - s[0], 1 + 0j, tol)


def _span(s: Seg) -> tuple[float, float]:
    return min(s[0].real, s[1].real), max(s[0].real, s[1].real)


def _cover(segs: list[Seg], width: float) -> float:
    return coverage_of([_span(s) for s in segs], -width / 2, width / 2)


def _offset(s: Seg) -> float:
    return (s[0].imag + s[1].imag) / 2


@symbol("door_swing", "opening", "door", 10, "one leaf with its swing arc")
def door_swing(c: OpeningContext) -> Match | None:
    best = None
    w = c.width
    for a in c.arcs():
        ratio, hinge = a.radius / w, min(abs(a.centre - j) for j in c.jambs)
        if not (45 <= a.span <= 200 and 0.70 <= ratio <= 1.35 and hinge <= 0.40 * w):
            continue
        leaf = any(abs(length(s) - a.radius) <= 0.20 * a.radius and min(abs(p - a.centre) for p in s) <= 0.15 * w for s in c.straight(0.5 * w))
        told = 0.60 + 0.20 * positive(1 - abs(ratio - 1) / 0.35) + 0.10 * positive(1 - hinge / (0.40 * w))
        told = min(0.98, told + 0.05 * positive(1 - abs(a.span - 90) / 90) + 0.05 * leaf)
        meta = {"leaf_width": round(a.radius, 1), "swing_deg": round(a.span, 1), "hinge_offset": round(hinge, 1), "leaf_line": leaf, "panels": 1}
        if best is None or told > best.confidence:
            best = Match("door", told, meta)
    return best


@symbol("door_double", "opening", "door", 20, "two leaves, an arc on either jamb")
def door_double(c: OpeningContext) -> Match | None:
    w, sides = c.width, []
    for jamb in c.jambs:
        near = [a for a in c.arcs() if 45 <= a.span <= 200 and 0.35 <= a.radius / w <= 0.68 and abs(a.centre - jamb) <= 0.25 * w]
        if not near:
            return None
        sides.append(min(near, key=lambda a: abs(a.centre - jamb)))
    left, right = sides
    if left.stroke == right.stroke:
        return None
    sym, fill = abs(left.radius - right.radius) / max(left.radius, right.radius), (left.radius + right.radius) / w
    if sym > 0.25 or not 0.75 <= fill <= 1.35:
        return None
    told = min(0.97, 0.72 + 0.15 * (1 - sym / 0.25) + 0.10 * positive(1 - abs(fill - 1) / 0.35))
    return Match("door", told, {"leaf_width": round((left.radius + right.radius) / 2, 1), "panels": 2, "symmetry": round(1 - sym, 3)})


@symbol("door_sliding", "opening", "door", 5, "a leaf beside the wall line")
def door_sliding(c: OpeningContext) -> Match | None:
    w, reach = c.width, max(1.6 * c.thickness, 60.0)
    held = [s for s in c.straight(0.70 * w) if _along(s) and length(s) <= 1.60 * w and abs(_offset(s)) <= reach and _cover([s], w) >= 0.5]
    if not held:
        return None
    ys = [_offset(s) for s in held]
    if (min(ys) < -1 and max(ys) > 1) or (len(held) >= 2 and min(map(abs, ys)) <= 1):
        return None
    leaf = max(held, key=length)
    lo, hi = _span(leaf)
    over, y = max(0.0, -w / 2 - lo) + max(0.0, hi - w / 2), abs(_offset(leaf))
    told = 0.50 + 0.15 * positive(1 - abs(length(leaf) / w - 1) / 0.6) + 0.15 * min(1, over / (0.25 * w)) + 0.10 * min(1, y / max(0.5 * c.thickness, 30.0))
    return Match("door", min(0.9, told), {"leaf_width": round(length(leaf), 1), "offset": round(y, 1), "overrun": round(over, 1), "operation": "sliding", "panels": len(held)})


def facet_chain(c: OpeningContext, least: float, most: int, snap: float = 40.0) -> list[Seg] | None:
    """The first chain of facets from jamb to jamb: ends weld within ``snap``, ways are tried in
    the order in which nodes were met."""
    drawn = [(a, b) for pts in c.strokes for a, b in pairwise(pts) if abs(b - a) >= least]
    reach = max(0.28 * c.width, snap)
    if any(all(abs(p - j) > reach for s in drawn for p in s) for j in c.jambs):  # nodes are ends of facets
        return None
    weld = Weld(snap)
    joined = [(weld(a), weld(b)) for a, b in drawn]
    nodes, ways = weld.points, {}
    for u, v in joined + [(v, u) for u, v in joined]:
        if u != v:
            ways.setdefault(u, set()).add(v)
    if not nodes:
        return None
    start, goal = (min(range(len(nodes)), key=lambda i: abs(nodes[i] - j)) for j in c.jambs)
    if start == goal or any(abs(nodes[i] - j) > reach for i, j in zip((start, goal), c.jambs, strict=True)):
        return None
    todo = [[start]]
    while todo:
        path = todo.pop()
        if path[-1] == goal:
            if len(path) > 2:
                return [(nodes[a], nodes[b]) for a, b in zip(path, path[1:], strict=False)]
            continue
        if len(path) <= most:
            todo += [[*path, n] for n in sorted(ways.get(path[-1], ()), reverse=True) if n not in path]
    return None


@symbol("door_folding", "opening", "door", 25, "a concertina of equal leaves")
def door_folding(c: OpeningContext) -> Match | None:
    chain = facet_chain(c, 0.08 * c.width, 8)
    if not chain or not 3 <= len(chain) <= 8:
        return None
    leaves = [length(s) for s in chain]
    leaf, cv = mean(leaves), spread(leaves)
    dx, dy = [(b - a).real for a, b in chain], [(b - a).imag for a, b in chain]
    turns = all(abs(y) >= 0.12 * leaf for y in dy) and all(a * b < 0 for a, b in zip(dy, dy[1:], strict=False))
    forward = all(x > 0 for x in dx) or all(x < 0 for x in dx)
    ys = [p.imag for s in chain for p in s]
    fold, run = max(ys) - min(ys), abs(sum(dx))
    if cv > 0.22 or not turns or not forward or not 0.12 * leaf <= fold <= 1.10 * leaf or run < 0.75 * c.width:
        return None
    told = min(0.95, 0.74 + 0.12 * (1 - cv / 0.22) + 0.06 * min(1, (len(chain) - 3) / 3) + 0.05 * min(1, run / c.width))
    return Match("door", told, {"operation": "folding", "panels": len(chain), "leaf_width": round(leaf, 1), "fold_depth": round(fold, 1), "leaf_spread": round(cv, 3)})


@symbol("door_revolving", "opening", "door", 35, "spokes about the middle of the opening")
def door_revolving(c: OpeningContext) -> Match | None:
    w, spokes = c.width, []
    for s in c.straight(0.1 * w):
        ends = sorted(s, key=abs)
        if abs(ends[0]) <= 0.18 * w and abs(length(s) - w / 2) <= 0.25 * w / 2:
            spokes.append((math.degrees(cmath.phase(ends[1] - ends[0])) % 360, length(s)))
        elif abs((s[0] + s[1]) / 2) <= 0.18 * w and abs(length(s) / 2 - w / 2) <= 0.25 * w / 2:
            turn = math.degrees(cmath.phase(s[1] - s[0])) % 360
            spokes += [(turn, length(s) / 2), ((turn + 180) % 360, length(s) / 2)]
    merged: list[tuple[float, float]] = []
    for turn, size in sorted(spokes):
        if not any(min(abs(turn - t) % 360, 360 - abs(turn - t) % 360) <= 8 for t, _ in merged):
            merged.append((turn, size))
    n = len(merged)
    if not 3 <= n <= 6:
        return None
    turns = [t for t, _ in merged]
    steps = [(b - a) % 360 for a, b in zip(turns, turns[1:] + turns[:1], strict=True)]
    error = max(abs(x - 360 / n) for x in steps)
    if error > 18:
        return None
    drum = next((a for a in c.arcs() if a.span >= 120 and abs(a.centre) <= 0.18 * w and abs(a.radius - w / 2) <= 0.25 * w / 2), None)
    told = min(0.95, 0.62 + 0.18 * (drum is not None) + 0.08 * (1 - error / 18) + 0.05 * (n in (3, 4)))
    meta = {"operation": "revolving", "panels": n, "drum_diameter": round(2 * (drum.radius if drum else w / 2), 1), "leaf_length": round(mean(s for _, s in merged), 1)}
    return Match("door", told, meta | {"drum_drawn": drum is not None, "spacing_error": round(error, 1)})


@symbol("door_roller", "opening", "door", 45, "a slatted or coiled curtain")
def door_roller(c: OpeningContext) -> Match | None:
    w = c.width
    slats = 0
    for pts in c.strokes:
        steps = [(a, b) for a, b in zip(pts, pts[1:], strict=False) if abs(b - a) > 1e-6]
        ys = [(b - a).imag for a, b in steps]
        teeth = sum(a * b < 0 for a, b in zip([y for y in ys if abs(y) > 1], [y for y in ys if abs(y) > 1][1:], strict=False))
        if teeth >= 8 and steps and max(abs(b - a) for a, b in steps) <= 0.14 * w and _cover([(pts[0], pts[-1])], w) >= 0.7:
            slats = max(slats, teeth)
    curtain = any(_along(s) and _cover([s], w) >= 0.7 for s in c.straight(0.7 * w))
    barrel = next((a for a in c.arcs() if a.span >= 180 and 60 <= a.radius <= min(450, 0.30 * w) and min(abs(a.centre - j) for j in c.jambs) <= 0.30 * w), None)
    if not slats and not (curtain and barrel):
        return None
    told = min(0.97, 0.91 + 0.03 * bool(slats) + 0.03 * (barrel is not None))
    return Match("door", told, {"operation": "roller", "clear_width": round(w, 1), "corrugated": bool(slats), "slats": slats, "barrel_radius": round(barrel.radius, 1) if barrel else None})


@symbol("door_fire_shutter", "opening", "door", 50, "a roller shutter on a fire layer")
def door_fire_shutter(c: OpeningContext) -> Match | None:
    layer = next((x for x in c.layers if named(x, FIRE_LAYERS, fold=False)), None)
    rolled = door_roller(c) if layer else None
    if not rolled:
        return None
    return Match("door", min(0.97, rolled.confidence + 0.03), rolled.meta | {"operation": "fire_shutter", "fire_layer": layer, "rated": True})


def _glazing(c: OpeningContext, least: float, reach: float) -> list[Seg]:
    return [s for s in c.straight(least * c.width) if _along(s) and abs(_offset(s)) <= reach and _cover([s], c.width) >= least]


@symbol("window", "opening", "window", 10, "glazing lines in the wall")
def window(c: OpeningContext) -> Match | None:
    panes = _glazing(c, 0.55, max(1.1 * c.thickness, 40.0))
    ys = sorted(_offset(s) for s in panes)
    if len(panes) < 2 or (len(panes) == 2 and not ys[0] < 0 < ys[1]):
        return None
    cover = mean(_cover([s], c.width) for s in panes)
    told = min(0.95, 0.55 + 0.10 * min(2, len(panes) - 2) + 0.25 * min(1, cover))
    return Match("window", told, {"glazing_lines": len(panes), "coverage": round(cover, 3), "sill_width": round(c.width, 1)})


@symbol("window_bay", "opening", "window", 30, "facets that project from the wall")
def window_bay(c: OpeningContext) -> Match | None:
    chain = facet_chain(c, 0.10 * c.width, 9)
    if not chain:
        return None
    w = c.width
    ys = [p.imag for s in chain for p in s]
    side = 1 if max(ys) >= -min(ys) else -1
    depth, run = max(side * y for y in ys), sum(map(length, chain))
    inner = [side * s[1].imag for s in chain[:-1]]
    if not max(250.0, 1.5 * c.thickness) <= depth <= 1.5 * w or min(side * y for y in ys) < -max(0.1 * depth, c.thickness) or run <= 1.05 * w:
        return None
    if any(y < 0.4 * depth for y in inner):
        return None
    n = len(chain)
    square = n == 3 and all(is_parallel(s[1] - s[0], 1j, 10) for s in (chain[0], chain[-1]))
    style = "triangular" if n == 2 else "box" if square else "canted" if n == 3 else "bow"
    told = min(0.95, 0.70 + 0.12 * min(1, depth / (0.35 * w)) + 0.10 * min(1, (run / w - 1) / 0.5) + 0.05 * (n in (3, 5)))
    return Match("window", told, {"style": style, "facets": n, "projection": round(depth, 1), "sill_width": round(w, 1), "glazed_run": round(run, 1)})


@symbol("window_corner", "opening", "window", 40, "glazing that turns a corner")
def window_corner(c: OpeningContext) -> Match | None:
    end = c.flush_end
    if not c.bridged or not end or c.arcs(60.0):
        return None
    w, jamb = c.width, complex(end * c.width / 2, 0)
    segs = [(a, b) for pts in c.strokes for a, b in zip(pts, pts[1:], strict=False) if abs(b - a) > 1]
    panes = [s for s in segs if _along(s) and abs(_offset(s)) <= max(1.1 * c.thickness, 60.0) and _cover([s], w) >= 0.5]
    reach = max(0.25 * w, 2 * c.thickness)
    returns = [s for s in segs if is_parallel(s[1] - s[0], 1j, 10) and length(s) >= max(400.0, 2 * c.thickness) and abs(s[0].real - jamb.real) <= reach and min(abs(s[0].imag), abs(s[1].imag)) <= reach]
    if not panes or not returns:
        return None
    leg = max(map(length, returns))
    told = min(0.97, 0.88 + 0.05 * (len(panes) >= 2) + 0.04 * min(1, leg / max(w, 1)))
    return Match("window", told, {"style": "corner", "leg": round(w, 1), "return": round(leg, 1), "glazing_lines": len(panes), "note": "the other leg is an opening of its own"})


@symbol("curtain_wall", "opening", "window", 45, "a long glazed run with mullions")
def curtain_wall(c: OpeningContext) -> Match | None:
    w = c.width
    panes = _glazing(c, 0.7, max(1.1 * c.thickness, 60.0))
    if w < 2500 or len(panes) < 2:
        return None
    xs: list[float] = []
    for s in sorted(segments_across(c), key=lambda s: s[0].real):
        x = (s[0].real + s[1].real) / 2
        if abs(x) < w / 2 - 50 and (not xs or x - xs[-1] > 50):
            xs.append(x)
    if len(xs) < 3:
        return None
    steps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
    module, cv = mean(steps), spread(steps)
    if not within(module, (600.0, 2200.0)) or cv > 0.25:
        return None
    told = min(0.97, 0.92 + 0.05 * (1 - cv / 0.25) * min(1, len(xs) / 5))
    return Match("window", told, {"style": "curtain_wall", "run": round(w, 1), "mullions": len(xs), "module": round(module, 1), "module_spread": round(cv, 3), "glazing_lines": len(panes)})


def segments_across(c: OpeningContext) -> list[Seg]:
    """Segments across the wall that lie in it."""
    segs = [(a, b) for pts in c.strokes for a, b in zip(pts, pts[1:], strict=False)]
    return [s for s in segs if is_parallel(s[1] - s[0], 1j, 8) and 0.3 * c.thickness <= length(s) <= 2.5 * c.thickness and max(abs(s[0].imag), abs(s[1].imag)) <= 1.5 * c.thickness]


@symbol("opening_plain", "opening", "opening", -10, "a gap with nothing drawn in it")
def opening_plain(c: OpeningContext) -> Match | None:
    spans = any(_along(s) and abs(_offset(s)) <= max(1.6 * c.thickness, 60.0) and _cover([s], c.width) >= 0.5 for s in c.straight(0.5 * c.width))
    if c.width > 3001 or c.arcs() or spans:
        return None
    return Match("opening", 0.30 if c.width >= 700 else 0.20, {"clear_width": round(c.width, 1), "reason": "no symbol is drawn in the gap"})

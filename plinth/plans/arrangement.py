"""The planar arrangement of wall centre lines: vertices, darts and faces of one plan."""

from __future__ import annotations

import cmath
import math
from dataclasses import dataclass, field

from plinth.functions.planar import EPS, Point, Seg, cross, polygon_area

#: Points within this many millimetres are one vertex; shorter pieces are dropped.
WELD = 30.0


@dataclass
class Dart:
    origin: int
    dest: int
    wall: int
    face: int = -1
    next: int = -1


@dataclass
class Face:
    darts: list[int]
    ring: list[Point]
    area: float

    @property
    def outer(self) -> bool:
        return self.area <= 0


@dataclass
class Arrangement:
    vertices: list[Point] = field(default_factory=list)
    darts: list[Dart] = field(default_factory=list)
    faces: list[Face] = field(default_factory=list)

    def twin(self, dart: int) -> int:
        return dart ^ 1

    def neighbours(self, face: int) -> dict[int, list[int]]:
        """Faces across this face's edges, each with the darts of this face that they share."""
        found: dict[int, list[int]] = {}
        for d in self.faces[face].darts:
            found.setdefault(self.darts[self.twin(d)].face, []).append(d)
        found.pop(face, None)
        return found


class Weld:
    """First come, first kept: a point takes the nearest earlier point within reach."""

    def __init__(self, reach: float):
        self.reach, self.points, self.cells, self.own = reach, [], {}, {}

    def __call__(self, p: Point) -> int:
        if (first := self.own.get(p)) is not None:  # a kept point once more: none is nearer
            return first
        reach, cells = self.reach, self.cells
        cx, cy = int(p.real // reach), int(p.imag // reach)
        least, best = reach, -1
        for x in (cx - 1, cx, cx + 1):
            for y in (cy - 1, cy, cy + 1):
                for i, q in cells.get((x, y), ()):
                    far = abs(q - p)
                    if far < least or (far == least and (best < 0 or i < best)):
                        least, best = far, i
        if best >= 0:
            return best
        self.own[p] = n = len(self.points)
        self.points.append(p)
        cells.setdefault((cx, cy), []).append((n, p))
        return n


def split(segs: list[Seg], tol: float = WELD) -> list[tuple[Seg, int]]:
    """Pieces of the segments between all crossings and T-junctions, with their segment."""
    cuts: list[set[float]] = [{0.0, 1.0} for _ in segs]
    size = [abs(b - a) for a, b in segs]
    for i, (a, b) in enumerate(segs):
        for j, (c, d) in enumerate(segs[i + 1 :], i + 1):
            det = cross(b - a, d - c)
            if abs(det) < EPS:
                continue
            s, t = cross(c - a, d - c) / det, cross(c - a, b - a) / det
            if -1e-7 <= s <= 1 + 1e-7 and -1e-7 <= t <= 1 + 1e-7:
                for k, x in ((i, s), (j, t)):
                    if tol < x * size[k] < size[k] - tol:
                        cuts[k].add(round(x, 9))
    for i, (a, b) in enumerate(segs):
        if size[i] < EPS:
            continue
        for j, other in enumerate(segs):
            for p in other if i != j else ():
                t = ((p - a).conjugate() * (b - a)).real / size[i] ** 2
                if abs(a + (b - a) * t - p) <= tol and tol < t * size[i] < size[i] - tol:
                    cuts[i].add(round(t, 9))
    out = []
    for i, (a, b) in enumerate(segs):
        marks = sorted(cuts[i])
        for s, t in zip(marks, marks[1:], strict=False):
            if (t - s) * size[i] > tol:
                out.append(((a + (b - a) * s, a + (b - a) * t), i))
    return out


def arrange(segs: list[Seg], tol: float = WELD) -> Arrangement:
    """Faces of the segments' arrangement; a segment's index is the wall of its darts."""
    weld, edges = Weld(tol), {}
    for (a, b), wall in split(segs, tol):
        u, v = weld(a), weld(b)
        if u != v:
            edges.setdefault((min(u, v), max(u, v)), (u, v, wall))
    alive = dict(edges)
    while True:  # edges that lead nowhere
        degree: dict[int, int] = {}
        for u, v in alive:
            degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
        loose = [k for k in alive if degree[k[0]] == 1 or degree[k[1]] == 1]
        if not loose:
            break
        for k in loose:
            del alive[k]
    plan = Arrangement(weld.points)
    for u, v, wall in alive.values():
        plan.darts += [Dart(u, v, wall), Dart(v, u, wall)]
    around: dict[int, list[int]] = {}
    for i, d in enumerate(plan.darts):
        around.setdefault(d.origin, []).append(i)
    turn = {}
    for darts in around.values():
        darts.sort(key=lambda i: cmath.phase(plan.vertices[plan.darts[i].dest] - plan.vertices[plan.darts[i].origin]) % math.tau)
        turn |= {d: darts[k - 1] for k, d in enumerate(darts)}
    for i, d in enumerate(plan.darts):
        d.next = turn[plan.twin(i)]
    for i, d in enumerate(plan.darts):
        if d.face >= 0:
            continue
        walk, at = [], i
        while plan.darts[at].face < 0:
            plan.darts[at].face = len(plan.faces)
            walk.append(at)
            at = plan.darts[at].next
        ring = [plan.vertices[plan.darts[k].origin] for k in walk]
        plan.faces.append(Face(walk, ring, polygon_area(ring)))
    return plan

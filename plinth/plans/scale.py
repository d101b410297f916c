"""Millimetres a point of one plan, from what the sheet says, in a fixed order of trust."""

from __future__ import annotations

import math
from dataclasses import dataclass

from plinth.functions.planar import Seg, arc_span, fit_circle, fold_gap, heading, length, mode_cluster, point_seg_distance, project_param
from plinth.functions.words import DIMENSION, RATIO, parse_scale

POINT_MM = 25.4 / 72
# Plausible scales, and the width a door leaf is taken to have.
LEAST, MOST, DOOR_MM = 1.0, 200.0, 900.0
DEFAULT_RATIO = 50


@dataclass(frozen=True)
class Scale:
    mm_per_pt: float
    source: str
    confidence: float
    support: int = 0
    detail: str = ""

    @property
    def ratio(self) -> float:
        return self.mm_per_pt / POINT_MM

    def row(self) -> dict:
        return {"mm_per_pt": round(self.mm_per_pt, 6), "source": self.source, "confidence": round(self.confidence, 3), "support": self.support, "detail": self.detail, "drawing_scale": round(self.ratio, 3)}


def from_dimensions(segs: list[Seg], texts: list[dict]) -> Scale | None:
    """The commonest ratio of a written dimension to the nearest parallel line beside it."""
    ratios = []
    for t in texts:
        m = DIMENSION.match(t["text"].strip())
        if not m or not 300 <= int(m[1]) <= 50_000:
            continue
        at, reach = complex(t["x"], t["y"]), max(4 * t["height"], 10.0)
        best = None
        for s in segs:
            if length(s) < 5 or fold_gap(heading(s), t["angle"] % math.pi) > math.radians(6) or not 0.02 <= project_param(at, s) <= 0.98:
                continue
            d, ratio = point_seg_distance(at, s), int(m[1]) / length(s)
            if d <= reach and LEAST <= ratio <= MOST and (best is None or d < best[0]):
                best = (d, ratio)
        if best:
            ratios.append(best[1])
    value, support = mode_cluster(ratios, 0.02)
    return Scale(value, "dimension", min(0.98, 0.55 + 0.15 * support), support, f"{support} dimension(s) agree") if support else None


def from_title(texts: list[dict]) -> Scale | None:
    for t in texts:
        if (m := RATIO.search(t["text"])) and 5 <= int(m[1]) <= 500:
            return Scale(int(m[1]) * POINT_MM, "titleblock", 0.6, 1, t["text"])
    return None


def from_doors(primitives: list[dict]) -> Scale | None:
    """Arcs of door leaves, the commonest radius taken for a usual leaf."""
    radii = []
    for p in primitives:
        pts = p["points"]
        if p["closed"] or len(pts) < 5 or not (c := fit_circle(pts)):
            continue
        if c[1] > 0 and c[2] / c[1] <= 0.02 and arc_span(pts, c[0]) >= 0.6:
            radii.append(c[1])
    r, support = mode_cluster(radii, 0.05)
    return Scale(DOOR_MM / r, "door", 0.35, support, f"{support} arc(s)") if support and LEAST <= DOOR_MM / r <= MOST else None


def find_scale(primitives: list[dict], segs: list[Seg], texts: list[dict], explicit: str | None = None) -> Scale:
    """An explicit scale that can't be read falls through to what the sheet says."""
    if value := parse_scale(explicit):
        return Scale(value, "explicit", 1.0, 1, str(explicit))
    return from_dimensions(segs, texts) or from_title(texts) or from_doors(primitives) or Scale(DEFAULT_RATIO * POINT_MM, "default", 0.1, 0, "nothing on the sheet tells a scale")

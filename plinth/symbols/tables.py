"""The symbol library on tables: one row for each room, plan or opening, with its strokes.

All take ``id`` and ``strokes`` (millimetres), and may have ``layers`` and ``filled`` (one value a
stroke) and ``texts(text, x, y, height)``; rooms also ``polygon`` and ``category``; openings, in the
opening's frame, ``width`` and ``thickness``.  A missing or null column counts as empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.planar import bbox
from plinth.symbols.base import Label, OpeningContext, PlanContext, RoomContext, all_matches, best_match

MATCH = "id string, symbol string, kind string, confidence double, meta string"
MADE = pa.schema([(c, pa.float64() if c == "confidence" else pa.string()) for c in ("id", "symbol", "kind", "confidence", "meta")])
SCOPES = ("opening", "room", "plan")
COLUMNS = ("id", "strokes", "layers", "filled", "texts", "polygon", "category", "width", "thickness")


def _points(points) -> list[complex]:
    return [complex(p["x"], p["y"]) for p in points]


def _context(scope: str, row: dict):
    strokes = [_points(s) for s in row["strokes"]]
    layers, filled = list(row["layers"]) or [None] * len(strokes), list(row["filled"])
    if scope == "opening":
        return OpeningContext(row["width"], row["thickness"], strokes, layers)
    if scope == "room":
        return RoomContext(strokes, layers, filled, _points(row["polygon"]), row["category"] or "unknown", [t["text"] for t in row["texts"]])
    everywhere = [p for s in strokes for p in s]
    texts = [Label(t["text"], complex(t["x"], t["y"]), t["height"]) for t in row["texts"]]
    return PlanContext(strokes, layers, filled, texts, bbox(everywhere) if everywhere else (0.0, 0.0, 0.0, 0.0))


def _detect(scope: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import plinth.symbols  # noqa: F401  (registers the detectors in the worker)

        for rows in batches:
            out = []
            for row in rows.to_pylist():
                full = {c: row.get(c) for c in COLUMNS}
                full |= {c: [] for c in ("strokes", "layers", "filled", "texts", "polygon") if full[c] is None}
                context = _context(scope, full)
                hits = filter(None, [best_match(context)]) if scope == "opening" else all_matches(context, scope)
                out += [(row["id"], s.id, m.kind, m.confidence, json.dumps(m.meta, ensure_ascii=False)) for s, m in hits]
            yield pa.RecordBatch.from_pylist([dict(zip(MADE.names, m, strict=True)) for m in out], MADE)

    return run


def symbols_of(contexts: DataFrame, scope: str) -> DataFrame:
    """(id, symbol, kind, confidence, meta): the best symbol of an opening, all of a room or plan."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {', '.join(SCOPES)}")
    known = [F.col(c).cast("string").alias(c) if c == "id" else F.col(c) for c in COLUMNS if c in contexts.columns]
    return contexts.select(*known).mapInArrow(_detect(scope), MATCH)

"""Reads drawings into tables: one row per primitive and per text, keyed by plan_id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
PRIMITIVE = f"points {POINTS}, closed boolean, stroked boolean, filled boolean, width double, layer string, color struct<r:double,g:double,b:double>"
TEXT = "text string, x double, y double, height double, angle double, layer string"
PAGE = "plan_id string, box struct<x0:double,y0:double,x1:double,y1:double>, error string, primitives array<struct<prim_id:int,{}>>, texts array<struct<text_id:int,{}>>"


def _typed(columns: str) -> str:
    return ",".join(part.replace(" ", ":", 1) for part in columns.split(", "))


PAGE = PAGE.format(_typed(PRIMITIVE), _typed(TEXT))


_reals = lambda names: pa.struct([(c, pa.float64()) for c in names])
_list = lambda *fields: pa.list_(pa.struct(list(fields)))
#: PAGE as Arrow has it, so that nested rows are not converted one by one.
MADE = pa.schema(
    [
        ("plan_id", pa.string()), ("box", _reals(("x0", "y0", "x1", "y1"))), ("error", pa.string()),
        ("primitives", _list(
            ("prim_id", pa.int32()), ("points", pa.list_(_reals("xy"))), ("closed", pa.bool_()), ("stroked", pa.bool_()), ("filled", pa.bool_()),
            ("width", pa.float64()), ("layer", pa.string()), ("color", _reals("rgb")),
        )),
        ("texts", _list(("text_id", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("height", pa.float64()), ("angle", pa.float64()), ("layer", pa.string()))),
    ]
)
#: Decoded pages that are held before they are given back.
PAGES_HELD = 64


def _decode(page: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plinth.sources.pdf import DEFAULT_BOX, decode_page

        files = (list(zip(*(pa.array(batch[c]).to_pylist() for c in ("path", "content")), strict=True)) for batch in batches)
        for rows in (batch[at : at + PAGES_HELD] for batch in files for at in range(0, len(batch), PAGES_HELD)):
            out = []
            for path, content in rows:
                error, box, primitives, texts = None, DEFAULT_BOX, [], []
                try:
                    found = decode_page(bytes(content), page)
                    box, primitives, texts = found.box, found.primitives, found.texts
                except (ValueError, RecursionError) as e:
                    error = str(e)
                out.append(
                    {
                        "plan_id": f"{path}#{page}",
                        "box": dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)),
                        "error": error,
                        "primitives": [{"prim_id": i, **p} for i, p in enumerate(primitives)],
                        "texts": [{"text_id": i, **t} for i, t in enumerate(texts)],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, MADE)

    return run


def decode(files: DataFrame, page: int = 0) -> DataFrame:
    """``files(path, content)`` as one row per page; ``error`` says why a file has no geometry."""
    return files.select("path", "content").mapInArrow(_decode(page), PAGE)


def read_drawings(spark: SparkSession, path: str, page: int = 0) -> DataFrame:
    """Pages of a drawing file, a folder or a glob of them."""
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path), page)


def primitives_of(pages: DataFrame) -> DataFrame:
    return pages.select("plan_id", F.inline("primitives"))


def texts_of(pages: DataFrame) -> DataFrame:
    return pages.select("plan_id", F.inline("texts"))


def layer_histogram(primitives: DataFrame) -> DataFrame:
    """(plan_id, layer, n): primitives of each layer, "" for none."""
    return primitives.groupBy("plan_id", F.coalesce("layer", F.lit("")).alias("layer")).agg(F.count("*").alias("n"))

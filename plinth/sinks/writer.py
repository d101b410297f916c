"""Writes documents and files of plans, from the executors, one file per plan and format."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.sinks.documents import geojson_documents, json_documents
from plinth.sinks.files import render

FORMATS = ("json", "geojson", "ifc", "svg", "gif")


def file_name(plan_id: str, extension: str) -> str:
    """A plan's file name: the drawing's name, and its page unless it is the first."""
    path, _, page = plan_id.partition("#")
    stem = re.sub(r"\.pdf$", "", path.rstrip("/").rpartition("/")[2], flags=re.I) or "plan"
    return f"{re.sub(r'[^A-Za-z0-9._-]', '_', stem)}{'' if page in ('', '0') else f'-p{page}'}.{extension}"


def outputs(models: DataFrame, formats: list[str], origin: tuple[float, float] | None = None, rotation_deg: float = 0.0) -> DataFrame:
    """(plan_id, format, content) of all formats."""
    if bad := set(formats) - set(FORMATS):
        raise ValueError(f"unknown formats {sorted(bad)}")
    parts = []
    if "json" in formats:
        parts.append(json_documents(models).select("plan_id", F.lit("json").alias("format"), F.col("document").cast("binary").alias("content")))
    if "geojson" in formats:
        parts.append(geojson_documents(models, origin, rotation_deg).select("plan_id", F.lit("geojson").alias("format"), F.col("document").cast("binary").alias("content")))
    if files := [f for f in formats if f in ("ifc", "svg", "gif")]:
        parts.append(render(models, files))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save(rows: DataFrame, folder: str) -> None:
    """Each content under its plan's name, through pyarrow's file systems; a file is moved into
    place when it is whole, so a repeated task does no harm."""

    def run(part: Iterator) -> None:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base, recursive=True)
        for r in part:
            name, waiting = f"{base}/{file_name(r['plan_id'], r['format'])}", f"{base}/.{uuid.uuid4().hex}"
            with files.open_output_stream(waiting, compression=None) as out:
                out.write(bytes(r["content"]))
            files.move(waiting, name)

    rows.foreachPartition(run)

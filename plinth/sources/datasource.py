"""``spark.read.format("plan_pdf").load(path)``: the pages of drawings, one partition per file.

The path is a file or a folder that driver and executors share, read through pyarrow's file
systems; for paths that only Spark opens use ``reader.read_drawings``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plinth.sources.reader import PAGE


@dataclass
class File(InputPartition):
    path: str


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PlanReader(DataSourceReader):
    def __init__(self, path: str, page: int):
        self.path, self.page = path, page

    def partitions(self) -> list[File]:
        from pyarrow import fs

        files, base = _filesystem(self.path)
        if files.get_file_info(base).type == fs.FileType.File:
            return [File(base)]
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(".pdf")]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyspark.sql import Row

        from plinth.sources.pdf import DEFAULT_BOX, decode_page

        files, _ = _filesystem(self.path)
        with files.open_input_stream(partition.path) as f:
            data = f.read()
        error, box, primitives, texts = None, DEFAULT_BOX, [], []
        try:
            page = decode_page(data, self.page)
            box, primitives, texts = page.box, page.primitives, page.texts
        except (ValueError, RecursionError) as e:
            error = str(e)
        point = lambda p: Row(x=p["x"], y=p["y"])
        shapes = [Row(prim_id=i, points=[point(q) for q in p["points"]], closed=p["closed"], stroked=p["stroked"], filled=p["filled"], width=p["width"], layer=p["layer"], color=Row(**p["color"])) for i, p in enumerate(primitives)]
        said = [Row(text_id=i, **t) for i, t in enumerate(texts)]
        yield (f"{partition.path}#{self.page}", Row(**dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))), error, shapes, said)


class PlanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plan_pdf"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PlanReader:
        return PlanReader(self.options["path"], int(self.options.get("page", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlanSource)

"""A stream of drawing files: each file that arrives becomes a plan model.

Plans are independent of each other, so the stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plinth.plans.extract import extract
from plinth.sources.reader import decode

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_models(spark: SparkSession, folder: str, page: int = 0, scale: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return extract(decode(files, page), scale)


def write_models(models: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the models that are there now to a Parquet table, each file once."""
    return models.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""What the corpus operators share: tables, the shared folder, written cuts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rules of the corpus operators see it.
SPACE = " \t\n\x0b\f\r"
#: Rows of one Arrow batch where whole texts go to Python, so that a batch of long texts stays small.
TEXT_BATCH = 256
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local_shared: dict[str, str] = {}
_written: dict[int, tuple[DataFrame, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's
    checkpoint folder; a temporary folder only for a local master where neither is set."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    base = base or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_shared.setdefault(context.applicationId, tempfile.mkdtemp(prefix="plinth-"))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plinth/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here, and
    a lost executor costs a reread only."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def discard(*cuts: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in cuts:
        _, path = _written.pop(id(df))
        _delete(df.sparkSession, path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches of what runs hold so many rows at most."""
    before = spark.conf.get(ARROW_ROWS, None)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, before)


def text_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch before whole texts go to Python.  Spark reads the setting
    when a query runs, which may be after an operator has returned it, so it stays set."""
    now = int(spark.conf.get(ARROW_ROWS, "10000"))
    if now <= 0 or now > TEXT_BATCH:
        spark.conf.set(ARROW_ROWS, str(TEXT_BATCH))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def int_array(values) -> Column:
    """A constant array<int>, folded to one literal (an array of that many columns would not be)."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)`` as (node, component): component is the
    smallest node of it.  Nodes without an edge to another node don't appear.

    Alternates large-star and small-star steps until the edges no longer change, so a hub is
    never gathered into one row; each step is an aggregate and an equi-join, written to the
    shared folder.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst")
    e = cut(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while True:
        # done when every node has one edge and none is both an end and a root
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).collect()[0]
        if n == nodes and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large, "large-star")
        before = e
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(before, large)

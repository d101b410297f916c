"""Order-dependent rules as rounds of joins: what a loop over rows in order would accept.

A greedy loop looks at rows in order and keeps a row unless a kept one strikes it.  Rows whose
stronger rivals are all decided can be decided at once, so each round decides many; the results
are those of the loop.  Every round is joins and aggregates whose result is written in the shared
folder (spark.checkpoint.dir), so that lineage stays short.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master without it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(context.applicationId, tempfile.mkdtemp(prefix="plinth-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read back, so that the lineage of an iteration ends.

    Files say little about the rows that come of them (they are packed, and cells or ends are exploded
    later), so what joins them is shuffled and never sent through the driver.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/plinth-rounds/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ends(pairs: DataFrame, keys: list[str], end: str, name: str) -> DataFrame:
    return pairs.select(*keys, F.col(end).alias(name))


def suppress(rows: DataFrame, rivals: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows(key..., name, ...)`` without those that a kept row strikes.

    ``rivals(key..., strong, weak)`` says that ``strong``, if kept, strikes ``weak``; ``strong``
    comes before ``weak`` in the order of the loop, so rivals form no ring.
    """
    open_pairs = settled(rivals.select(*keys, "strong", "weak").distinct())
    struck = []
    while not open_pairs.isEmpty():
        # nobody undecided is stronger than these, so they are kept and strike
        kept = _ends(open_pairs, keys, "strong", "one").join(_ends(open_pairs, keys, "weak", "one"), [*keys, "one"], "left_anti").distinct()
        out = settled(open_pairs.join(kept.withColumnRenamed("one", "strong"), [*keys, "strong"], "left_semi").select(*keys, F.col("weak").alias("one")).distinct())
        struck.append(out)
        both = reduce(lambda d, end: d.join(out.withColumnRenamed("one", end), [*keys, end], "left_anti"), ("weak", "strong"), open_pairs)
        open_pairs = settled(both.join(kept.withColumnRenamed("one", "strong"), [*keys, "strong"], "left_anti"))
    if not struck:
        return rows
    return rows.join(_all(struck).withColumnRenamed("one", name), [*keys, name], "left_anti")


def match(pairs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The pairs that a loop in ``order`` takes, each end once: ``pairs(key..., one, two, ...)``.

    A pair that comes first at both its ends is taken whatever happens elsewhere.  ``order`` is
    unique within a key.
    """
    rank = F.struct(*order)
    left = settled(pairs.withColumn("_rank", rank))
    taken = []
    while not left.isEmpty():
        ends = left.select(*keys, F.col("one").alias("end"), "_rank").unionByName(left.select(*keys, F.col("two").alias("end"), "_rank"))
        first = ends.groupBy(*keys, "end").agg(F.min("_rank").alias("_least"))
        # an end's least pair is taken if both ends say so
        votes = first.groupBy(*keys, F.col("_least").alias("_rank")).agg(F.count("*").alias("_votes")).where("_votes = 2").drop("_votes")
        now = settled(left.join(votes, [*keys, "_rank"], "left_semi"))
        taken.append(now)
        used = _ends(now, keys, "one", "end").unionByName(_ends(now, keys, "two", "end"))
        left = settled(reduce(lambda d, end: d.join(used.withColumnRenamed("end", end), [*keys, end], "left_anti"), ("one", "two"), left))
    return _all(taken).drop("_rank") if taken else pairs.limit(0)


def _around(cx: Column, cy: Column, n: int) -> Column:
    """array<struct<cx,cy>> of a cell and those up to ``n`` cells away."""
    steps = F.sequence(F.lit(-n), F.lit(n))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((cx + i).alias("cx"), (cy + j).alias("cy")))))


def elect(points: DataFrame, keys: list[str], in_reach: Callable[[str, str], Column], around: int) -> DataFrame:
    """(key..., seq, cell, x, y) of the points that come first: a point leads unless an earlier leader is in
    reach of it.

    ``points(key..., seq, cell, x, y)``: points of one cell (struct of cx and cy) are in reach of each
    other, those in reach are at most ``around`` cells apart, and ``in_reach(a, b)`` says so for
    the columns ``a.x, a.y, b.x, b.y``.  In a round only the first point of each cell is looked at,
    so crowds are no pairs: each point meets one point of each cell near it.
    """
    fields = ["seq", "cell", "x", "y"]
    near = lambda d: d.select(*keys, F.explode(_around(F.col("cell.cx"), F.col("cell.cy"), around)).alias("cell"), *[F.col(c).alias(f"l_{c}") for c in ("seq", "x", "y")])
    undecided = settled(points.select(*keys, *fields))
    leaders = []
    while not undecided.isEmpty():
        first = settled(undecided.groupBy(*keys, "cell").agg(F.min_by(F.struct("seq", "x", "y"), "seq").alias("p")).select(*keys, "p.seq", "cell", "p.x", "p.y"))
        waits = undecided.join(near(first), [*keys, "cell"]).where((F.col("seq") < F.col("l_seq")) & in_reach("l_", "")).select(*keys, F.col("l_seq").alias("seq"))
        found = settled(first.join(waits, [*keys, "seq"], "left_anti"))
        leaders.append(found)
        gone = undecided.join(near(found), [*keys, "cell"]).where((F.col("seq") >= F.col("l_seq")) & in_reach("l_", "")).select(*keys, "seq")
        undecided = settled(undecided.join(gone, [*keys, "seq"], "left_anti"))
    return _all(leaders) if leaders else points.select(*keys, *fields).limit(0)


def follow(points: DataFrame, leaders: DataFrame, keys: list[str], in_reach: Callable[[str, str], Column], around: int, prefer: Callable[[str, str], list[Column]]) -> DataFrame:
    """(key..., seq, leader): each point's leader, the first by ``prefer`` of those in reach that are
    no later than the point."""
    near = leaders.select(*keys, F.explode(_around(F.col("cell.cx"), F.col("cell.cy"), around)).alias("cell"), *[F.col(c).alias(f"l_{c}") for c in ("seq", "x", "y")])
    met = points.join(near, [*keys, "cell"]).where((F.col("seq") >= F.col("l_seq")) & in_reach("l_", ""))
    best = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(prefer("l_", ""))], F.col("l_seq").alias("leader"))
    return met.groupBy(*keys, "seq").agg(F.min(best).alias("_best")).select(*keys, "seq", F.col("_best.leader").alias("leader"))


def peel(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges(key..., u, v)`` without those that lead nowhere: edges at a vertex of one edge go,
    again and again.  Vertices are whole numbers; each edge stands once.

    A vertex keeps the number of its edges and the exclusive or of its neighbours, so the one
    neighbour of an end is known without a look at the edges, and a round touches the neighbours
    of what went in the round before, nothing else.
    """
    both = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(*keys, F.col("v").alias("a"), F.col("u").alias("b")))
    whole = settled(both.groupBy(*keys, "a").agg(F.count("*").alias("n"), F.bit_xor("b").alias("link")))
    ends, changed, gone = whole.where("n = 1"), None, []
    while not ends.isEmpty():
        gone.append(ends.select(*keys, "a"))
        less = ends.groupBy(*keys, F.col("link").alias("a")).agg(F.count("*").alias("_less"), F.bit_xor("a").alias("_link"))
        if changed is None:
            now = whole
        else:  # the newest state of what the peeling has touched
            now = whole.join(less, [*keys, "a"], "left_semi").join(changed, [*keys, "a"], "left_anti").unionByName(changed)
        hit = settled(now.join(less, [*keys, "a"]).select(*keys, "a", (F.col("n") - F.col("_less")).alias("n"), F.col("link").bitwiseXOR(F.col("_link")).alias("link")))
        changed = hit if changed is None else settled(changed.join(hit, [*keys, "a"], "left_anti").unionByName(hit))
        ends = hit.where("n = 1")
    if not gone:
        return edges
    dead = settled(_all(gone).distinct())
    return reduce(lambda d, end: d.join(dead.withColumnRenamed("a", end), [*keys, end], "left_anti"), ("u", "v"), edges)


def cycles(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., node, cycle, place) of ``steps(key..., node, next)``, a permutation: ``cycle`` is the
    least node of a node's cycle, ``place`` how many steps lead from that to the node.

    Each round doubles how far a node sees, so a cycle of n nodes takes log n rounds.
    """
    now = settled(steps.select(*keys, "node", F.col("next").alias("far"), F.col("node").alias("least"), F.lit(0).cast("long").alias("off"), F.lit(1).cast("long").alias("span")))
    while True:
        there = now.select(*keys, F.col("node").alias("far"), F.col("far").alias("_far"), F.col("least").alias("_least"), F.col("off").alias("_off"))
        # the same least node seen again comes later, so the nearer sight of it stays
        sees = F.col("_least") < F.col("least")
        fresh = now.join(there, [*keys, "far"]).select(
            *keys, "node", F.col("_far").alias("far"), F.least("least", "_least").alias("least"),
            F.when(sees, F.col("span") + F.col("_off")).otherwise(F.col("off")).alias("off"), (F.col("span") * 2).alias("span"), sees.alias("moved"),
        )
        fresh = settled(fresh)
        if fresh.where("moved").isEmpty():
            break
        now = fresh.drop("moved")
    size = now.groupBy(*keys, "least").agg(F.count("*").alias("_n"))
    return now.join(size, [*keys, "least"]).select(*keys, "node", F.col("least").alias("cycle"), F.pmod(F.col("_n") - F.col("off"), F.col("_n")).alias("place"))

"""Hard negatives of anchors, by bounded inner products after an orthogonal PCA rotation.

An anchor's positives are the nearest rows of its own label, and its hard negatives the nearest
rows of other labels that score within a band under a positive.  Scores are inner products of
integer vectors.

The rotation comes from the second moments of all rows, so leading components carry most of a
product.  For a block of anchors and one of rows the products of the first eighth of the
components are accumulated, then of a quarter and a half; what is left of a product is at most the
product of the residual norms, plus slack for rounding.  A pair whose upper bound is under what k
pairs of the anchor surely reach, or whose bounds lie outside every band, goes at each step; the
integer products of the others decide.

Anchors are a stated share of the rows and meet all rows in cells of bounded size, anchors by
rows; positives meet by label, a frequent label in several cells.  Rows of one label with one
vector are equal to every anchor, so ``k + 1`` of them with the smallest ids are enough.

Defined results: a row with a null id, label or vector, or with a null or non-finite component,
takes no part; rows that repeat an id are one row, that of the least label and then vector;
vectors of different length have no product, so each length is searched by itself (empty vectors
too: all their products are 0); lengths after the ``ROTATED`` most frequent ones or over
``LONGEST`` are searched without rotation, with the same bounds; an anchor without positives of
0 or more has no negatives; a component beyond 64 bits is the nearest that fits, and so is a
score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import cut, table

#: Positives of an anchor and negatives of a positive.
K = 5
#: A row is an anchor if this divides its id.
EVERY = 100
#: Labels of rows whose id this divides move on by one, of so many.
MOVED, LABELS = 7, 10
#: A component is floor(SCALE * x).
SCALE = 256
#: Numbers of a block of anchors and of rows, and scores that are held at once.
ANCHOR_BLOCK, ROW_BLOCK, HELD = 1 << 20, 1 << 19, 1 << 20
#: Labels are dealt to so many lanes, which have blocks of their own.
LANES = 4096
#: Lengths that get a rotation, and how long they are at most.
ROTATED, LONGEST = 16, 2048
#: Share of pairs under which a step looks at pairs one by one.
SPARSE = 0.25
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, scale: int = SCALE, moved: int = MOVED, labels: int = LABELS) -> DataFrame:
    """(id, label, d, v) of ``rows(id, label, vector)`` that take part: v holds integers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    label = F.when(F.col("id") % moved == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    one = kept.select(F.col("id").cast("long").alias("id"), F.struct(label.alias("label"), v.alias("v")).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    return one.select("id", "x.label", F.size("x.v").alias("d"), "x.v")


def _matrix(t: pa.Table, d: int) -> np.ndarray:
    """The vectors of a group, all of length d, as rows."""
    v = t.column("v").combine_chunks()
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(t), d)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent lengths the directions of the rows' second moments, the largest first."""
    sizes = rows.where(F.col("d").between(2, LONGEST)).groupBy("d").count().orderBy(F.desc("count"), "d").limit(ROTATED).collect()
    known = {r["d"] for r in sizes}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths):
                x = _matrix(pa.Table.from_batches([b.filter(pa.array(lengths == d))]), d).astype(float)
                sums[d] = sums.get(d, 0) + x.T @ x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([int(d) for d in sums], pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["d", "m"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_py()) for m in t.column("m"))
        return pa.table({"d": t.column("d")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    # sums of tasks are added up in two steps, so that no task holds all of them
    parts = rows.where(F.col("d").isin(*known)).select("d", "v").mapInArrow(partial, "d int, m binary") if known else None
    if parts is None:
        return {}
    some = parts.groupBy("d", (F.spark_partition_id() % 64).alias("part")).applyInArrow(added, "d int, m binary")
    found = {}
    for r in some.groupBy("d").applyInArrow(added, "d int, m binary").collect():
        found[r["d"]] = np.linalg.eigh(np.frombuffer(r["m"]).reshape(r["d"], r["d"]))[1][:, ::-1]
    return found


def _may_overflow(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(a.size and b.size) and np.abs(a.astype(float)).max() * np.abs(b.astype(float)).max() * a.shape[1] >= 2.0**62


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of pairs of rows; those of integers beyond 64 bits are the nearest that fit."""
    if a.dtype == np.int64 and _may_overflow(a, b):
        exact = (sum(int(x) * int(y) for x, y in zip(a[p], b[q], strict=True)) for p, q in zip(i, j, strict=True))
        return np.array([min(max(s, LONG_MIN), LONG_MAX) for s in exact], np.int64)
    step = max(1, HELD // max(1, a.shape[1]))
    out = [np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    return np.concatenate(out) if out else np.zeros(0, a.dtype)


def candidates(q: np.ndarray, x: np.ndarray, rotation: np.ndarray | None, narrow: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of q and x that ``narrow(low, high)``, bounds of all products, leaves."""
    a, b, wide = q.astype(float), x.astype(float), _may_overflow(q, x)
    if rotation is not None:
        a, b = a @ rotation, b @ rotation
    d = a.shape[1]
    slack = (d + 16) * 2.0**-46 * np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    sums, alive, done = np.zeros((len(a), len(b))), None, 0
    low = high = sums
    for m in sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2)}):
        rest_a, rest_b = np.linalg.norm(a[:, m:], axis=1), np.linalg.norm(b[:, m:], axis=1)
        if alive is None or alive.mean() > SPARSE:
            sums += a[:, done:m] @ b[:, done:m].T
            rest = np.outer(rest_a, rest_b) + slack
            low, high = sums - rest, sums + rest
        else:
            i, j = np.nonzero(alive)
            sums[i, j] += _dots(a[:, done:m], b[:, done:m], i, j)
            rest = rest_a[i] * rest_b[j] + slack[i, j]
            low[i, j], high[i, j] = sums[i, j] - rest, sums[i, j] + rest
        left = narrow(np.clip(low, LONG_MIN, LONG_MAX), np.clip(high, LONG_MIN, LONG_MAX)) if wide else narrow(low, high)
        alive, done = left if alive is None else alive & left, m
    return np.nonzero(alive)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value; -inf if it has fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def _first(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's k highest scores, ties by id."""
    order = np.lexsort((ids, ~scores, group))  # ~ turns the order of all 64-bit integers
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


def _chunks(left: pa.Table, rows: int) -> Iterator[slice]:
    step = max(1, HELD // max(1, rows))
    return (slice(i, i + step) for i in range(0, len(left), step))


POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def _positive_cell(k: int, turned: dict[int, np.ndarray]) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            d = left.column("d")[0].as_py()
            x, ids, labels = _matrix(right, d), right.column("id").to_numpy(), right.column("label").to_numpy()
            for part in _chunks(left, len(right)):
                some = left.slice(part.start, part.stop - part.start)
                q, own, label = _matrix(some, d), some.column("id").to_numpy(), some.column("label").to_numpy()
                fits = (label[:, None] == labels) & (own[:, None] != ids)

                def narrow(low, high, fits=fits):
                    return fits & (high >= _kth(np.where(fits, low, -np.inf), k)[:, None])

                i, j = candidates(q, x, turned.get(d), narrow) if d else np.nonzero(fits)
                scores = _dots(q, x, i, j)
                best = _first(i, scores, ids[j], k)
                out.append((own[i[best]], ids[j[best]], scores[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negative_cell(k: int, turned: dict[int, np.ndarray]) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            d = left.column("d")[0].as_py()
            x, ids, labels = _matrix(right, d), right.column("id").to_numpy(), right.column("label").to_numpy()
            for part in _chunks(left, len(right)):
                some = left.slice(part.start, part.stop - part.start)
                q, own, label = _matrix(some, d), some.column("id").to_numpy(), some.column("label").to_numpy()
                positives = some.column("positives").to_pylist()
                # bands of integers, a column for each place; an empty one where there is no such positive
                width = max(map(len, positives))
                top, least = np.full((len(q), width), -1, np.int64), np.zeros((len(q), width), np.int64)
                for r, found in enumerate(positives):
                    for c, p in enumerate(found):
                        top[r, c], least[r, c] = p["score"], -(-4 * p["score"] // 5)
                fits = label[:, None] != labels

                def narrow(low, high, fits=fits, top=top, least=least, width=width):
                    left = np.zeros(fits.shape, bool)
                    for c in range(width):
                        over, under = least[:, c : c + 1], top[:, c : c + 1]
                        sure = _kth(np.where(fits & (low >= over) & (high <= under), low, -np.inf), k)
                        left |= (under >= over) & (high >= np.maximum(over, sure[:, None])) & (low <= under)
                    return fits & left

                i, j = candidates(q, x, turned.get(d), narrow) if d else np.nonzero(fits)
                scores = _dots(q, x, i, j)
                for c in range(width):
                    inside = np.flatnonzero((scores >= least[i, c]) & (scores <= top[i, c]))
                    best = inside[_first(i[inside], scores[inside], ids[j[inside]], k)]
                    which = np.array([positives[r][c]["id"] for r in i[best]], np.int64)
                    out.append((own[i[best]], which, ids[j[best]], top[i[best], c], scores[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _cells(anchors: DataFrame, rows: DataFrame, lane: Column):
    """Groups of blocks of anchors and rows that meet; each lane of a length has as many as it needs."""
    deal = lambda n, numbers: F.greatest(F.lit(1), F.ceil(n * F.greatest("d", F.lit(1)) / numbers))
    anchors, rows = anchors.withColumn("lane", lane), rows.withColumn("lane", lane)
    counts = rows.groupBy("d", "lane").agg(F.count("*").alias("n")).join(anchors.groupBy("d", "lane").agg(F.count("*").alias("a")), ["d", "lane"])
    lanes = cut(counts.select("d", "lane", deal(F.col("a"), ANCHOR_BLOCK).alias("of_anchors"), deal(F.col("n"), ROW_BLOCK).alias("of_rows")), "lanes")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = anchors.join(lanes, ["d", "lane"]).withColumn("ab", own("of_anchors")).withColumn("rb", each("of_rows"))
    right = rows.join(lanes, ["d", "lane"]).withColumn("rb", own("of_rows")).withColumn("ab", each("of_anchors"))
    key = ["d", "lane", "ab", "rb"]
    return left.drop("of_anchors", "of_rows").groupBy(*key).cogroup(right.select(*key, "id", "label", "v").groupBy(*key))


def hard_negatives(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) among
    :func:`usable` rows."""
    rows = cut(rows, "vectors")
    anchors = rows.where(F.col("id") % every == 0)
    same = Window.partitionBy("label", "v").orderBy("id")  # Spark limits groups before the shuffle
    few = cut(rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"), "distinct")
    turned = rotations(rows)
    near = _cells(anchors, few, F.pmod(F.xxhash64("label"), F.lit(LANES))).applyInArrow(_positive_cell(k, turned), POSITIVE)
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    positives = cut(near.withColumn("_n", first).where(F.col("_n") <= k).drop("_n"), "positives")
    lists = positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    banded = cut(anchors.join(lists, "id"), "anchors")
    found = _cells(banded, few, F.lit(0).cast("long")).applyInArrow(_negative_cell(k, turned), NEGATIVE)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return hard_negatives(usable(rows))


#: All products of anchors and rows.
ORACLE_SQL = f"""
with r as (select vec_id as id, case when vec_id % {MOVED} = 0 then (label::bigint + 1) % {LABELS} else label::bigint end as label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select * from r qualify row_number() over (partition by id order by label, v) = 1),
s as (select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
      from u a join u b on a.id <> b.id and len(a.v) = len(b.v) where a.id % {EVERY} = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= {K}),
n as (select p.*, s.id as negative_id, s.score as negative_score,
             row_number() over (partition by anchor_id, positive_id order by s.score desc, s.id)::int as rank
      from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {K}
"""

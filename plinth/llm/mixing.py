"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets.  The sources share 1.5 times the words of all documents by weight; a source stops at
twice its own words, and what it leaves is shared by weight again until nothing is above.

Quotas.  The documents of a source are dealt to shards of about ``SHARD_WORDS`` words by a seeded
digest and stand in a shard in the order of that digest, so a source that holds a third of all
rows is many small windows.  A shard is cut into blocks of one size.  Shards are the parties of a
Sainte-Laguë apportionment: with a weight of w blocks a shard's s-th block has the quotient
w / (s - 1/2), and the highest quotients get a block each, at most twice a shard's blocks.  The
divisor at which the quotas add up is found by a few aggregates over the shards; nothing is
ordered in one task but the few quotients about it.

Selection.  Of a shard's n blocks, quota q, the j-th is taken floor(((j + 1) q + u) / n) -
floor((j q + u) / n) times, with a seeded u: q in all, no block more than twice, spread evenly
over the documents, which the digest has put in random order.

Defined results: a null text has no words; a null source is a source of its own, the last; rows
without words take nothing; rows that repeat an id are rows of their own; equal rows take the same
in sum, whichever comes first; a null id is an id; columns of ``docs`` stay, but for those named
like the operator's own, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: What the sources share, as a share of all words, and where a source stops, as a share of its own.
SHARE, STOP = 1.5, 2
#: Words of a block, and of a shard (about).
BLOCK, SHARD_WORDS = 64, 1 << 18
SEED = "mix"
#: Hexadecimal digits of a digest that are read as a number.
DIGITS = 15
#: Divisors tried in one aggregate, and quotients about the divisor that are ordered at the end.
TRIES, SETTLED = 24, 10_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, the words of the text, and ``place``, a seeded digest of the row."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, "place": F.md5(F.concat(F.lit(f"{seed}:"), named[0], F.lit(":"), named[1]))})


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0, by code point, null last.  Sources are ordered by ranges,
    and a range's ranks start after those of the ranges before."""
    order = F.col("source").asc_nulls_last()
    ranges = cut(sources.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "sources")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    skipped = ranges.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_skipped"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranges.withColumn("_within", within).join(skipped, "_range").withColumn("rank", F.col("_within") + F.col("_skipped")).drop("_range", "_within", "_skipped")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, stop: int = STOP) -> DataFrame:
    """``sources(source, source_size)`` with ``rank`` and ``target``."""
    turn = F.array(*map(F.lit, weights))
    known = cut(ranked(sources).withColumn("_weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    full, left, weight = 0, None, None
    while True:
        # what the sources that stop leave, and the weight of the others; more stop in each round
        stops = F.lit(False) if left is None else F.col("_weight") * F.lit(left) / F.lit(weight) > stop * F.col("source_size")
        n, total, stopped, free = known.agg(F.count("*"), F.sum("source_size"), F.sum(F.when(stops, stop * F.col("source_size"))), F.sum(F.when(~stops, F.col("_weight")))).first()
        if not n:
            return known.withColumn("target", F.lit(0.0)).drop("_weight")
        if left is not None and (stopped or 0) == full or free is None:
            break
        full, weight = stopped or 0, free
        left = share * total - full
    target = F.least(F.col("_weight") * F.lit(left) / F.lit(weight), (stop * F.col("source_size")).cast("double"))
    return known.withColumn("target", target).drop("_weight")


def apportion(parties: DataFrame, seats: int, keys: list[str]) -> DataFrame:
    """``parties(key..., weight, most)`` with ``quota``: ``seats`` seats go to the highest quotients
    weight / (s - 1/2) of s-th seats, at most ``most`` to a party; of equal quotients that of the
    least keys comes first."""

    def won(divisor: float) -> Column:
        """Seats whose quotient is ``divisor`` or more; the division is set right by one where it rounds."""
        n, quotient = F.floor(F.least(F.col("weight") / F.lit(divisor), F.col("most").cast("double")) + 0.5), lambda s: F.col("weight") / (s - 0.5)
        right = n + F.when(quotient(n + 1) >= divisor, 1).when((n > 0) & (quotient(n) < divisor), -1).otherwise(0)
        return F.least("most", right)

    tried = [2.0**k for k in range(-60, 60, 120 // TRIES)] + [1.0]
    low, high, above, below = 0.0, math.inf, math.inf, 0
    while above - below > SETTLED and math.nextafter(low, math.inf) < high:
        tried = sorted({d for d in tried if low < d < high})
        if not tried:
            break
        sums = [x or 0 for x in parties.agg(*[F.sum(won(d)) for d in tried]).first()]
        for divisor, n in zip(tried, sums, strict=True):
            if n >= seats:
                low, above = divisor, n
            elif divisor < high:
                high, below = divisor, n
        if low == 0.0 or high == math.inf:
            break
        tried = [low + (high - low) * k / TRIES for k in range(1, TRIES)]
    sure = won(high) if high < math.inf else F.lit(0)
    held = parties.withColumn("_sure", sure.cast("long"))
    last = won(low) if low > 0.0 else F.col("most")
    open_seats = held.withColumn("_seat", F.explode(F.when(last > F.col("_sure"), F.sequence(F.col("_sure") + 1, last.cast("long")))))
    left = max(0, seats - int(below))
    best = open_seats.orderBy((F.col("weight") / (F.col("_seat") - 0.5)).desc(), *keys).limit(left)
    found = held.join(best.groupBy(*keys).agg(F.count("*").alias("_more")), keys, "left")
    return found.withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_sure", "_more")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, stop: int = STOP, block: int = BLOCK, seed: str = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """:func:`measured` documents with ``source_size``, ``target``, ``spans`` (struct of start and
    length in words of the text, and how often the mix takes them) and ``taken``."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut(targets(sizes, weights, share, stop).withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))), "targets")
    dealt = docs.drop("source_size", "target").withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    dealt = dealt.withColumn("_shard", _number(F.col("place")) % F.col("_shards"))
    words = dealt.groupBy("rank", "_shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).where("words > 0")
    length = F.ceil(F.col("words") / F.ceil(F.col("words") / block))
    shards = words.withColumn("_length", length).withColumn("_blocks", F.ceil(F.col("words") / F.col("_length")))
    shards = cut(shards.withColumns({"weight": F.col("_blocks") * F.col("target") / F.col("source_size"), "most": stop * F.col("_blocks")}).drop("source_size", "target", "words"), "shards")
    # whole millionths, so that the sum doesn't depend on its order
    seats = shards.agg(F.sum(F.round(F.col("weight") * 1e6).cast("long"))).first()[0] or 0
    quotas = apportion(shards, (seats + 500_000) // 1_000_000, ["rank", "_shard"]).drop("weight", "most")
    turn = _number(F.md5(F.concat_ws(":", F.lit(seed), "rank", "_shard"))) % F.col("_blocks")
    quotas = cut(quotas.withColumn("_turn", turn), "quotas")
    line = Window.partitionBy("rank", "_shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_end", F.sum("size").over(line)).join(quotas, ["rank", "_shard"], "left")
    start, n, q, u = F.col("_end") - F.col("size"), F.col("_length"), F.col("quota"), F.col("_turn")
    before = lambda j: _div(j * q + u, F.col("_blocks"))
    at = lambda j: F.greatest(j * n, start)
    spans = F.transform(
        F.sequence(_div(start, n), _div(F.col("_end") - 1, n)),
        lambda j: F.struct((at(j) - start).alias("start"), (F.least((j + 1) * n, F.col("_end")) - at(j)).alias("length"), (before(j + 1) - before(j)).alias("times")),
    )
    spans = F.when(F.col("size") > 0, F.filter(spans, lambda s: s["times"] > 0))
    placed = placed.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<start:bigint,length:bigint,times:bigint>>")))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"] * x["times"])
    return placed.withColumn("taken", taken).drop("_shards", "_shard", "_end", "_length", "_blocks", "quota", "_turn", "rank")


def pieces(text: Column, spans: Column) -> Column:
    """The words of ``spans`` as texts, each as often as the mix takes it."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.flatten(F.transform(spans, lambda s: F.array_repeat(F.array_join(F.slice(words, s["start"].cast("int") + 1, s["length"].cast("int")), " "), s["times"].cast("int"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    return mix(cut(rows, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


#: The stop by ordered prefixes, all quotients ordered, and each block a row.
ORACLE_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
                  md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as place from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, [{", ".join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1] as weight, {SHARE} * sum(source_size) over () as share from s),
p as (select *, coalesce(sum({STOP} * source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as stopped,
             sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following)::bigint as free from w),
l as (select stopped, free, share from p where weight * (share - stopped) / free <= {STOP} * source_size order by source_size / weight, rank limit 1),
t as (select source, source_size, rank, least(weight * (l.share - l.stopped) / l.free, ({STOP} * source_size)::double) as target,
             greatest(1, ceil(source_size / {SHARD_WORDS}))::bigint as shards from w, l),
r as (select d.*, source_size, target, rank, ('0x' || substr(place, 1, {DIGITS}))::bigint % shards as shard from d join t on d.source is not distinct from t.source),
g as (select rank, shard, sum(size)::bigint as words, any_value(source_size) as source_size, any_value(target) as target from r group by 1, 2 having sum(size) > 0),
b as (select *, ceil(words / ceil(words / {BLOCK}))::bigint as length from g),
n as (select *, ceil(words / length)::bigint as blocks from b),
v as (select *, blocks * target / source_size as weight from n),
q as (select rank, shard, unnest(range(1, {STOP} * blocks + 1)) as seat, weight from v),
h as (select rank, shard, count(*)::bigint as quota from (select *, row_number() over (order by weight / (seat - 0.5) desc, rank, shard) as k from q)
      where k <= (select floor((sum(round(weight * 1e6)::bigint) + 500000) / 1e6) from v) group by 1, 2),
x as (select rank, shard, length, blocks, coalesce(quota, 0) as quota, ('0x' || substr(md5('{SEED}:' || rank || ':' || shard), 1, {DIGITS}))::bigint % blocks as turn
      from v left join h using (rank, shard)),
y as (select r.*, length, blocks, quota, turn, sum(size) over (partition by rank, shard order by place, doc_id nulls first, size rows unbounded preceding)::bigint as stop
      from r left join x using (rank, shard)),
z as (select *, row_number() over () as row from y),
k as (select row, sum((least((j + 1) * length, stop) - greatest(j * length, stop - size)) * (((j + 1) * quota + turn) // blocks - (j * quota + turn) // blocks))::bigint as taken
      from (select *, unnest(range((stop - size) // length, (stop - 1) // length + 1)) as j from z where size > 0) group by row)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from z left join k using (row)
"""

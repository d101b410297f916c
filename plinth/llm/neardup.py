"""MinHash near-duplicates with tensored banding.

A document's set holds the distinct ``width``-word shingles of its lower-cased text.  Two
small collections of ``HALVES`` min-hash tuples are computed; a table's key joins one tuple
of each, so HALVES * HALVES tables cost only 2 * HALVES * TUPLE min-hashes.

1. Keys.  Every class of equal sets gives one key a table.  One range shuffle by key sorts them;
   a key that only one class has goes there and then.  The range is over (key, class), so one
   key of any size is dealt over many tasks.
2. Leaders.  In each bucket the member that meets the most others (summed over its buckets) is
   the leader.  The centre of a group of near copies leads nearly all buckets of that group, so
   n copies give about n pairs (member, leader), not n a table.  Pairs are confirmed on the full
   sets and joined to components.
3. The rest.  Pairs of a bucket of which neither was its leader and whose members are in different
   components are all tested too, as pairs of blocks, by an exact bound: a set's parity bitmap
   has the parities of the numbers of its shingles in ``PARITY_BITS`` bins, and two sets differ in
   at least as many shingles as their bitmaps differ in bits.  What the bound and the lengths leave
   is confirmed on the full sets.  So every pair that shares a bucket is linked, or joined already,
   or known to be less similar.

Documents with equal sets are one class: only classes go through buckets, and copies are
attached to them by one equi-join, so a group of copies of any size costs one row there.

Defined results: null or empty texts have an empty set and are linked with nothing; a null
doc_id is linked with nothing, its component is null and it is kept; rows that repeat a doc_id
are judged one by one, and the smallest doc_id of what they reach is the component of each;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import batches_of, components, cut, discard, table, text_batches

WIDTH = 5
PERCENT = 80
#: Tuples of each collection, and min-hashes of a tuple.  A pair at the threshold is missed by
#: all HALVES * HALVES tables with probability 2 * (1 - 0.8 ** TUPLE) ** HALVES, under 0.0004.
HALVES, TUPLE = 12, 3
HASHES = 2 * HALVES * TUPLE
#: Bins of the parity bitmap, a power of two.
PARITY_BITS = 1024
#: Ids up to which a set of documents is sent to every executor instead of shuffling all texts.
BROADCAST_ROWS = 500_000
#: Buckets up to this size are compared one by one.  Members of larger ones meet under the
#: tuple of the first collection, since a large group fills nearly the same buckets under each.
SMALL_BUCKET = 32
#: Members of one block; each pair of blocks is one unit of work.
BLOCK_MEMBERS = 1024
#: Members that one step of the pair search compares with all others of its unit.
STEP_MEMBERS = 64
#: Members of a leader that are confirmed in one group.
LED_MEMBERS = 2000
#: Distinct words whose hashes a worker keeps.
WORD_CACHE = 100_000
BLOCK = 8192
#: Rows of one Arrow batch of numbers.
NUMBER_BATCH = 1 << 14

_rng = np.random.default_rng(20240607)
_TIMES = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.  UTF-8 bytes split and lower as the
    word rule asks: bytes.lower() changes A-Z only, bytes.split() splits at [\\x20\\x09-\\x0D]."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    take = min(width, n)
    total = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        total = _mix(total * _STEP[k % 8] + h[k : n - take + 1 + k])
    return np.unique(total)


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (found[None, at : at + BLOCK] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return least


def _tuples(least: np.ndarray) -> np.ndarray:
    """One 32-bit number a tuple; its place goes into it."""
    parts = least.reshape(2 * HALVES, TUPLE)
    total = np.arange(2 * HALVES, dtype=np.uint64)
    for k in range(TUPLE):
        total = _mix(total * _STEP[k] + parts[:, k])
    return (total >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parities(found: np.ndarray) -> bytes:
    counts = np.bincount((found & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                found = shingles(text, width)
                if not len(found):
                    out.append((doc_id, 0, None, None, None))
                    continue
                out.append((doc_id, len(found), _key(found), _tuples(minhashes(found)).tobytes(), parities(found)))
            made = pd.DataFrame(out, columns=["doc_id", "n_shingles", "key", "tuples", "parity"])
            made["doc_id"] = pd.array(rows["doc_id"], dtype="Int64")
            yield made

    return run


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, key, tuples, parity) per row; key names the set."""
    text_batches(docs.sparkSession)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return only.mapInPandas(_sketch(width), "doc_id long, n_shingles long, key binary, tuples binary, parity binary")


def classes_of(sketched: DataFrame) -> DataFrame:
    """(node, key, rep, n_shingles, tuples, parity) per distinct set; node numbers them."""
    named = sketched.where("key is not null and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n_shingles", "tuples", "parity")]  # equal sets have equal ones
    return named.groupBy("key").agg(F.min("doc_id").alias("rep"), *same).withColumn("node", F.monotonically_increasing_id())


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _pairs_of_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node) for each table: the first collection's tuple above, the second's below."""
    for rows in batches:
        if not rows.num_rows:
            continue
        tuples = np.frombuffer(b"".join(rows.column("tuples").to_pylist()), np.uint32).reshape(-1, 2 * HALVES).astype(np.uint64)
        bucket = (tuples[:, :HALVES, None] << np.uint64(32)) | tuples[:, None, HALVES:]
        node = np.repeat(_numbers(rows.column("node")), HALVES * HALVES)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), pa.array(node)], ["bucket", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted (bucket, node) whose bucket the row before or after has too, and the ends
    of the partition, whose bucket may go on in the next one."""
    held: tuple[np.ndarray, np.ndarray, bool] | None = None
    for rows in batches:
        if not rows.num_rows:
            continue
        bucket, node = _numbers(rows.column("bucket")), _numbers(rows.column("node"))
        known = held is None or held[2]  # the first row of a partition stays
        if held is not None:
            bucket, node = np.concatenate((held[0], bucket)), np.concatenate((held[1], node))
        same = bucket[1:] == bucket[:-1]
        keep = np.zeros(len(bucket), bool)
        keep[0] = known
        keep[1:] |= same
        keep[:-1] |= same
        held = bucket[-1:], node[-1:], bool(keep[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(node[keep])], ["bucket", "node"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["bucket", "node"])


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets with two classes or more, and of few others."""
    keys = classes.select("node", "tuples").mapInArrow(_pairs_of_tuples, "bucket long, node long")
    ordered = keys.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")
    return ordered.mapInArrow(_shared, "bucket long, node long")


def led(held: DataFrame) -> DataFrame:
    """(bucket, leader, n) of the buckets with two members or more."""
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = held.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("met"))
    top = held.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("top"), F.count("*").alias("n"))
    return top.where("n > 1").select("bucket", F.col("top.node").alias("leader"), "n")


def _close(percent: int, n_a: str, n_b: str) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles may be similar enough:
    the intersection is at most (n_a + n_b - differ) / 2, the union at least (n_a + n_b + differ) / 2."""
    return 100 * (n_a + n_b - differ) >= percent * (n_a + n_b + differ)


def _unit_pairs(rows: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """The pairs of one unit that are apart and that the bounds leave."""
    lo, hi = rows["lo"].iat[0], rows["hi"].iat[0]
    node, part, block, n = (rows[c].to_numpy() for c in ("node", "part", "block", "n_shingles"))
    parity = np.frombuffer(b"".join(rows["parity"]), np.uint64).reshape(len(rows), -1)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    for at in range(0, len(left), STEP_MEMBERS):
        i = left[at : at + STEP_MEMBERS]
        near = (part[i, None] != part[right]) & (100 * np.minimum(n[i, None], n[right]) >= percent * np.maximum(n[i, None], n[right]))
        if lo == hi:
            near &= i[:, None] < right
        x, y = np.nonzero(near)
        x, y = i[x], right[y]
        differ = np.zeros(len(x), np.int64)
        for w in range(parity.shape[1]):
            differ += np.bitwise_count(parity[x, w] ^ parity[y, w])
        good = _may_link(n[x], n[y], differ, percent)
        if good.any():
            a, b = node[x[good]], node[y[good]]
            yield pd.DataFrame({"hub": np.minimum(a, b), "node": np.maximum(a, b)})


def _every_pair(percent: int):
    """Pairs of each unit (unit, lo, hi); a unit's rows follow one another, maybe over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            key = rows[["unit", "lo", "hi"]].to_numpy()
            if held and (held[-1][["unit", "lo", "hi"]].to_numpy()[-1] != key[0]).any():
                yield from _unit_pairs(pd.concat(held, ignore_index=True), percent)
                held = []
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(rows)]
            for k, (x, y) in enumerate(zip(starts, starts[1:], strict=False)):
                if k:
                    yield from _unit_pairs(pd.concat(held, ignore_index=True), percent)
                    held = []
                held.append(rows.iloc[x:y])
        if held:
            yield from _unit_pairs(pd.concat(held, ignore_index=True), percent)

    return run


def rest_pairs(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """All pairs (hub, node) of a bucket that are in different components and may be similar
    enough; ``members(bucket, n, node, part)`` without the leaders, ``sizes(node, n_shingles, parity)``."""
    apart = members.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("bucket")
    unit = F.when(F.col("n") <= SMALL_BUCKET, F.col("bucket")).otherwise(F.shiftright("bucket", 32)).alias("unit")
    inside = members.join(apart, "bucket", "left_semi").select(unit, "node", "part").distinct()
    inside = cut(inside, "inside")
    k = inside.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("k"))
    mine = inside.join(k, "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    # a member of block i belongs to the units (i, j) and (j, i) of all blocks j, the smaller one first
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    units = mine.join(sizes, "node").select("unit", "node", "part", "block", "n_shingles", "parity", other)
    units = units.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    units = units.repartition("unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi")
    return units.mapInPandas(_every_pair(percent), "hub long, node long").distinct()


def _own_set(width: int):
    """Drops a row whose text is not that of its class (a doc_id may have several texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.loc[[_key(shingles(t, width)) == bytes(k) for k, t in zip(rows["key"], rows["text"], strict=True)], ["node", "text"]]

    return run


def _confirmed(width: int, percent: int):
    """Rows come as a hub's text and then the texts of those that are compared with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty(0, np.uint64)
        for rows in batches:
            good = []
            for node, text in zip(rows["node"], rows["text"], strict=True):
                mine = shingles(text, width)
                if pd.isna(node):
                    held = mine
                    good.append(False)
                    continue
                both = len(np.intersect1d(mine, held, assume_unique=True))
                good.append(100 * both >= percent * (len(mine) + len(held) - both))
            yield rows.loc[good, ["hub", "node"]].astype("int64")

    return run


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (hub, node) of classes that are similar enough on their full sets.  A hub's text is
    sent once for LED_MEMBERS of its pairs."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("hub").alias("node")).unionByName(pairs.select("node")).distinct()
    wanted = cut(classes.join(nodes, "node", "left_semi").select("node", "key", F.col("rep").alias("doc_id")), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    text_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if few else wanted, "doc_id")
    texts = texts.select("node", "key", "text").mapInPandas(_own_set(width), "node long, text string")
    texts = cut(texts.groupBy("node").agg(F.any_value("text").alias("text")), "texts")  # equal sets: any text of them
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / LED_MEMBERS).cast("int").alias("k"))
    mine = pairs.join(hubs, "hub").join(texts, "node").select("hub", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("salt"), "node", "text")
    own = hubs.join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), "text")
    dealt = own.unionByName(mine).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("node"))
    return dealt.mapInPandas(_confirmed(width, percent), "hub long, node long")


def links(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Components (node, component) of the classes that have a link."""
    spark = docs.sparkSession
    with batches_of(spark, NUMBER_BATCH):
        held = cut(buckets(classes), "buckets")
    leaders = cut(led(held), "leaders")
    members = cut(held.join(leaders, "bucket").where("node <> leader"), "members")
    discard(held, leaders)
    sizes = classes.select("node", "n_shingles", "parity")
    n = classes.select("node", "n_shingles")
    tried = members.select(F.col("leader").alias("hub"), "node").distinct()
    tried = tried.join(n.select(F.col("node").alias("hub"), F.col("n_shingles").alias("n_hub")), "hub").join(n, "node")
    tried = cut(tried.where(_close(percent, "n_hub", "n_shingles")).select("hub", "node"), "tried")
    found = cut(confirm(tried, classes, docs, width, percent), "links")
    parts = cut(components(found.select(F.col("hub").alias("src"), F.col("node").alias("dst"))), "parts")
    placed = members.where("n > 2").select("bucket", "n", "node").join(parts, "node", "left")
    rest = rest_pairs(placed.select("bucket", "n", "node", F.coalesce("component", "node").alias("part")), sizes, percent)
    flat = tried.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
    with batches_of(spark, NUMBER_BATCH):
        rest = cut(rest.join(flat, ["hub", "node"], "left_anti"), "rest")
    discard(members, tried)
    more = cut(confirm(rest, classes, docs, width, percent), "links")
    if more.isEmpty():
        return parts
    every = found.unionByName(more)
    return components(every.select(F.col("hub").alias("src"), F.col("node").alias("dst")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs(doc_id, text, ...)``."""
    sketched = cut(sketches(docs, width), "sketches")
    classes = cut(classes_of(sketched), "classes")
    parts = links(classes, docs, width, percent)
    placed = classes.select("node", "key", "rep").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = placed.join(least, "component").select("key", "component_id")
    named = sketched.where("key is not null and doc_id is not null").select("doc_id", "n_shingles", "key")
    # a doc_id with several texts ties their components together
    repeated = cut(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        tied = named.join(repeated, "doc_id", "left_semi").select("doc_id", "key").distinct().join(ids, "key")
        tied = components(tied.select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))).withColumnsRenamed({"node": "component_id", "component": "joined"})
        ids = ids.join(tied, "component_id", "left").select("key", F.coalesce("joined", "component_id").alias("component_id"))
    linked = named.join(ids, "key").select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id.  Of rows that repeat it, the
    one with the least text stays (a null text last; of equal texts, one by a hash of the row)."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id")
    ids = cut(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    few = ids.count() <= BROADCAST_ROWS
    chosen = docs.join(F.broadcast(ids.select("doc_id")) if few else ids.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    many = ids.where("n > 1").select("doc_id")
    if not many.isEmpty():
        order = F.struct(F.col("text").isNull().alias("a"), F.col("text").alias("b"), F.xxhash64(*docs.columns).alias("c"))
        one = chosen.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
        chosen = chosen.join(many, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))
    return chosen.unionByName(docs.where("doc_id is null"))

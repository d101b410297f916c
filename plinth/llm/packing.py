"""Packing documents into token sequences by cutting-stock column generation.

Each document's ids (and the end id) are cut into full sequences and one rest.  The lengths of
the rests, in classes of ``QUANTUM`` tokens, are the demand of a cutting-stock problem: the
linear program over patterns is solved by column generation, where an unbounded-knapsack
dynamic program prices columns; pattern counts are rounded down, and what is left is packed
first-fit decreasing on the class counts.  Documents are then ranked within their class and
the ranks are dealt to the patterns' places.  Only the histogram (at most CAPACITY / QUANTUM
numbers) is on the driver; ranks come from counts by class and salt, so a class that holds a
third of all rows is not ordered in one task.

Defined results: a null or empty text is the end id alone; repeated rows are packed each on
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import cut, table, text_batches
from plinth.llm.wordcache import word_encoder

CAPACITY = 4096
QUANTUM = 8
END_ID = 2
#: The program ends when the knapsack's bound shows it within this share of the optimum.
GAP = 0.0005
MAX_COLUMNS = 4000
#: Rows of a class that are ordered together.
RANK_ROWS = 50_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = word_encoder(path), np.uint32(END_ID).astype("<u4").tobytes()
        for rows in batches:
            out = []
            for i, ids in enumerate(encoder.encode([x or "" for x in rows["text"]])):
                ids += end
                n = len(ids) // 4
                out += [(i, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            made["doc_id"] = pd.array(rows["doc_id"].astype("Int64").array[made["doc_id"].to_numpy(int)], dtype="Int64")
            yield made

    text_batches(docs.sparkSession)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return only.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best pattern (any number of each size within ``room``) and its value."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(int(sizes[0]), room + 1):
        k = upto[c]
        gain = best[c - sizes[:k]] + values[:k]
        j = int(gain.argmax())
        if gain[j] > best[c - 1]:
            best[c], last[c] = gain[j], j
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if last[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        pattern[last[c]] += 1
        c -= int(sizes[last[c]])
    return float(best[room]), pattern


def solve(demand: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {size: number}) that use each size of ``demand`` exactly as often as it
    is there; the sizes of a pattern add up to at most ``room``."""
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return []
    wanted = np.array([demand[s] for s in sizes], float)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ wanted
    for _ in range(MAX_COLUMNS):
        prices = inverse.sum(axis=0)
        value, pattern = _knapsack(np.maximum(prices, 0), sizes, room)
        if value <= 1 + 1e-9 or x.sum() - prices @ wanted / value <= GAP * x.sum():
            break
        step = inverse @ pattern
        if step.max() <= 1e-9:
            break
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        columns[:, out] = pattern
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
    times = np.floor(x + 1e-9).astype(int)
    while ((over := columns @ times - wanted) > 0.5).any():  # rounding noise only
        bad = int(np.argmax(over))
        times[int(np.argmax(np.where(columns[bad] > 0, times, -1)))] -= 1
    plan = [(int(n), {int(s): int(k) for s, k in zip(sizes, columns[:, p], strict=True) if k}) for p, n in enumerate(times) if n > 0]
    rest = {int(s): int(n) for s, n in zip(sizes, np.rint(wanted - columns @ times), strict=True) if n > 0}
    return plan + _first_fit(rest, room)


def _first_fit(rest: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Fills one sequence after another with the largest size that still fits."""
    left, found = dict(rest), Counter()
    while left:
        free, pattern, often = room, {}, None
        for s in sorted(left, reverse=True):
            k = min(left[s], free // s)
            if k:
                pattern[s] = k
                free -= k * s
        often = min(left[s] // k for s, k in pattern.items())
        found[tuple(pattern.items())] += often
        for s, k in pattern.items():
            left[s] -= often * k
            if not left[s]:
                del left[s]
    return [(n, dict(p)) for p, n in found.items()]


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, number in a sequence, first sequence, first slot)."""
    used, out, sequence = Counter(), [], 0
    for times, pattern in plan:
        slot = 0
        for size, number in sorted(pattern.items(), reverse=True):
            out.append((size, used[size], used[size] + times * number, number, sequence, slot))
            used[size] += times * number
            slot += number
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """The pieces of ``docs(doc_id, text, ...)`` with sequence_id and offset."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, path, capacity), "pieces").withColumn("class", F.ceil(F.col("length") / quantum).cast("int"))
    histogram = {r["class"]: r["n"] for r in cutted.groupBy("class").agg(F.count("*").alias("n")).collect()}
    rows = places(solve(histogram, capacity // quantum))
    shape = "class int, lo long, hi long, number long, sequence long, slot long"
    # at most one row for a class and pattern, whatever the number of documents
    plan = F.broadcast(spark.createDataFrame(rows, shape))
    salts = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    salted = cutted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("class", "salt", (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("inside", inside).join(before, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))
    dealt = ranked.join(plan, (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    dealt = dealt.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("number"))).alias("sequence_id"),
        (F.col("slot") + at % F.col("number")).alias("place"),
    )
    so_far = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("offset", F.sum("length").over(so_far) - F.col("length")).drop("place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), vocabulary_path())

"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code holds the signs of its components.  Codes are cut into segments; codes of a
block are sorted by each segment's value.  For a query, segment values at distance 0, 1, 2, ...
of the query's own are looked up in every segment: after radius r every code nearer than
m * (r + 1) has been met (pigeonhole), so the search ends when the k-th verified distance is
below that bound.  Ties go to the smaller id.

Rows with one code are one entry with their ``k + 1`` smallest ids (no more can be among a
query's k nearest), so a vector that a third of all rows share costs one entry.  Blocks of
queries meet blocks of codes in tasks of bounded size, and each returns its k nearest.

Defined results: a null or empty vector has no code and is neither query nor answer; a vector
with other than the usual length is compared with those of its own length; a null component
counts as 0; rows that repeat an id are one row, the shortest vector with the least code; a query is never its own answer; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import cut, table

K = 10
#: Distinct codes, and queries, of one task.
CODE_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 12
#: Codes from which segments have 16 bits instead of 8.
LONG_SEGMENTS = 1 << 12
#: Every how-manieth id is a query.
EVERY = 20


def sign_codes(vectors: pd.Series) -> pd.Series:
    """Signs of a vector's components as bits (1: over 0); null for a null or empty vector."""
    return pd.Series([None if v is None or not len(v) else np.packbits(np.nan_to_num(np.asarray(v, float)) > 0).tobytes() for v in vectors], dtype=object)


def _masks(bits: int, radius: int) -> np.ndarray:
    ones = list(combinations(range(bits), radius))
    return np.array([sum(1 << b for b in c) for c in ones], np.int64)


class MultiIndex:
    """Codes (rows of bytes, all of one length) by the values of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        width = codes.shape[1]
        self.size = 2 if len(codes) >= LONG_SEGMENTS and width % 2 == 0 else 1
        self.bits, self.m = 8 * self.size, width // self.size
        self.values = codes.view(">u2").astype(np.int64) if self.size == 2 else codes.astype(np.int64)
        self.order, self.starts = [], []
        for s in range(self.m):
            self.order.append(np.argsort(self.values[:, s], kind="stable"))
            self.starts.append(np.searchsorted(self.values[self.order[s], s], np.arange((1 << self.bits) + 1)))
        self.masks = {}

    def search(self, code: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances that hold the k nearest rows; counts: rows of each entry."""
        own = code.view(">u2").astype(np.int64) if self.size == 2 else code.astype(np.int64)
        seen = np.zeros(len(self.codes), bool)
        met, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for radius in range(self.bits + 1):
            if radius not in self.masks:
                self.masks[radius] = _masks(self.bits, radius)
            for s in range(self.m):
                values = own[s] ^ self.masks[radius]
                lo, n = self.starts[s][values], self.starts[s][values + 1] - self.starts[s][values]
                lo, n = lo[n > 0], n[n > 0]
                if not len(n):
                    continue
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                found = self.order[s][at]
                found = found[~seen[found]]
                seen[found] = True
                met.append(found)
                far.append(np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64))
            entries, distances = np.concatenate(met), np.concatenate(far)
            covered = distances < self.m * (radius + 1)
            if counts[entries[covered]].sum() >= k or covered.sum() == len(self.codes):
                return entries[covered], distances[covered]
        return entries, distances


def _cell(k: int):
    columns = ["query_id", "neighbor_id", "distance"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("code", kind="stable")
            index = MultiIndex(np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1))
            ids = [np.asarray(x, np.int64) for x in right["ids"]]
            counts = np.array([len(x) for x in ids])
            for query_id, code in zip(left["query_id"], left["code"], strict=True):
                entries, distances = index.search(np.frombuffer(code, np.uint8), counts, k + 1)
                best = sorted((int(d), int(i)) for e, d in zip(entries, distances, strict=True) for i in ids[e] if i != query_id)[:k]
                out += [(query_id, i, d) for d, i in best]
        return pd.DataFrame(out, columns=columns).astype("int64")

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each of ``queries(id, vector)`` the k rows of
    ``rows(id, vector)`` with the smallest Hamming distance of sign codes, itself excepted."""
    sign_code = F.pandas_udf(sign_codes, "binary")
    coded = lambda d: d.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("v")).select("id", sign_code("v").alias("code"), F.size("v").alias("d")).where("code is not null").groupBy("id").agg(F.min(F.struct("d", "code")).alias("x")).select("id", "x.code", "x.d")
    first = F.row_number().over(Window.partitionBy("d", "code").orderBy("id"))
    few = coded(rows).withColumn("n", first).where(F.col("n") <= k + 1)  # Spark limits groups before the shuffle
    codes = cut(few.groupBy("d", "code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = cut(coded(queries).withColumnRenamed("id", "query_id"), "queries")
    code_blocks, query_blocks = max(1, -(-codes.count() // CODE_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    codes = codes.withColumn("cb", F.pmod(F.xxhash64("code"), F.lit(code_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))))
    key = ["d", "cb", "qb"]
    cells = asked.groupBy(*key).cogroup(codes.groupBy(*key)).applyInPandas(_cell(k), "query_id long, neighbor_id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows, rows.where(F.col("id") % EVERY == 0))


#: Signs as bits, the Hamming distance of every query to every row, ties by id.
ORACLE_SQL = f"""
with c as (select distinct vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b
           from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0),
s as (select vec_id, array_to_string(b, '')::bit as b from c qualify row_number() over (partition by vec_id order by len(b), array_to_string(b, '')) = 1),
p as (select q.vec_id as query_id, r.vec_id as neighbor_id, bit_count(xor(q.b, r.b))::bigint as distance
      from s q join s r on q.vec_id <> r.vec_id and length(q.b) = length(r.b) where q.vec_id % {EVERY} = 0),
k as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from p)
select query_id, rank::int as rank, neighbor_id, distance from k where rank <= {K}
"""

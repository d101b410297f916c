"""A corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

Defined results: rows with a null or empty text go in the first stage; without labels only the base
rules reject; a null doc_id is never a copy and stays; of rows that repeat a doc_id one stays; extra
columns are carried to the last stage, which returns the columns of packing; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import neardup, packing, quality_model, quality_rules
from plinth.llm.common import cut, table
from plinth.workers import importable

#: Each stage may also be run by itself, in a session whose workers don't know the package yet.
STAGES = [
    ("quality_rules", importable(quality_rules.stage)),
    ("quality_classifier", importable(quality_model.stage)),
    ("minhash_near_dedup", importable(neardup.stage)),
    ("packing", importable(packing.stage)),
]

#: The classifier, the min-hash search and the packing program are no SQL; the stages are tested
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

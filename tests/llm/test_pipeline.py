import os
import subprocess
import sys

import corpus_pipeline
import pytest
from plinth.llm import registry

from tests.llm.conftest import SHAPE


def test_stages_and_registry(spark, prose, tmp_path):
    rows, labels = [], []
    for i in range(260):
        words = prose(60, i).split()
        good = i % 4 > 0
        text = ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, 60, 8)) if good else " | ".join(words) + " ###"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[1][1] + f" tail{i}", "en", "s", 0) for i in range(5)] + [(2000, None, None, None, None), (2001, "short", "en", "s", 5)]
    # copies that no label trusts would be over-represented in the raw corpus of so small a table
    labels += [(1000 + i, 1, 0) for i in range(5)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = common_cut(after, tmp_path)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i in range(260) if i % 4 > 0}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == kept
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) == 13


def common_cut(df, tmp_path):
    from plinth.llm.common import cut

    return cut(df, "stage")


def test_pipeline_on_empty_tables_and_odd_rows(spark, prose, odd, none, tmp_path):
    """No rows at all; rows with nulls, repeats and no labels, and columns named as the stages' own."""
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    good = [(50, prose(60, 1), "en", "s", 0), (51, prose(60, 1), "en", "s", 0), (52, prose(60, 2), None, None, None), (None, prose(60, 1), "en", "s", 0)]
    odd = odd.unionByName(spark.createDataFrame(good, SHAPE))
    for name, docs in (("empty", none), ("odd", odd.withColumns({n: F.lit(n) for n in ("row", "node", "kept", "score", "class")}))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    # the odd rows are too short or repeat themselves; without labels no other rule speaks
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} == {None, 50, 52}


APART = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.read.parquet("documents.parquet")
print("rows", [dict(corpus_pipeline.STAGES)[{name!r}](spark, docs, ".").count()])
"""


@pytest.mark.parametrize("name", ["quality_classifier", "minhash_near_dedup", "packing"])
def test_a_stage_by_itself_where_workers_do_not_know_the_package(spark, prose, tmp_path, name):
    """The driver knows the package by sys.path only, and works in another folder."""
    spark.createDataFrame([(i, prose(60, i), "en", "s", 0) for i in range(8)], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", APART.format(repo=repo, name=name)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows [8]" in run.stdout, run.stderr[-2000:]

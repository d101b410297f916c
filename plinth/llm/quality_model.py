"""Quality classifier: regularised quadratic discriminant analysis on text statistics.

Each document becomes a short vector of transformed statistics (log counts and shares).  Per
class, the mean and covariance come from sums over every labelled training row, added up on
the executors; the covariance is shrunk towards its diagonal and towards the pooled one.  The
score is the logistic of the difference of the two Gaussian log-densities (Mahalanobis
distances through cached Cholesky factors) divided by ``TEMPERATURE``.

Defined results: a null or empty text has the statistics of the empty text and gets a score
like any other; a null doc_id is not held out and has no label; repeated rows are scored each
on their own; repeated labels count as often as they occur; with fewer than ``MIN_ROWS``
training rows of a class every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import cut, table, text_batches

FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
#: Shares of the pooled covariance and of the diagonal in a class covariance, and a ridge.
POOLED, DIAGONAL, RIDGE = 0.3, 0.1, 1e-4
TEMPERATURE = 4.0
MIN_ROWS = 20
#: Labels up to which their ids go to every executor; beyond it labelled texts are shuffled.
BROADCAST_ROWS = 1_000_000
NAMES = (
    "log_chars", "log_words", "word_length", "symbols", "pipes", "digits", "marks", "line_length",
    "repeated_lines", "distinct_words", "distinct_pairs", "upper", "short_words", "packed",
)
_UPPER = re.compile(rb"[A-Z]")
_DIGIT = re.compile(rb"[0-9]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda k, of: np.sqrt(k / of) if of else 0.0
    pairs = set(zip(words, words[1:], strict=False))
    marks = sum(data.count(x) for x in b".,;:!?'\"")
    return [
        np.log1p(size),
        np.log1p(n),
        np.log1p((size - data.count(b" ")) / n) if n else 0.0,
        share(sum(data.count(x) for x in b"#*$%&<>"), size),
        share(data.count(b"|"), size),
        share(len(_DIGIT.findall(data)), size),
        share(marks, size),
        np.log1p(n / len(lines)) if lines else 0.0,
        share(len(lines) - len(set(lines)), len(lines)),
        share(len(set(words)), n),
        share(len(pairs), max(n - 1, 1)),
        share(len(_UPPER.findall(data)), size),
        share(sum(len(x) < 4 for x in words), n),
        1.0 if n < 20 else 0.0,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per row, x the statistics of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "x": [statistics(t) for t in rows["text"]]})

    text_batches(docs.sparkSession)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return only.mapInPandas(run, "doc_id long, x array<double>")


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = len(NAMES)
    n, first, second = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))
    for rows in batches:
        for label, group in rows.groupby("quality"):
            x = np.stack(group["x"].to_numpy())
            n[label] += len(x)
            first[label] += x.sum(axis=0)
            second[label] += x.T @ x
    yield pd.DataFrame({"label": [0, 1], "n": n, "first": list(first), "second": [m.ravel() for m in second]})


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, Cholesky factor of the covariance (its inverse), log-density constant."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 0.5)
        log = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip((log[0] - log[1]) / TEMPERATURE, -60, 60)))


def fit(labelled: DataFrame) -> Discriminant:
    """From ``labelled(x, quality)`` rows, all of them, by sums made where the rows are."""
    width = len(NAMES)
    rows = labelled.mapInPandas(_sums, "label int, n double, first array<double>, second array<double>").collect()
    n, first, second = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))
    for r in sorted(rows, key=lambda r: (r["label"], r["n"], r["first"])):  # the same sum in any order of tasks
        n[r["label"]] += r["n"]
        first[r["label"]] += r["first"]
        second[r["label"]] += np.reshape(r["second"], (width, width))
    if n.min() < MIN_ROWS:
        return Discriminant(np.empty((0, width)), np.empty((0, width, width)), np.empty(0))
    means = first / n[:, None]
    covs = second / n[:, None, None] - np.einsum("ki,kj->kij", means, means)
    pooled = np.einsum("k,kij->ij", n, covs) / n.sum()
    whiten, constants = [], []
    for k in range(2):
        c = (1 - POOLED - DIAGONAL) * covs[k] + POOLED * pooled + DIAGONAL * np.diag(np.diag(covs[k])) + RIDGE * np.eye(width)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(constants))


def train(found: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return fit(found.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("x", "quality"))


def scorer(model: Discriminant):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.score(np.stack(x.to_numpy())), 9)) if len(x) else pd.Series([], dtype=float)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs(doc_id, text, ...)``."""
    found = cut(features(docs), "statistics")
    score = scorer(train(found, labels))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels"))


def labelled_part(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a label."""
    ids = cut(labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "labelled")
    few = ids.count() <= BROADCAST_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents predicted to be of quality 1.  The model is fitted on the labelled rows of
    the whole ``documents`` table, since earlier stages have taken most rows labelled 0 away;
    with too few of a class every document stays.  Texts are judged where they are."""
    labels = table(spark, sf_dir, "labels")
    model = train(cut(features(labelled_part(table(spark, sf_dir, "documents"), labels)), "statistics"), labels)
    if not len(model.means):
        return docs
    text_batches(spark)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.score(np.array([statistics(t) for t in text])), 9) if len(text) else [], dtype=float)

    row = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return row.where(score("text") >= ACCEPT).select("row.*")

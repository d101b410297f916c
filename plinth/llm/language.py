"""Language ID: a byte convolutional network trained in numpy.

The network reads fixed-length windows of UTF-8 bytes: filters of several widths over one-hot
bytes, the maximum of each filter over the window, a softmax over the languages.  Since the
input is one-hot, a filter is one table of 256 rows for each of its places, and a convolution
is a sum of table rows.  A document is cut into windows that overlap by the widest filter, so
every byte counts; its probabilities are the mean over its windows.

Training uses windows at hashed places of a sample: at most ``PER_LANGUAGE`` documents a
language are expected, and ``IN_ALL`` shared equally by the languages if these are many, chosen
by a hash of doc_id and text, and ``WINDOWS_EACH`` windows of each.  Every language takes part.
Documents per language are counted over all rows.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
training row everything is ``und``; a null doc_id is not held out and not trained on; repeated
rows are predicted each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import cut, table, text_batches
from plinth.llm.quality_model import held_out

FOLDS, HELD_OUT = 3, 1
WINDOW = 160
WIDTHS, FILTERS = (2, 3, 4), 16
PER_LANGUAGE, WINDOWS_EACH, IN_ALL = 1500, 2, 400_000
#: Languages up to which their counts go to every executor.
BROADCAST_LANGUAGES = 100_000
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 7
BLOCK = 256
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class ByteNet:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False):
        """The maximum of each filter over each window, at least 0, and where it is."""
        tops, at = [], []
        for w, rows in zip(WIDTHS, self.tables, strict=True):
            span = windows.shape[1] - w + 1
            total = rows[0][windows[:, :span]]
            for k in range(1, w):
                total += rows[k][windows[:, k : k + span]]
            if places:
                at.append(total.argmax(axis=1))
            tops.append(total.max(axis=1))
        return np.maximum(np.concatenate(tops, axis=1), 0), at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        found = []
        for i in range(0, len(windows), BLOCK):
            logit = self.pooled(windows[i : i + BLOCK])[0] @ self.out + self.bias
            e = np.exp(logit - logit.max(axis=1, keepdims=True))
            found.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(found) if found else np.empty((0, len(self.languages)), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross-entropy, each language weighted alike."""
        rng = np.random.default_rng(SEED)
        weight = 1 / np.maximum(np.bincount(labels, minlength=len(self.languages)), 1)
        weight = (weight / weight[labels].mean()).astype(np.float32)
        params = [*self.tables, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                x, y = windows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
                top, at = self.pooled(x, places=True)
                logit = top @ self.out + self.bias
                e = np.exp(logit - logit.max(axis=1, keepdims=True))
                error = e / e.sum(axis=1, keepdims=True)
                error[np.arange(len(y)), y] -= 1
                error *= weight[y][:, None] / len(y)
                back = (error @ self.out.T) * (top > 0)
                grads = []
                for j, w in enumerate(WIDTHS):
                    g, part = np.zeros_like(self.tables[j]), back[:, j * FILTERS : (j + 1) * FILTERS]
                    filters = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(x, at[j] + k, axis=1), filters), part)
                    grads.append(g)
                grads += [top.T @ error, error.sum(axis=0)]
                step += 1
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * m / (np.sqrt(v) + 1e-8)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last one is filled with zero bytes."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    filled = np.zeros((n - 1) * step + WINDOW, np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)[: len(filled)]
    return np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::step]


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text window) of the bounded training sample."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n_lang")), "languages")
    languages = counts.count()
    if not languages:
        return []
    rate = min(PER_LANGUAGE, IN_ALL / languages) / F.col("n_lang")
    place = lambda *salt: F.pmod(F.xxhash64("doc_id", "text", *map(F.lit, salt)), F.lit(1_000_003)) / 1_000_003
    known = known.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").where(place() < rate)
    cuts = [F.substring("text", (place(k) * F.greatest(F.char_length("text") - WINDOW, F.lit(0))).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS_EACH)]
    rows = known.select("lang", F.explode(F.array(*cuts)).alias("window")).collect()
    return sorted((r["lang"], r["window"]) for r in rows)


def fit(docs: DataFrame) -> ByteNet | None:
    rows = [(lang, window) for lang, window in sample(docs) if has_letter(window)]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    net = ByteNet(languages)
    x = np.concatenate([windows_of(window.encode("utf-8", "surrogatepass")[:WINDOW]) for _, window in rows])
    net.train(x, np.array([languages.index(lang) for lang, _ in rows]))
    return net


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for rows in batches:
            names, scores = [UNKNOWN] * len(rows), np.zeros(len(rows))
            for i, text in enumerate(rows["text"]):
                if model is None or not text or not has_letter(text):
                    continue
                mean = model.probabilities(windows_of(text.encode("utf-8", "surrogatepass"))).mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                names[i], scores[i] = model.languages[best], min(1.0, float(mean[best]))
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "lang_pred": names, "score": scores.round(6)})

    text_batches(docs.sparkSession)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return only.mapInPandas(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs(doc_id, text, lang, ...)``; ``lang``
    is read for training only."""
    found = predict(docs, fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))

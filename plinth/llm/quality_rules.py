"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

The model is a pair of multinomials over hashed unigrams and bigrams: one of the trusted
target (documents labelled quality = 1), one of the raw corpus (every document).  Both are
counted over whole texts, each distinct one once, so exact copies don't move them.  A document's
score is the sum of log(target / raw) over its n-grams divided by their number; every document is
kept or not by one fixed threshold.
Everything runs on DataFrame functions.

Defined results: a null or empty text (or one of white space only) has counts 0, score 0 and
fails the base rules; repeated rows are judged each on their own; without target rows every
weight is 0, so only the base rules decide; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import SPACE, bound, cut, int_array, table

GAP = r"[ \t-\r]+"
WINDOW = 8
BUCKETS = 1 << 14
#: Weights are kept as integers of a thousandth, so a score does not depend on summing order.
UNIT = 1000
SMOOTHING = 1.0
THRESHOLD = -0.25
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labels up to which their ids (some 10 MB), or copied texts up to which their digests, go to
#: every executor; beyond it texts are shuffled to them.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeat_words(hashes: Column) -> Column:
    """Words in windows of eight that are found twice or more, from the words' hashes."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(ranked: Column) -> Column:
        m = F.size(ranked)
        starts = F.transform(
            ranked,
            lambda x, i: F.when(
                ((i > 0) & (F.get(ranked, i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get(ranked, i + 1)["h"] == x["h"])), x["i"]
            ),
        )
        found = F.array_sort(F.filter(starts, lambda s: s.isNotNull()))
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"))
        return F.aggregate(found, begin, step, lambda a: a["n"])

    def counted(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bound(ranked, covered))

    return F.when(n < WINDOW, F.lit(0)).otherwise(bound(windows, counted))


def grams(hashes: Column) -> Column:
    """Buckets of the unigrams and then of the bigrams of a text."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(one, two)


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_counts(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """(raw, trusted) counts of each bucket over the whole texts of ``docs(text, raw, trusted)``, a
    text's n-grams counted so many times each; partial sums bound what is shuffled."""
    each = docs.select("raw", "trusted", F.explode(bound(hashed(words_of(F.col("text"))), grams)).alias("bucket"))
    sums = each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    return {r["bucket"]: (r["raw"], r["trusted"]) for r in sums.collect()}


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, raw, trusted) per row of ``docs``: raw is 1, trusted says that its label is good."""
    good = cut(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("good")).distinct(), "trusted")
    few = good.count() <= BROADCAST_ROWS
    joined = docs.select("doc_id", "text").join(F.broadcast(good) if few else good, "doc_id", "left")
    return joined.select("text", F.lit(1).alias("raw"), F.coalesce("good", F.lit(0)).alias("trusted"))


def fit_weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """Weight of each bucket in thousandths.  Counts are those of all rows, less those of copies:
    a text whose words n rows have, t of them trusted, counts once in each.  Only texts that have
    copies are gathered, by a digest of their words."""
    rows = marked(docs, labels)
    keyed = rows.select("text", "trusted", F.md5(F.array_join(words_of(F.col("text")), " ").cast("binary")).alias("key"))
    copied = keyed.groupBy("key").agg((1 - F.count("*")).alias("raw"), F.least(1 - F.sum("trusted"), F.lit(0)).alias("trusted"))
    copied = cut(copied.where("raw < 0"), "copied")
    few = copied.count() <= BROADCAST_ROWS
    extra = keyed.select("text", "key").join(F.broadcast(copied) if few else copied, "key").groupBy("key", "raw", "trusted").agg(F.any_value("text").alias("text"))
    found, less = gram_counts(rows), gram_counts(extra)
    raw = {b: n + less.get(b, (0, 0))[0] for b, (n, _) in found.items()}
    trusted = {b: n + less.get(b, (0, 0))[1] for b, (_, n) in found.items()}
    raw_all, trusted_all = sum(raw.values()), sum(trusted.values())
    if not trusted_all:
        return [0] * BUCKETS
    log_share = lambda n, total: math.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS))
    return [round(UNIT * (log_share(trusted.get(b, 0), trusted_all) - log_share(raw.get(b, 0), raw_all))) for b in range(BUCKETS)]


def judge(docs: DataFrame, weights: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` as struct ``row`` and the rules' columns, row by row without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weight = int_array(weights)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    total = F.aggregate(F.col("grams"), F.lit(0).cast("bigint"), lambda a, b: a + F.get(weight, b))
    return (
        docs.select(F.struct("*").alias("row"), text.alias("text"), words_of(text).alias("words"))
        .select(
            "row",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            hashed(F.col("words")).alias("hashes"),
        )
        .select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", bound(F.col("hashes"), lambda h: F.struct(repeat_words(h).alias("rep"), grams(h).alias("grams"))).alias("w"))
        .select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("w.rep").cast("long").alias("n_repeat_words"), F.col("w.grams").alias("grams"))
        .select(
            "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
            F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(total / F.greatest(F.size("grams"), F.lit(1)) / UNIT).alias("score"),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``docs(doc_id, text, ...)`` as struct ``row`` with its counts, score and
    verdict; the trusted target is the part of ``docs`` that ``labels`` marks quality = 1."""
    return judge(docs, fit_weights(docs, labels), threshold)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", *COUNTS, "base_failed", "kept", F.round("score", 9).alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose ``kept`` is true, with their own columns."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")

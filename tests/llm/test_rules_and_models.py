import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import language, quality_model, quality_rules

LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    """The base counts by brute force."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts_match_brute_force(spark, prose, odd):
    rng = random.Random(1)
    texts = []
    for i in range(60):
        t = prose(rng.randint(1, 120), i)
        if i % 3 == 0:
            t += " " + t[: rng.randint(1, len(t))]
        if i % 4 == 0:
            t = t.replace(" ", "\n", 5) + "\n" + t.split("\n")[0] + "\n#$ |\t<b>\r\n \n"
        texts.append((i, t))
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd.where("doc_id > 0").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    out = quality_rules.quality_rules(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).select("row.*", *quality_rules.COUNTS, "base_failed").collect()
    assert len(out) == docs.count()
    for r in out:
        want = counts(r["text"])
        assert tuple(r[c] for c in quality_rules.COUNTS) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_likelihood_ratio_matches_brute_force(spark, prose):
    docs = spark.createDataFrame([(i, prose(40, i)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8), 0) for i in range(12)], LABELS)
    weights = quality_rules.fit_weights(docs, labels)
    buckets = docs.select("doc_id", quality_rules.grams(quality_rules.hashed(quality_rules.words_of(F.col("text")))).alias("g")).collect()
    raw, good = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for r in buckets:
        np.add.at(raw, r["g"], 1)
        if r["doc_id"] < 8:
            np.add.at(good, r["g"], 1)
    share = lambda x: np.log((x + 1) / (x.sum() + quality_rules.BUCKETS))
    assert np.abs(np.array(weights) / 1000 - (share(good) - share(raw))).max() <= 0.00051
    scores = {r["doc_id"]: r["score"] for r in quality_rules.judge(docs, weights).select("row.doc_id", "score").collect()}
    for r in buckets:
        assert scores[r["doc_id"]] == pytest.approx(np.mean([weights[b] for b in r["g"]]) / 1000, abs=1e-9)


def test_rules_stage_keeps_columns_and_odd_rows_pass(spark, clashing, none, tmp_path):
    spark.createDataFrame([(7, 1, 0), (None, 1, 1), (4, None, None), (7, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = quality_rules.stage(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    assert all(len((r["text"] or "").split()) >= 20 for r in out.collect())
    assert quality_rules.stage(spark, none, str(tmp_path)).count() == 0
    empty = spark.createDataFrame([], LABELS)
    assert quality_rules.quality_rules(clashing, empty).count() == clashing.count()


def _labelled(spark, prose, n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = prose(rng.randint(30, 200), i).split()
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) if good else " | ".join(words) + "###" * 5
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_classifier_held_out_accuracy_and_folds(spark, prose):
    docs, labels = _labelled(spark, prose)
    out = quality_model.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert len(out) == 400
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert held and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_classifier_learns_nothing_from_held_out_labels(spark, prose):
    docs, labels = _labelled(spark, prose, 200)
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_model.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_odd_rows(spark, prose, clashing, none, tmp_path):
    docs, labels = _labelled(spark, prose, 150)
    out = quality_model.quality_scores(clashing.select("doc_id", "text", "score", "x"), labels).collect()
    assert len(out) == clashing.count() and all(r["score"] == 0.5 and r["predicted"] == 0 for r in out)  # too few labelled rows
    both = docs.unionByName(clashing.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    out = quality_model.quality_scores(both, labels).collect()
    assert len(out) == both.count() and all(0 <= r["score"] <= 1 for r in out)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert quality_model.stage(spark, none, str(tmp_path)).count() == 0
    kept = quality_model.stage(spark, docs.withColumns({"row": F.lit(1), "score": F.lit("s")}), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "row", "score"] and {r["doc_id"] % 3 > 0 for r in kept.collect()} == {True}


def _tongues(spark, prose, n=240):
    rng = random.Random(9)
    ends = {"aa": "ing tion the ed", "bb": "keit ung sch ß", "cc": "ción os ar ñ", "dd": "eau ez ê oux"}
    rows = []
    for i in range(n):
        lang = list(ends)[i % 4]
        rows.append((i, " ".join(w[: rng.randint(1, 4)] + rng.choice(ends[lang].split()) for w in prose(80, i).split()), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark, prose):
    docs = _tongues(spark, prose)
    out = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["lang_pred"] == r["lang"] for r in out if r["held_out"]]) >= 0.95


def test_language_odd_rows(spark, prose, clashing, none):
    both = _tongues(spark, prose, 80).unionByName(clashing.select((F.col("doc_id") + 900).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))
    out = language.language_id(both).collect()
    assert len(out) == both.count() and all(0 <= r["score"] <= 1 for r in out)
    told = {r["doc_id"]: r["lang_pred"] for r in out}
    assert {told[900 + k] for k in (1, 2, 3, 9)} == {"und"} and told[904] != "und"
    assert language.language_id(none).count() == 0
    assert {r["lang_pred"] for r in language.language_id(clashing.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 159, 160, 161, 157 * 2, 1000):
        data = bytes(i % 251 + 1 for i in range(n))
        w = language.windows_of(data)
        step = language.WINDOW - max(language.WIDTHS) + 1
        assert b"".join(bytes(x[:step]) for x in w[:-1]) + bytes(w[-1][: n - step * (len(w) - 1)]) == data


def test_network_pooling_matches_naive_loops_and_training_lowers_the_loss():
    """Pooled maxima and probabilities against loops over places."""
    rng = np.random.default_rng(3)
    net = language.ByteNet(["a", "b", "c"])
    x = rng.integers(0, 256, (5, language.WINDOW), dtype=np.uint8)
    y = np.array([0, 1, 2, 0, 1])
    slow = np.array([[max(0.0, max(sum(float(t[k, int(row[p + k]), f]) for k in range(w)) for p in range(len(row) - w + 1))) for w, t in zip(language.WIDTHS, net.tables, strict=True) for f in range(language.FILTERS)] for row in x])
    assert np.allclose(net.pooled(x)[0], slow, atol=1e-4)
    share = net.probabilities(x)
    logit = slow @ net.out + net.bias
    assert np.allclose(share, np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True), atol=1e-4)
    before = -np.log(share[np.arange(5), y]).mean()
    net.train(np.tile(x, (400, 1)), np.tile(y, 400))
    assert -np.log(net.probabilities(x)[np.arange(5), y]).mean() < before / 4


def test_discriminant_matches_plain_numpy(spark):
    """Scores from sums against np.cov and the inverse of the shrunken covariance."""
    rng = np.random.default_rng(8)
    width = len(quality_model.NAMES)
    sides = [rng.normal(size=(70, width)) @ rng.normal(size=(width, width)) * 0.2 + k for k in range(2)]
    rows = [([float(v) for v in x], k) for k in range(2) for x in sides[k]]
    model = quality_model.fit(spark.createDataFrame(rows, "x array<double>, quality int").repartition(3))
    covs = [np.cov(s.T, bias=True) for s in sides]
    pooled = (covs[0] + covs[1]) / 2
    told = []
    for s, c in zip(sides, covs, strict=True):
        c = (1 - quality_model.POOLED - quality_model.DIAGONAL) * c + quality_model.POOLED * pooled + quality_model.DIAGONAL * np.diag(np.diag(c)) + quality_model.RIDGE * np.eye(width)
        d = np.concatenate(sides) - s.mean(axis=0)
        told.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log(0.5))
    want = 1 / (1 + np.exp(np.clip((told[0] - told[1]) / quality_model.TEMPERATURE, -60, 60)))
    assert np.allclose(model.score(np.concatenate(sides)), want, atol=1e-6)


def test_every_language_is_learned_however_many(spark, prose, monkeypatch):
    monkeypatch.setattr(language, "IN_ALL", 40)
    docs = _tongues(spark, prose, 240)
    sampled = language.sample(docs)
    assert {lang for lang, _ in sampled} == {"aa", "bb", "cc", "dd"} and 20 <= len(sampled) <= 160

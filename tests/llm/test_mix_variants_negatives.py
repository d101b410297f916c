"""Mixing (op11), spelling variants (op12) and hard negatives (op13) against plain versions and SQL."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import mixing, negatives, variants

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _same(found, sql, **tables):
    """The operator's SQL has the same rows over the same tables."""
    with duckdb.connect() as c:
        for name, df in tables.items():
            c.register(name, df.toArrow())
        expected = c.sql(sql)
        names, rows = expected.columns, expected.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert _sorted(found.select(*names).collect()) == _sorted(rows)


# op11


def _water(sizes, share=1.5, stop=2, weights=(5, 2, 1)):
    """Targets by giving, capping and giving what is left again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = share * sum(sizes.values()) - sum(capped.values())
        got = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > stop * sizes[s]]
        if not over:
            return {**capped, **got}
        capped |= {s: stop * sizes[s] for s in over}


def _mixed(docs, **how):
    return mixing.mix(mixing.measured(docs), **how)


@pytest.fixture(scope="module")
def shelf(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 3, 40, 200, 900]), "en", "big" if i % 3 == 0 else rng.choice([None, "a", "B", "é", "z", "~"]), 0) for i in range(400)]
    rows += [(1000, "word " * 30_000, "en", "long", 0), (1001, "tiny", "en", "one word", 0), (1002, None, "en", "none", 0)]
    return spark.createDataFrame(rows, SHAPE)


def test_mix_targets_and_taken(shelf):
    found = [r.asDict() for r in _mixed(shelf, shard_words=4096).collect()]
    sizes = {}
    for r in found:
        assert r["size"] == len((r["text"] or "").split())
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = _water(sizes)
    for s, n in sizes.items():
        mine = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in mine} == {n}
        assert mine[0]["target"] == pytest.approx(targets[s])
        assert sum(r["taken"] for r in mine) == pytest.approx(targets[s], rel=0.03)
    for r in found:  # spans are what is taken, inside the text, apart and in order
        assert sum(s["length"] * s["times"] for s in r["spans"]) == r["taken"]
        ends = [0] + [s["start"] + s["length"] for s in r["spans"]]
        assert all(s["start"] >= e and s["times"] in (1, 2) for s, e in zip(r["spans"], ends, strict=False)) and ends[-1] <= r["size"]


def test_mix_reruns_agree_in_any_order_and_seed_changes_it(shelf):
    one = _sorted(_mixed(shelf).select("doc_id", "taken").collect())
    assert _sorted(_mixed(shelf.repartition(7).orderBy(F.desc("doc_id"))).select("doc_id", "taken").collect()) == one
    assert _sorted(mixing.mix(mixing.measured(shelf, "other"), seed="other").select("doc_id", "taken").collect()) != one


def test_mix_pieces_are_the_words_of_the_spans(shelf):
    rows = _mixed(shelf.where("doc_id in (0, 3, 6, 1000)")).select("text", "spans", "taken", mixing.pieces(F.col("text"), F.col("spans")).alias("p")).collect()
    for r in rows:
        words = r["text"].split()
        assert r["p"] == [" ".join(words[s["start"] : s["start"] + s["length"]]) for s in r["spans"] for _ in range(s["times"])]


def _highest(parties, seats):
    """Quotas by looking at every quotient."""
    every = sorted(((-w / (s - 0.5), i, s) for i, w, most in parties for s in range(1, most + 1)))[:seats]
    return sorted((i, sum(x[1] == i for x in every)) for i, *_ in parties)


@pytest.mark.parametrize("seats", [0, 1, 7, 60, 200, 10_000])
def test_highest_quotients_get_the_seats(spark, monkeypatch, seats):
    rng = random.Random(seats)
    parties = [(i, rng.choice([0.2, 1.0, 1.0, 7.3, 55.5]), rng.choice([1, 5, 120])) for i in range(30)]
    monkeypatch.setattr(mixing, "SETTLED", 3)
    df = spark.createDataFrame(parties, "id int, weight double, most long")
    assert _sorted(mixing.apportion(df, seats, ["id"]).select("id", "quota").collect()) == _sorted(_highest(parties, seats))


def test_mix_odd_rows_and_sql(spark, odd, clashing, none, shelf, tmp_path):
    wanted = ["doc_id", "size", "source_size", "target", "taken"]
    _same(_mixed(odd).select(wanted), mixing.ORACLE_SQL, documents=odd)
    _same(_mixed(shelf).select(wanted), mixing.ORACLE_SQL, documents=shelf)
    assert _sorted(_mixed(clashing).select(wanted).collect()) == _sorted(_mixed(odd).select(wanted).collect())
    assert _mixed(none).select(wanted).collect() == []
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.query(spark, str(tmp_path)).collect() == []


# op12


def _near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_variants(docs):
    n = {}
    for doc_id, text, *_ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if _near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n]


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = random.Random(12)
    words = ["abcdefgh", "aabbccdd", "éclairée", "Grossbuch", "ÀÉÎÕÜàéîõü", "x×y÷zabcd", "aaaaaaaaa", "interest"] + ["".join(rng.choices("abc", k=8)) for _ in range(30)]
    words += ["long" + "ab" * 24 + "end", "q" * 48, "q" * 49, "q" * 50, "pr" * 60 + "s", "pr" * 40 + "t" + "pr" * 20 + "s"]
    rows = []
    for i in range(250):
        mine = []
        for w in rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=12):
            if rng.random() < 0.25:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :]])
            mine.append(w)
        rows.append((i, " ".join(mine) + rng.choice(["", ".", "7 short"]), "en", "s", 0))
    chain = ["chainaaaa"] * 1500 + ["chainaaab"] * 140 + ["chainaabb"] * 13 + ["chainabbb"] * 2
    rows += [(10_000 + i, w, "en", "s", 0) for i, w in enumerate(chain)]
    return rows


def test_variants_are_the_plain_versions(spark, misspelt):
    found = variants.variants(spark.createDataFrame(misspelt, SHAPE)).select("word", "form", "root", "n", "n_near", "form_n")
    rows = _sorted(found.collect())
    assert rows == _sorted(_plain_variants(misspelt))
    assert any(r[1] and r[2] != r[1] for r in rows) and any(len(r[0]) > variants.LONG and r[4] for r in rows)


def test_variants_of_long_words_meet_by_halves_as_by_deletions(spark):
    rng = random.Random(13)
    base = ["".join(rng.choices("ab", k=k)) for k in (8, 9, 9, 10) for _ in range(15)]
    words = {w: rng.randint(2, 200) for w in base} | {w[:3] + "c" + w[3:]: rng.randint(2, 50) for w in base}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    by = lambda long: _sorted(variants.near_words(df, long).collect())
    assert by(48) == by(9) == by(6)


def test_variants_odd_rows_and_sql(spark, odd, clashing, none, misspelt):
    wanted = ["word", "form", "root", "n", "n_near", "form_n"]
    docs = spark.createDataFrame(misspelt[:250], SHAPE).unionByName(odd)
    found = variants.variants(docs).select(wanted)
    _same(found, variants.ORACLE_SQL, documents=docs)
    assert _sorted(variants.variants(clashing).select(wanted).collect()) == _sorted(_plain_variants(odd.collect()))
    assert variants.variants(none).collect() == []
    families = variants.families(found).collect()
    assert sum(r["n"] for r in families) == sum(r["n"] for r in found.collect())


# op13


def _plain_negatives(rows, every, k=5):
    known = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=repr):
        if all(x is not None and math.isfinite(x) for x in v):
            known.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for a, (label, q) in known.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, other == label) for i, (other, v) in known.items() if i != a and len(v) == len(q)]
        for p, pid, _ in sorted(x for x in scored if x[2])[:k]:
            band = sorted(x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(a, pid, r, nid, -p, -s) for r, (s, nid, _) in enumerate(band, 1)]
    return out


VECTORS = "id long, label int, vector array<float>"


def _vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(3, 0.05, d)
    x = rng.normal(size=(n, d)) @ mix * spread
    x[: n // 4] = x[0]  # a vector that a quarter of the rows share
    return [(i, int(rng.integers(0, 4)), [float(np.float32(v)) for v in x[i]]) for i in range(n)]


@pytest.mark.parametrize("d,every", [(16, 9), (3, 20), (1, 25)])
def test_hard_negatives_are_the_plain_ones_in_small_blocks(spark, monkeypatch, d, every):
    rows = _vectors(d, 240, d)
    for name, value in (("ANCHOR_BLOCK", 7 * d), ("ROW_BLOCK", 50 * d), ("HELD", 300)):
        monkeypatch.setattr(negatives, name, value)
    found = negatives.hard_negatives(negatives.usable(spark.createDataFrame(rows, VECTORS)), every)
    expected = _plain_negatives(rows, every)
    assert _sorted(found.collect()) == _sorted(expected) and (d == 1 or expected)


def test_bounds_hold_every_product():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-200, 200, (20, 24)), rng.integers(-200, 200, (90, 24))
    turned = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    products, seen = q @ x.T, []

    def narrow(low, high):
        assert (low <= products).all() and (products <= high).all()
        seen.append((high - low).mean())
        return high >= np.sort(products, axis=1)[:, -5:-4]

    i, j = negatives.candidates(q, x, turned, narrow)
    left = np.zeros(products.shape, bool)
    left[i, j] = True
    assert left[products >= np.sort(products, axis=1)[:, -5:-4]].all()
    assert seen == sorted(seen, reverse=True) and len(seen) == 3 and len(i) < products.size


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, 1, [1.0, 2.0]), (1, 1, [1.0, 1.5]), (2, 2, [1.0, 1.4]), (2, 2, [1.0, 1.4]), (3, None, [1.0, 1.4]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (8, 2, [inf, 1.0])]
    rows += [(None, 2, [1.0, 1.4]), (200, 1, []), (201, 1, []), (202, 2, []), (300, 1, [1e30, 0.0]), (303, 1, [1e30, 0.0]), (302, 2, [1e30, 0.0]), (9, 2, [1.0]), (11, 2, [1.0, 1.5]), (12, 3, [1.0, 1.5])]
    found = negatives.hard_negatives(negatives.usable(spark.createDataFrame(rows, VECTORS))).collect()
    by = {(r["anchor_id"], r["positive_id"]): [] for r in found}
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r["anchor_id"], r["positive_id"]].append(r["negative_id"])
    assert by[100, 1] == [11, 12, 2]
    assert by[200, 201] == [202]
    assert by[300, 303] == [2, 11, 12, 302]  # all saturate, so ids decide
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(negatives.usable(empty)).collect() == []
    other = spark.createDataFrame([r for r in rows if r[0] != 300 and r[0] != 303 and r[0] != 302 and r[2]], VECTORS)
    named = other.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"), "label")
    _same(negatives.hard_negatives(negatives.usable(other.withColumn("d", F.lit("x")).withColumn("lane", F.lit("y")))), negatives.ORACLE_SQL, embeddings=named)

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import common, hamming, neardup, urls


def brute(rows, width, percent=80):
    """Component of each row by comparing all sets."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if rows[i][0] is None or rows[j][0] is None:
            continue
        if rows[i][0] == rows[j][0] or (sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, prose, width):
    rng = random.Random(width)
    rows = []
    for i in range(30):
        base = prose(rng.randint(30, 120), i).split()
        rows.append((i * 10, " ".join(base)))
        for k in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((i * 10 + k + 1, " ".join(copy).upper() if k == 2 else "  ".join(copy)))
    rows += [(900 + i, "exactly the same words in every one of these rows") for i in range(20)]
    rows += [(990, None), (991, ""), (992, "one"), (993, "ONE"), (994, " one "), (None, "one"), (995, "a b"), (996, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_chain(spark, prose):
    """A chain of copies, neighbours alike and ends not, is one component."""
    words, rows = prose(200, 1).split(), []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for k in range(i * 8, i * 8 + 8):
            words[k] = f"changed{k}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 2)


def test_near_duplicates_odd_rows_and_stage(spark, clashing, none):
    got = neardup.near_duplicates(clashing).collect()
    assert len(got) == clashing.count()
    out = neardup.stage(spark, clashing, "")
    assert out.columns == clashing.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(ids, key=str) == sorted([None, 1, 2, 3, 4, 5, 6, 7, 9, -5], key=str)
    assert neardup.near_duplicates(none).count() == 0 and neardup.stage(spark, none, "").count() == 0


def test_repeated_ids_with_other_texts_tie_components(spark, prose):
    rows = [(5, prose(50, 1)), (5, prose(50, 2)), (9, prose(50, 1)), (3, prose(50, 2)), (7, prose(50, 3))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


def test_components_of_stars_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5), (None, 3), (7, None), (300, 299)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200, 300: 299, 299: 299}
    assert got == want
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 64)).astype(float)
    base[40:90] = base[7]  # a common vector
    base[90:120] = base[8] + rng.normal(size=(30, 64)) * 0.3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(400, None), (401, []), (None, [1.0] * 64), (402, [1.0] * 8), (403, [None] + [1.0] * 7), (3, [float(x) for x in base[3]])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumns({"code": F.lit(1), "d": F.lit("x")})
    got = sorted(tuple(r) for r in hamming.top_k(df, df.where("id % 20 = 0"), 5).collect())
    bits = base > 0
    want = []
    for q in range(0, 300, 20):
        best = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300) if i != q)[:5]
        want += [(q, r, i, d) for r, (d, i) in enumerate(best, 1)]
    assert [g for g in got if g[0] < 400] == sorted(want)
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert hamming.top_k(empty, empty).count() == 0


@pytest.mark.parametrize("n", [50, 5000])
def test_multi_index_search_is_exact(n):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 256, (n, 8), dtype=np.uint8), axis=0)
    index, counts = hamming.MultiIndex(codes), np.ones(len(codes), int)
    for q in rng.integers(0, 256, (10, 8), dtype=np.uint8):
        entries, far = index.search(q, counts, 7)
        all_far = np.sort(np.bitwise_count(codes ^ q).sum(axis=1))
        assert np.sort(far)[:7].tolist() == all_far[:7].tolist()


C, R = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
PAGES = [
    (0, "http://a.org/x", C % "http://spam.net/es/1"),
    (1, "https://a.org/x/?utm_source=f#q", None),
    (2, "http://b.org/y", R % "http://a.org/x"),
    (3, "http://c.org/z", C % "//k.com/1"),
    (4, "http://d.org/z", C % "http://c.org/z"),
    (5, "http://e.org/", C % "/w"),
    (6, None, ""),
    (7, "nourl", C % "http://x.net/es/"),
    (8, "http://WWW.Example.com/en/2", None),
    (9, "http://m.example.com/en/2", None),
    (10, "http://example.com", None),
    (11, "http://f.org/q", C % "http://c.org/z"),
    (12, "http://f.org/q", C % "http://zz.net/fr/"),
    (12, "http://f.org/q", C % "http://zz.net/fr/"),
    (None, "http://notexample.com/en/", "<html"),
]
SHAPE = "page_id long, url string, html string"


def test_url_filter_rules_aliases_and_allow(spark):
    df = spark.createDataFrame(PAGES, SHAPE).withColumns({"host": F.lit(1), "node": F.lit("x"), "rule": F.lit(2)})
    got = {(r["page_id"], r["rule"]): r["verdict"] for r in urls.url_filter(df).collect()}
    block = {(0, None), (1, None), (2, None), (9, "example.com/en/")}
    assert {k for k, v in got.items() if v == "block"} == block
    assert urls.url_filter(df).count() == len(PAGES)
    assert got[(8, "www.example.com/en/")] == "allow" and got[(None, "com/")] == "allow" and (10, None) in got
    assert urls.url_filter(spark.createDataFrame([], SHAPE)).count() == 0


def test_url_parts_and_longest_rule_match_brute_force(spark):
    rng = random.Random(2)
    made = ["".join(rng.choices(["http://", "a.", "example.com", "www.", "net", "/en/", "/es/", "?", "#", "/", "COM", "\n", "é"], k=rng.randint(0, 8))) for _ in range(300)]
    got = urls.url_filter(spark.createDataFrame([(i, u, None) for i, u in enumerate(made)], SHAPE)).collect()
    for r in got:
        rest = made[r["page_id"]].partition("://")
        host = re.match(r"[^/?#]*", rest[2])[0] if rest[1] else ""
        path = re.match(r"[^?#]*", rest[2][len(host) :])[0] if rest[1] else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[1], want[2])


def test_relative_targets(spark):
    from urllib.parse import urljoin

    pages = ["http://a.org/x/y/p.html?q=1#f", "http://a.org", "http://a.org/", "http://a.org/x?u=/z/", "http://h.net/a/b/c/d/e/f/g/h/i/j/p.html"]
    targets = ["n.html", "?p=2", "./n", "../n", "../../n", "../../../n/", "a/./b/../c", "/r", "//h.com/r", "http://k.net/r?a=1&amp;b=2", "#f", "mailto:x@y.z"]
    targets += ["../" * n + "z" for n in range(3, 13)] + ["..", ".", "a/..", "a/.", "./../b/./../c/?u=/./x#/../y", "/a/../../b", ".h/..c/d."]
    rows = [(p, t) for p in pages for t in targets]
    df = spark.createDataFrame(rows, "p string, t string")
    got = {(r["p"], r["t"]): r["x"] for r in df.select("p", "t", urls.target_rest(F.col("t"), urls.after_scheme(F.col("p"))).alias("x")).collect()}
    for p, t in rows:
        want = None if t[0] in "#m" else urljoin(p, t.replace("&amp;", "&")).partition("://")[2]
        assert got[(p, t)] == want, (p, t)


def test_verdicts_over_a_graph_of_links_match_union_find_and_sql(spark, tmp_path):
    """Chains, rings and hubs of 2,000 urls, with allowing, blocking and other ends."""
    import duckdb

    rng = random.Random(11)
    host = lambda i: f"h{i}.org" if i % 40 else f"h{i}.net" if i % 80 else f"h{i}.com"
    url = [f"http://{host(i)}{'/es' if i % 120 == 40 else ''}/p{i}" for i in range(2000)]
    to = [i + 1 if i % 7 else rng.choice([0, i - i % 7 + 7, 500]) if i % 3 else None for i in range(1999)] + [1990]
    to = [None if t is None or t >= 2000 else t for t in to]
    link = lambda i, t: None if t is None else (C if i % 2 else R) % (url[t] if i % 5 else f"//{url[t][7:]}/#x")
    pages = [(i, url[i], link(i, to[i])) for i in range(2000)]
    up = list(range(2000))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, t in enumerate(to):
        if t is not None:
            up[root(i)] = root(t)
    own = ["allow" if ".com/" in u else "block" if ".net/es/" in u else None for u in url]
    told = {}
    for i in range(2000):
        if own[i]:
            told.setdefault(root(i), set()).add(own[i])
    want = {i: own[i] or ("block" if told.get(root(i)) == {"block"} else "allow") for i in range(2000)}
    df = spark.createDataFrame(pages, SHAPE)
    assert {r["page_id"]: r["verdict"] for r in urls.url_filter(df).collect()} == want
    assert {"block", "allow"} == set(want.values())
    # links between urls of one node, and pages that only share a node
    same = [("http://x.net/es", C % "http://x.net/es/"), ("http://y.net/fr?utm_source=a", R % "http://y.net/fr/"), ("http://z.net/es", None), ("http://z.net/es/", None), ("http://w.org/a", C % "http://w.org/a#b")]
    extra = [(5000 + i, u, html) for i, (u, html) in enumerate(same)]
    df.limit(300).unionByName(spark.createDataFrame(extra, SHAPE)).write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    small = spark.read.parquet(f"{tmp_path}/pages")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.url_filter(small).collect()}
    assert [verdicts[5000 + i] for i in range(5)] == ["block", "block", "allow", "block", "allow"]
    assert sorted(con.execute(urls.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in urls.url_filter(small).select("page_id", "host", "path", "rule", "verdict").collect())


def test_repeated_ids_with_other_vectors_are_the_least_code(spark):
    rows = [(1, [1.0] * 8), (1, [-1.0] * 8), (2, [-1.0] * 8), (3, [1.0] * 8), (20, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for order in (df, df.orderBy(F.desc("id"), F.col("vector")[0])):
        got = [tuple(r) for r in hamming.top_k(order.repartition(3), order.where("id = 20"), 3).orderBy("rank").collect()]
        assert got == [(20, 1, 1, 0), (20, 2, 2, 0), (20, 3, 3, 8)]

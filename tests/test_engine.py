import json
import math
import re
import xml.dom.minidom

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth import cli
from plinth.functions import geometry as g
from plinth.functions import text as tx
from plinth.functions import words
from plinth.operators import graph, intervals, joins
from plinth.plans import extract as ex
from plinth.plans import queries, strips
from plinth.sinks import raster
from plinth.sinks.documents import geojson_documents, json_documents
from plinth.sinks.files import guid, ifc, svg
from plinth.sinks.writer import outputs, save
from plinth.sources.reader import layer_histogram, primitives_of, read_drawings, texts_of
from plinth.streaming.files import stream_models, write_models
from tests.drawings import Plan, apartment

SPAN = "k int, lo double, hi double"


@pytest.fixture(scope="module")
def drawings(tmp_path_factory):
    folder = tmp_path_factory.mktemp("drawings")
    (folder / "apartment.pdf").write_bytes(apartment().pdf())
    (folder / "box.pdf").write_bytes(Plan().wall(0, 5000, 200).wall(5000, 5000 + 4000j, 200).wall(5000 + 4000j, 4000j, 200).wall(4000j, 0, 200).text('A & B <c> "d"', 1000 + 1000j).pdf())
    (folder / "bad.pdf").write_bytes(b"no drawing")
    return str(folder)


@pytest.fixture(scope="module")
def models(spark, drawings):
    pages = read_drawings(spark, drawings)
    return ex.extract(pages.where("error is null"), "1:50").persist()


def test_read_and_extract(spark, drawings, models):
    pages = read_drawings(spark, drawings)
    assert [r["error"] is None for r in pages.orderBy("plan_id").collect()] == [True, False, True]
    rooms = {(r["plan_id"].rpartition("/")[2], round(r["area_gross_m2"], 2)) for r in ex.child(models, "rooms").collect()}
    assert rooms == {("apartment.pdf#0", 34.56), ("apartment.pdf#0", 17.28), ("box.pdf#0", 20.0)}
    assert layer_histogram(primitives_of(pages)).where("layer = 'A-GLAZ'").first()["n"] == 6
    assert texts_of(pages).count() == 6
    again = ex.extract(ex.nest(primitives_of(pages), texts_of(pages)), "1:50")
    one = lambda df: sorted(map(str, ex.child(df, "openings").collect()))
    assert one(again) == one(models)


def test_data_source(spark, drawings, models):
    from plinth.sources.datasource import register

    register(spark)
    pages = spark.read.format("plan_pdf").load(drawings)
    assert pages.count() == 3 and pages.where("error is not null").count() == 1
    rooms = ex.child(ex.extract(pages.where("error is null"), "1:50"), "rooms")
    assert sorted(r["area_gross_m2"] for r in rooms.collect()) == sorted(r["area_gross_m2"] for r in ex.child(models, "rooms").collect())


def test_json_document(models):
    docs = {r["plan_id"]: json.loads(r["document"]) for r in json_documents(models).collect()}
    d = next(v for k, v in docs.items() if "apartment" in k)
    ids = {o["id"] for o in d["openings"]}
    assert d["summary"]["rooms"] == 3 and d["summary"]["by_kind"] == {"door": 3, "window": 2}
    assert {o for w in d["walls"] for o in w["openings"]} == ids == {e["via"] for e in d["graph"]["edges"] + d["graph"]["exterior"] if e["via"]}
    assert d["graph"]["connected"] and {r["id"] for r in d["rooms"]} == set(d["graph"]["nodes"])
    assert all(isinstance(o["meta"], dict) for o in d["openings"])


def test_geojson_rings_close_and_project(models):
    d = json.loads(geojson_documents(models, (21.0278, 105.8342)).where("plan_id like '%apartment%'").first()["document"])
    rooms = [f for f in d["features"] if f["properties"]["layer"] == "room"]
    assert len(rooms) == 3 and all(f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] for f in rooms)
    assert all(abs(x - 105.8342) < 0.001 and abs(y - 21.0278) < 0.001 for f in rooms for x, y in f["geometry"]["coordinates"][0])
    only = json.loads(geojson_documents(models, include=("walls",)).first()["document"])
    assert {f["geometry"]["type"] for f in only["features"]} == {"LineString"}


def _model(models, name):
    return models.where(F.col("plan_id").contains(name)).toPandas().to_dict("records")[0]


def test_ifc_is_dense_and_ascii(models):
    text = ifc(_model(models, "apartment"))
    ids = [int(x) for x in re.findall(r"^#(\d+)=", text, re.M)]
    assert ids == list(range(1, len(ids) + 1)) and text.isascii()
    assert {int(x) for x in re.findall(r"(?<=[,(])#(\d+)", text)} <= set(ids)
    assert text.count("IFCSPACE(") == 3 and text.count("=IFCDOOR(") == 3 and text.count("=IFCWINDOW(") == 2 and text.count("=IFCWALLSTANDARDCASE(") == 6
    assert text == ifc(_model(models, "apartment")) and len(guid("x")) == 22 and guid("x") != guid("y")


def test_svg_parses_and_escapes(models):
    for name in ("apartment", "box"):
        text = svg(_model(models, name))
        assert xml.dom.minidom.parseString(text.encode()) and text.count('class="room"') == text.count("m²</text>")
    assert "A &amp; B &lt;c&gt;" in text


def decode_gif(data):
    """Frames' index arrays, read independently of the writer."""
    w, h, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    i, frames = 13 + 3 * (2 << (flags & 7)), []
    while data[i] != 0x3B:
        if data[i] == 0x21:
            i += 2
            while data[i]:
                i += data[i] + 1
            i += 1
            continue
        bits, i, body = data[i + 10], i + 11, b""
        while data[i]:
            body += data[i + 1 : i + 1 + data[i]]
            i += data[i] + 1
        i += 1
        clear, stream, at = 1 << bits, int.from_bytes(body, "little"), 0
        table, width, out, last = [], bits + 1, [], None
        while True:
            code, at = stream >> at & (1 << width) - 1, at + width
            if code == clear:
                table, width, last = [[k] for k in range(clear)] + [[], []], bits + 1, None
                continue
            if code == clear + 1:
                break
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            out += entry
            last = entry
            if len(table) == 1 << width and width < 12:
                width += 1
        frames.append(np.array(out).reshape(h, w))
    return frames


def test_gif_round_trip():
    rng = np.random.default_rng(1)
    frames = [(rng.integers(0, 4, (40, 60, 3), dtype=np.uint8) * 80, 10), (np.zeros((40, 60, 3), np.uint8), 20)]
    data = raster.gif(frames)
    palette = np.frombuffer(data[13 : 13 + 3 * (2 << (data[10] & 7))], np.uint8).reshape(-1, 3)
    got = decode_gif(data)
    assert len(got) == 2 and all((palette[x] == f[0]).all() for x, f in zip(got, frames, strict=True))
    with pytest.raises(ValueError):
        raster.gif([])


def test_canvas():
    c = raster.Canvas(40, 40)
    c.polygon([(5, 5), (35, 5), (35, 35), (5, 35)], (255, 0, 0))
    c.line((0, 20), (40, 20), (0, 0, 255), 3)
    c.circle(10, 10, 3, (0, 255, 0))
    assert tuple(c.pixels[10, 10]) == (0, 255, 0) and tuple(c.pixels[20, 20]) == (0, 0, 255) and tuple(c.pixels[30, 30]) == (255, 0, 0) and tuple(c.pixels[2, 2]) == raster.PAPER
    assert len(raster.median_cut(np.random.default_rng(0).integers(0, 255, (90, 90, 3), dtype=np.uint8), 16)) == 16


def test_cli(spark, drawings, tmp_path, capsys):
    assert cli.main(["symbols"]) == 0 and "door_swing" in capsys.readouterr().out
    assert cli.main(["extract", "/no/such.pdf"], spark) == 2
    assert cli.main(["extract", f"{drawings}/apartment.pdf", "-f", "xyz"], spark) == 2
    out = str(tmp_path / "out")
    assert cli.main(["extract", f"{drawings}/apartment.pdf", "-o", out, "-f", "json,svg,ifc,gif,geojson", "--strict"], spark) == 0
    assert "PHONG KHACH" in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"apartment.{x}" for x in ("geojson", "gif", "ifc", "json", "svg")]
    assert cli.main(["extract", f"{drawings}/bad.pdf", "-q", "-o", out], spark) == 1
    assert cli.main(["inspect", f"{drawings}/apartment.pdf", "--text", "2"], spark) == 0
    assert "scale from dimension: 1:50.0" in capsys.readouterr().out


def test_save_many(spark, models, tmp_path):
    save(outputs(models, ["json"]), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"apartment.json", "box.json"}


def test_stream(spark, drawings, tmp_path):
    q = write_models(stream_models(spark, drawings, scale="1:50"), f"{tmp_path}/t", f"{tmp_path}/c")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").where("size(rooms) > 0").count() == 2


def test_interval_operators(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(a), float(b)) for k, a, b in zip(rng.integers(0, 5, 60), rng.integers(0, 40, 60), rng.integers(0, 40, 60), strict=True)]
    df, bounds = spark.createDataFrame(rows, SPAN), spark.createDataFrame([(k, 0.0, 50.0) for k in range(7)], "k int, from double, to double")
    inside = {k: {i for q, a, b in rows if q == k for i in range(int(min(a, b)), int(max(a, b)))} for k in range(7)}
    spread = lambda d: {k: {i for r in d if r["k"] == k for i in range(int(r["lo"]), int(r["hi"]))} for k in range(7)}
    assert spread(intervals.merge(df, ["k"]).collect()) == inside
    assert spread(intervals.complement(df, ["k"], bounds).collect()) == {k: set(range(50)) - v for k, v in inside.items()}
    assert {r["k"]: r["covered"] for r in intervals.coverage(df, ["k"], bounds).collect()} == pytest.approx({k: len(v) / 50 for k, v in inside.items()})
    assert intervals.merge(df.limit(0), ["k"]).count() == 0


def test_joins(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (150, 2)))]
    p = spark.createDataFrame(pts, "i int, px double, py double").withColumn("k", F.lit(1))
    q = p.select("k", F.col("i").alias("j"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    near = {(r["i"], r["j"]) for r in joins.radius_join(p, q, ["k"], 7.0).collect()}
    assert near == {(a, b) for a, x, y in pts for b, u, v in pts if math.hypot(x - u, y - v) <= 7}
    band = [(r["i"], r["j"]) for r in joins.band_join(p, q, ["k"], "px", "qx", 2.0, 5.0).collect()]
    assert sorted(band) == sorted((a, b) for a, x, _ in pts for b, u, _ in pts if 2 <= u - x <= 5)
    v = spark.createDataFrame([(1, 10.0), (1, 10.1), (1, 10.2), (1, 30.0), (2, 5.0)], "k int, v double")
    assert {r["k"]: (r["mode"], r["support"]) for r in joins.mode_cluster(v, ["k"], "v", 0.02).collect()} == {1: (10.1, 3), 2: (5.0, 1)}


def test_graph(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 0), (2, 1)], "k int, node int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(6)] + [(2, 0, 1)], "k int, a int, b int")
    assert {r["k"]: r["connected"] for r in graph.connected(nodes, edges, ["k"]).collect()} == {1: False, 2: True}


def test_native_geometry_matches_kernels(spark):
    from plinth.functions import planar

    rings = [[0, 100, 100 + 100j, 100j], [0, 8000, 8000 + 6000j, 3000 + 6000j, 3000 + 2600j, 2600j], [0, 1], []]
    df = spark.createDataFrame([(i, [(p.real, p.imag) for p in map(complex, r)]) for i, r in enumerate(rings)], "i int, ring array<struct<x:double,y:double>>")
    c = F.col("ring")
    e = g.oriented_extent(c)
    for r in df.select("i", g.polygon_area(c).alias("a"), g.polygon_perimeter(c).alias("p"), g.polygon_centroid(c).alias("m"), g.compactness(c).alias("k"), e["long"].alias("l"), e["short"].alias("s"), g.bbox(c).alias("b")).collect():
        ring = list(map(complex, rings[r["i"]]))
        assert r["a"] == planar.polygon_area(ring) and r["p"] == pytest.approx(planar.polygon_perimeter(ring))
        assert (r["l"], r["s"]) == pytest.approx(planar.oriented_extent(ring)) and r["k"] == pytest.approx(planar.compactness(ring))
        if ring:
            m = planar.polygon_centroid(ring)
            assert (r["m"]["x"], r["m"]["y"]) == pytest.approx((m.real, m.imag)) and tuple(r["b"]) == planar.bbox(ring)


def test_native_text_matches_kernels(spark):
    said = ["PHÒNG NGỦ", "Đường 12,5 m²", "TL 1:50", "3600 mm", "D-12a", "ban công", "", None, "FFL +0.15", "1 / 200", "đ"]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    t = F.col("t")
    for r in df.select("t", tx.fold_text(t).alias("f"), tx.classify(t).alias("c"), tx.area_label(t).alias("a"), tx.scale_ratio(t).alias("s")).collect():
        assert r["f"] == words.fold_text(r["t"]) and r["c"] == words.classify(r["t"])
        assert r["a"] == words.area_label(r["t"] or "") and r["s"] == (int(m[1]) if (m := words.RATIO.search(r["t"] or "")) else None)


def test_strip_plans_have_the_declared_rooms(spark):
    part = spark.createDataFrame([(i, 1 + i % 7) for i in range(11)], "p_partkey long, p_size int")
    m = ex.extract(ex.nest(strips.primitives(part)), "1mm").orderBy("plan_id").collect()
    assert [len(r["rooms"]) for r in m] == [4, 4, 3] and [len(r["openings"]) for r in m] == [1, 1, 1]


@pytest.mark.parametrize("name", ["merge_intervals", "mode_cluster", "classify_name", "nearest_parallel", "best_match", "geojson_project", "text_owner", "decode_primitives", "decode_texts", "decode_pages", "symbol_stairs", "symbol_door_swing", "symbol_turning_circle", "symbol_dimension_chain", "symbol_window", "symbol_lift_and_parking"])
def test_queries_match_sql(spark, tmp_path, name):
    """On small tables made here; all queries are compared with their SQL by the driver."""
    rng = np.random.default_rng(5)
    import pandas as pd

    tables = {
        "part": pd.DataFrame({"p_partkey": np.arange(40), "p_name": "red bolt", "p_size": rng.integers(1, 50, 40).astype("int32"), "p_brand": "b", "p_retailprice": rng.uniform(900, 2000, 40)}),
        "customer": pd.DataFrame({"c_custkey": np.arange(60), "c_nationkey": (np.arange(60) % 5).astype("int32")}),
        "nation": pd.DataFrame({"n_nationkey": np.arange(25).astype("int32")}),
        "orders": pd.DataFrame({"o_custkey": rng.integers(0, 6, 80), "o_totalprice": rng.uniform(100, 9000, 80).round(2)}),
        "lineitem": pd.DataFrame({"l_orderkey": rng.integers(0, 20, 90), "l_partkey": rng.integers(0, 40, 90), "l_extendedprice": rng.integers(1, 5, 90).astype(float), "l_discount": rng.integers(0, 3, 90) / 10}),
        "events": pd.DataFrame({"event_id": np.arange(200), "user_id": rng.integers(0, 9, 200), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, 200), unit="s")}).astype({"ts": "datetime64[us]"}),
    }
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    order = lambda row: [(v is not None, v) for v in row]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order)
    res = con.execute(queries.ORACLES[name])
    names = [c[0] for c in res.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=order)
    assert sorted(names) == cols and got == want and want


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and "rooms_gross_area" in found


def test_intersections_and_bands_of_any_length_match_loops(spark):
    import random

    from plinth.operators import intervals, joins

    rng = random.Random(6)
    make = lambda: [(rng.randint(0, 2), float(lo := rng.randint(-50, 50)), lo + rng.choice([-3.0, 0.0, 0.5, 4.0, 60.0])) for _ in range(80)]
    a, b = make(), make()
    want = sorted((k, max(x, p), min(y, q)) for k, x, y in a for j, p, q in b if k == j and y > x and q > p and x < q and p < y)
    shape = "k int, lo double, hi double"
    left, right = spark.createDataFrame(a, shape), spark.createDataFrame(b, shape)
    for size in (3.0, 0.7, 500.0):
        assert sorted(map(tuple, intervals.intersect(left, right, ["k"], size).collect())) == want
    empty = left.limit(0)
    assert intervals.intersect(empty, right, ["k"], 1.0).count() == 0
    for low, high in ((60.0, 62.0), (-4.0, -4.0), (-0.1, 0.2)):
        got = sorted((r["k"], r["lo"], r["v"]) for r in joins.band_join(left.select("k", "lo"), right.select("k", F.col("lo").alias("v")), ["k"], "lo", "v", low, high).collect())
        assert got == sorted((k, x, p) for k, x, _ in a for j, p, _ in b if k == j and low <= p - x <= high)


def test_symbols_of_odd_rows(spark):
    """Null and empty strokes find nothing of their own; ids of any type come back as text."""
    from plinth.symbols.tables import symbols_of

    columns = "id long, strokes array<array<struct<x:double,y:double>>>, width double, thickness double, category string"
    rows = spark.createDataFrame([(1, None, 900.0, 110.0, None), (2, [], 900.0, 110.0, None), (3, [[]], 500.0, 110.0, None)], columns)
    got = {r["id"]: (r["symbol"], round(r["confidence"], 3)) for r in symbols_of(rows, "opening").collect()}
    assert got == {"1": ("opening_plain", 0.3), "2": ("opening_plain", 0.3), "3": ("opening_plain", 0.2)}
    assert symbols_of(rows, "room").isEmpty() and symbols_of(rows, "plan").isEmpty()
    assert symbols_of(rows.limit(0), "room").isEmpty()
    with pytest.raises(ValueError):
        symbols_of(rows, "door")

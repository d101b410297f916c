"""Registered plan queries: each operator on inputs encoded from the driver's tables, and SQL
that gives the answer from the same columns by arithmetic, not by the operator's own method."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.functions import text as tx
from plinth.operators import graph, intervals, joins
from plinth.operators.rounds import settled
from plinth.plans import extract as ex
from plinth.plans import sheets, strips
from plinth.sources import reader
from plinth.sources.reader import layer_histogram
from plinth.symbols.tables import symbols_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dealt(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table whose rows are few bytes and much work, dealt out anew: split by its size it would leave
    most cores idle."""
    return _t(spark, sf, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def milli(c: Column) -> Column:
    """Thousandths as a whole number, the same on both sides of a comparison."""
    return F.floor(c * 1000 + 0.5).cast("bigint")


def _models(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    return ex.extract(ex.nest(strips.primitives(part)), "1mm")


_STRIP = """with s as (select p_partkey // 4 as plan, p_partkey % 4 as k, 2000 + 100 * p_size as w, p_size % 2 = 0 as door,
 max(p_partkey % 4) over (partition by p_partkey // 4) as top from part)
"""


@query(_STRIP + "select plan::varchar as plan_id, k::int as position, (w * 4)::bigint as area_milli from s")
def rooms_gross_area(spark, sf):
    rooms = ex.child(_models(spark, sf), "rooms").select("plan_id", "area_gross_m2", F.array_min("polygon_mm.x").alias("x"))
    w = Window.partitionBy("plan_id").orderBy("x")
    return rooms.select("plan_id", (F.row_number().over(w) - 1).alias("position"), milli(F.col("area_gross_m2")).alias("area_milli"))


@query(_STRIP + "select plan::varchar as plan_id, 200 as thickness, 4::bigint as walls from s group by plan union all select plan::varchar, 100, max(top) from s where top > 0 group by plan")
def wall_thicknesses(spark, sf):
    walls = ex.child(_models(spark, sf), "walls")
    return walls.groupBy("plan_id", F.round("thickness_mm").cast("int").alias("thickness")).agg(F.count("*").alias("walls"))


@query(_STRIP + "select plan::varchar as plan_id, k::int as position, 900000::bigint as width_milli, 'opening_plain' as symbol, 300::bigint as confidence_milli from s where door and k < top")
def wall_openings(spark, sf):
    models = _models(spark, sf)
    found = ex.child(models, "openings").select("plan_id", "width_mm", "symbol", "confidence", F.col("centre_mm.x").alias("x"))
    ends = strips.strips(_t(spark, sf, "part")).select("plan_id", F.col("k").alias("position"), "x1")
    near = found.join(ends, "plan_id").where(F.abs(F.col("x") - F.col("x1")) < 60)
    return near.select("plan_id", "position", milli(F.col("width_mm")).alias("width_milli"), "symbol", milli(F.col("confidence")).alias("confidence_milli"))


@query(_STRIP + "select plan::varchar as plan_id, case when door then 'opening' else 'wall' end as kind, count(*)::bigint as edges, (4000 * count(*))::bigint as shared_milli from s where k < top group by all")
def room_graph_edges(spark, sf):
    edges = ex.child(_models(spark, sf), "edges").where("not exterior")
    return edges.groupBy("plan_id", "kind").agg(F.count("*").alias("edges"), F.sum(milli(F.col("shared_length_m"))).alias("shared_milli"))


@query(_STRIP + "select plan::varchar as plan_id, coalesce(bool_and(door) filter (where k < top), true) as connected from s group by plan")
def graph_connected(spark, sf):
    # written, since both sides read it and plans would be extracted twice
    models = settled(_models(spark, sf).select("plan_id", F.col("rooms.id").alias("nodes"), "edges"))
    nodes = models.select("plan_id", F.explode("nodes").alias("node"))
    edges = ex.child(models, "edges").where("not exterior and kind <> 'wall'")
    return graph.connected(nodes, edges, ["plan_id"])


@query(_STRIP + "select plan::varchar as plan_id, count(*) filter (where k < top and door)::bigint * 2 as steps from s group by plan having steps > 0")
def walkable_neighbours(spark, sf):
    return graph.neighbours(ex.child(_models(spark, sf), "edges"), ["plan_id"]).groupBy("plan_id").agg(F.count("*").alias("steps"))


@query(_STRIP + "select plan::varchar as plan_id, count(*)::bigint as rooms, (top + 4)::bigint as walls, count(*) filter (where door and k < top)::bigint as openings, sum(w * 4)::bigint as total_milli from s group by plan, top")
def model_summary(spark, sf):
    m = _models(spark, sf)
    total = F.aggregate("rooms", F.lit(0.0), lambda a, r: a + r["area_gross_m2"])
    return m.select("plan_id", *[F.size(c).cast("bigint").alias(c) for c in ("rooms", "walls", "openings")], milli(total).alias("total_milli"))


@query(_STRIP + """, c as (select plan, count(*) filter (where door and k < top) as weak, coalesce(bool_and(door) filter (where k < top), true) as ok from s group by plan)
select plan::varchar as plan_id, (1 + (weak > 0)::int + (not ok)::int + 1)::bigint as warnings from c""")
def audit_counts(spark, sf):
    """No room has a label, weak openings, a graph that isn't connected, no entrance."""
    return ex.warnings_of(_models(spark, sf)).groupBy("plan_id").agg(F.count("*").alias("warnings"))


def _spans(spark, sf, side: int | None = None) -> DataFrame:
    """Six hours from each event; the two sides of the intersection are events of even and odd id."""
    e = _t(spark, sf, "events")
    if side is not None:
        e = e.where(F.col("event_id") % 2 == side)
    return e.select("user_id", F.unix_timestamp("ts").cast("double").alias("lo")).withColumn("hi", F.col("lo") + 3600 * 6)


_SPAN = "(select user_id, floor(epoch(ts))::bigint as lo, floor(epoch(ts))::bigint + 21600 as hi from events{})"
_SIDES = [_SPAN.format(f" where event_id % 2 = {i}") for i in (0, 1)]
_MERGED = """, m as (select *, case when lo <= max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from x),
 i as (select *, sum(f) over (partition by user_id order by lo, hi rows unbounded preceding) as n from m), u as (select user_id, min(lo) as lo, max(hi) as hi from i group by user_id, n)"""


@query(f"with x as {_SPAN.format("")} {_MERGED} select user_id, lo, hi from u")
def merge_intervals(spark, sf):
    return intervals.merge(_spans(spark, sf), ["user_id"]).select("user_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


@query(f"with x as {_SPAN.format("")} {_MERGED}, b as (select user_id, min(lo) - 100 as f, max(hi) + 100 as t from u group by user_id), g as (select user_id, hi as lo, lead(lo) over (partition by user_id order by lo) as hi from u) select user_id, lo, hi from g where hi is not null union all select user_id, f, f + 100 from b union all select user_id, t - 100, t from b")
def complement_gaps(spark, sf):
    s = _spans(spark, sf)
    bounds = s.groupBy("user_id").agg((F.min("lo") - 100).alias("from"), (F.max("hi") + 100).alias("to"))
    return intervals.complement(s, ["user_id"], bounds).select("user_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


@query(f"with a as {_SIDES[0]}, b as {_SIDES[1]} select a.user_id, greatest(a.lo, b.lo) as lo, least(a.hi, b.hi) as hi from a join b on a.user_id = b.user_id and a.lo < b.hi and b.lo < a.hi")
def intersect_intervals(spark, sf):
    found = intervals.intersect(_spans(spark, sf, 0), _spans(spark, sf, 1), ["user_id"], 3600.0 * 6)
    return found.select("user_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


@query(f"with x as {_SPAN.format("")} {_MERGED} select user_id, floor(sum(hi - lo)::double / (max(hi) - min(lo)) * 1000 + 0.5)::bigint as covered_milli from u group by user_id")
def interval_coverage(spark, sf):
    s = _spans(spark, sf)
    bounds = s.groupBy("user_id").agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
    return intervals.coverage(s, ["user_id"], bounds).select("user_id", milli(F.col("covered")).alias("covered_milli"))


@query("with t as (select user_id, floor(epoch(ts))::double as v from events), l as (select user_id, v - lag(v) over (partition by user_id order by v) as d from t) select user_id, count(*)::bigint as n, floor(avg(d) * 1000 + 0.5)::bigint as pitch_milli, floor(stddev_pop(d) / avg(d) * 1000 + 0.5)::bigint as cv_milli from l where d > 0 group by user_id")
def rhythm_cv(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.unix_timestamp("ts").cast("double").alias("v"))
    return intervals.rhythm(e, ["user_id"], "v").select("user_id", "n", milli(F.col("pitch")).alias("pitch_milli"), milli(F.col("cv")).alias("cv_milli"))


@query("with t as (select user_id, floor(epoch(ts))::double as v from events), l as (select *, case when v - lag(v) over (partition by user_id order by v) <= 86400 then 0 else 1 end as f from t) select user_id, sum(f)::bigint as sessions from l group by user_id")
def sessions_by_gap(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.unix_timestamp("ts").cast("double").alias("v"))
    return intervals.sessions(e, ["user_id"], "v", 86400.0).groupBy("user_id").agg(F.max("session").cast("bigint").alias("sessions"))


@query("""with o as (select o_custkey, o_totalprice as v from orders), n as (select a.o_custkey, a.v, count(*) as c from (select distinct o_custkey, v from o) a join o b on a.o_custkey = b.o_custkey and abs(b.v - a.v) <= 0.25 * a.v + 1e-9 group by all),
 d as (select o_custkey, v, c, row_number() over (partition by o_custkey order by c desc, v) as r from n)
select d.o_custkey, floor(median(o.v) * 1000 + 0.5)::bigint as mode_milli, any_value(d.c)::bigint as support from d join o on d.o_custkey = o.o_custkey and abs(o.v - d.v) <= 0.25 * d.v + 1e-9 where d.r = 1 group by d.o_custkey""")
def mode_cluster(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("v"))
    return joins.mode_cluster(o, ["o_custkey"], "v", 0.25).select("o_custkey", milli(F.col("mode")).alias("mode_milli"), "support")


@query("select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and b.p_retailprice - a.p_retailprice between 60 and 62 where a.p_partkey <> b.p_partkey")
def band_join(spark, sf):
    p = _t(spark, sf, "part")
    left = p.select("p_brand", F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("va"))
    right = p.select("p_brand", F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("vb"))
    return joins.band_join(left.hint("merge"), right, ["p_brand"], "va", "vb", 60.0, 62.0).where("a <> b").select("a", "b")


_XY = "select c_custkey as id, c_nationkey as n, (c_custkey * 37 % 1000)::double as x, (c_custkey * 91 % 1000)::double as y from customer"


def _spots(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    return _t(spark, sf, "customer").select(key.alias("id"), F.col("c_nationkey").alias("n"), (key * 37 % 1000).cast("double").alias("x"), (key * 91 % 1000).cast("double").alias("y"))


@query(f"with p as ({_XY}) select a.id as a, b.id as b from p a join p b on a.n = b.n and a.id < b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2500")
def radius_join(spark, sf):
    p = _spots(spark, sf)
    left, right = p.select("n", F.col("id").alias("a"), F.col("x").alias("px"), F.col("y").alias("py")), p.select("n", F.col("id").alias("b"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return joins.radius_join(left, right, ["n"], 50.0).where("a < b").select("a", "b")


def _ring(points) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


_SHAPE = [(100, 100), (900, 100), (900, 500), (400, 500), (400, 900), (100, 900)]


@query(f"with p as ({_XY}) select id, (x >= 100 and x < 900 and y >= 100 and y < 500) or (x >= 100 and x < 400 and y >= 500 and y < 900) as inside from p")
def point_in_polygon(spark, sf):
    """Half-open on both axes: a point on a lower or left side is inside, on an upper or right one outside."""
    return _spots(spark, sf).select("id", g.point_in_polygon(F.col("x"), F.col("y"), _ring(_SHAPE)).alias("inside"))


@query(f"with p as ({_XY}) select id, (floor(x / 250) * 4 + floor(y / 250))::bigint as owner from p")
def text_owner(spark, sf):
    """Labels to the room that holds them: a grid join on boxes, then the exact test."""
    points = _spots(spark, sf).select("id", F.lit(1).alias("plan"), F.col("x").alias("px"), F.col("y").alias("py"))
    rooms = spark.range(16).select(F.lit(1).alias("plan"), F.col("id").alias("owner"), (F.floor(F.col("id") / 4) * 250.0).alias("x0"), (F.col("id") % 4 * 250.0).alias("y0")).withColumns({"x1": F.col("x0") + 250, "y1": F.col("y0") + 250})
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    held = joins.box_join(points, rooms, ["plan"], 250.0).where(g.point_in_polygon(F.col("px"), F.col("py"), F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))))
    return joins.best_per(held, ["id"], [F.asc("owner")]).select("id", "owner")


@query("select p_partkey, (2 * p_size + 4)::bigint * 1000 as perimeter_milli, p_size::bigint * 2000 as area_milli, p_size::bigint * 500 as cx_milli, 1000::bigint as cy_milli, greatest(p_size, 2)::bigint * 1000 as long_milli, least(p_size, 2)::bigint * 1000 as short_milli from part")
def polygon_measures(spark, sf):
    s = F.col("p_size").cast("double")
    ring = F.array(*[F.struct(x.alias("x"), F.lit(y).alias("y")) for x, y in ((F.lit(0.0), 0.0), (s, 0.0), (s, 2.0), (F.lit(0.0), 2.0))])
    p = _dealt(spark, sf, "part", "p_partkey").select("p_partkey", ring.alias("ring"))
    c, e = g.polygon_centroid(F.col("ring")), g.oriented_extent(F.col("ring"))
    return p.select("p_partkey", milli(g.polygon_perimeter(F.col("ring"))).alias("perimeter_milli"), milli(g.polygon_area(F.col("ring"))).alias("area_milli"), milli(c["x"]).alias("cx_milli"), milli(c["y"]).alias("cy_milli"), milli(e["long"]).alias("long_milli"), milli(e["short"]).alias("short_milli"))


@query("select p_partkey, floor(pi() * 2 * p_size / (4 * (p_size + 2.0) ** 2) * 4 * 1000 + 0.5)::bigint as compact_milli from part")
def compactness(spark, sf):
    s = F.col("p_size").cast("double")
    ring = F.array(*[F.struct(x.alias("x"), F.lit(y).alias("y")) for x, y in ((F.lit(0.0), 0.0), (s, 0.0), (s, 2.0), (F.lit(0.0), 2.0))])
    return _t(spark, sf, "part").select("p_partkey", milli(g.compactness(ring)).alias("compact_milli"))


@query("select s_suppkey, (s_suppkey * 10)::bigint * 1000 as cx_milli, s_nationkey::bigint * 1000 as cy_milli, (100 + s_suppkey)::bigint * 1000 as r_milli from supplier")
def circle_fit(spark, sf):
    s = _t(spark, sf, "supplier")
    arc = g.arc_points(F.col("s_suppkey") * 10.0, F.col("s_nationkey").cast("double"), 100.0 + F.col("s_suppkey"), F.lit(0.3), F.lit(2.4))
    pts = s.select("s_suppkey", F.explode(arc).alias("p"))
    fit = pts.groupBy("s_suppkey").agg(*g.circle_sums(F.col("p.x") - F.col("s_suppkey") * 10, F.col("p.y")).values()).select("s_suppkey", g.circle_from().alias("c"))
    return fit.select("s_suppkey", milli(F.round(F.col("c.cx") + F.col("s_suppkey") * 10, 4)).alias("cx_milli"), milli(F.round("c.cy", 4)).alias("cy_milli"), milli(F.round("c.r", 4)).alias("r_milli"))


@query(f"with p as ({_XY}) select id, floor(case when x <= 300 then sqrt((x - 300) ** 2 + (y - 400) ** 2) when x >= 700 then sqrt((x - 700) ** 2 + (y - 400) ** 2) else abs(y - 400) end * 1000 + 0.5)::bigint as d_milli from p")
def point_segment_distance(spark, sf):
    a = [F.lit(v) for v in (300.0, 400.0, 700.0, 400.0)]
    return _spots(spark, sf).select("id", milli(g.point_seg_distance(F.col("x"), F.col("y"), *a)).alias("d_milli"))


@query(f"with p as ({_XY}) select id, case when x between 100 and 900 then floor(x * 1000 + 0.5)::bigint end as x_milli from p")
def segment_intersection(spark, sf):
    x, v = F.col("x"), [F.lit(k) for k in (100.0, 500.0, 900.0, 500.0)]
    hit = g.seg_intersection(x, F.lit(0.0), x, F.lit(1000.0), *v)
    return _spots(spark, sf).select("id", milli(hit["x"]).alias("x_milli"))


@query("""with s as (select n_nationkey as k, n_nationkey * 40.0 as y from nation), p as (select c_custkey as id, (c_custkey * 91 % 1000)::double as y from customer),
 d as (select id, k, abs(p.y - s.y) as d, row_number() over (partition by id order by abs(p.y - s.y), k) as r from p join s on abs(p.y - s.y) <= 100) select id, k as nearest, floor(d * 1000 + 0.5)::bigint as d_milli from d where r = 1""")
def nearest_parallel(spark, sf):
    """Each label's nearest line: a band join on the offset, then the first of each label."""
    lines = _t(spark, sf, "nation").select(F.lit(1).alias("plan"), F.col("n_nationkey").alias("nearest"), (F.col("n_nationkey") * 40.0).alias("line"))
    points = _spots(spark, sf).select(F.lit(1).alias("plan"), "id", "y")
    near = joins.band_join(points, lines, ["plan"], "y", "line", -100.0, 100.0).withColumn("d", F.abs(F.col("y") - F.col("line")))
    return joins.best_per(near, ["id"], [F.asc("d"), F.asc("nearest")]).select("id", "nearest", milli(F.col("d")).alias("d_milli"))


@query("select l_orderkey, arg_max(l_partkey, (l_extendedprice, l_discount, -l_partkey)) as l_partkey from lineitem group by l_orderkey")
def best_match(spark, sf):
    """One winner of each opening: confidence, then priority, then the smaller id."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    return joins.best_per(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.desc("l_discount"), F.asc("l_partkey")]).select("l_orderkey", "l_partkey")


_CATALOGUE = [("small", 1, 10, 900, 1300), ("medium", 8, 30, 1000, 1800), ("large", 25, 50, 900, 2200)]


@query("with c(name, ord, a, b, lo, hi) as (values " + ", ".join(f"('{n}', {i}, {a}, {b}, {lo}, {hi})" for i, (n, a, b, lo, hi) in enumerate(_CATALOGUE)) + "), m as (select p_brand, p_partkey, p_size, arg_min(name, ord) as name from part join c on p_size between a and b and p_retailprice between lo and hi group by all) select p_brand, name, count(*)::bigint as n, floor(median(p_size) * 1000 + 0.5)::bigint as median_milli, floor(coalesce(stddev_pop(p_size) / avg(p_size), 0) * 1000 + 0.5)::bigint as cv_milli from m group by all")
def size_catalogue(spark, sf):
    """Sizes against a small catalogue (first row that fits), then counts and spread by scope."""
    told = F.lit(None).cast("string")
    for n, a, b, lo, hi in reversed(_CATALOGUE):
        told = F.when(F.col("p_size").between(a, b) & F.col("p_retailprice").between(lo, hi), n).otherwise(told)
    m = _t(spark, sf, "part").select("p_brand", told.alias("name"), "p_size").where("name is not null")
    return m.groupBy("p_brand", "name").agg(F.count("*").alias("n"), milli(F.median("p_size")).alias("median_milli"), milli(F.coalesce(F.try_divide(F.stddev_pop("p_size"), F.avg("p_size")), F.lit(0.0))).alias("cv_milli"))


@query("select l_returnflag as plan_id, coalesce(l_linestatus, '') as layer, count(*)::bigint as n from lineitem group by all")
def layer_counts(spark, sf):
    p = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("plan_id"), F.col("l_linestatus").alias("layer"))
    return layer_histogram(p)


@query("with f as (select doc_id, trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'd')), '[^a-z0-9 ]+', ' ', 'g'), ' ') as t from documents) select doc_id, length(t)::bigint as n, md5(t) as folded from f where doc_id is not null")
def fold_label(spark, sf):
    t = tx.fold_words(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t.cast("binary")).alias("folded"))


_NAMES = ["PHÒNG NGỦ", "Phòng khách", "BẾP", "WC", "Ban công", "Zzzz", "Sảnh", "LAB 2", "Kho", "Gara xe", "VỆ--SINH", "ban.-cong"]
_TOLD = ["bedroom", "living", "kitchen", "bathroom", "balcony", "other", "hall", "lab", "storage", "garage", "bathroom", "balcony"]


@query("select p_partkey, (" + "case p_partkey % 13 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_TOLD)) + " else 'unknown' end) as category from part")
def classify_name(spark, sf):
    name = F.lit(None).cast("string")
    for i, n in enumerate(_NAMES):
        name = F.when(F.col("p_partkey") % 13 == i, n).otherwise(name)
    return _t(spark, sf, "part").select("p_partkey", tx.classify(name).alias("category"))


@query("select p_partkey, p_size::bigint * 1000 + 500 as area_milli, case when p_size between 5 and 500 then p_size end as ratio, case when 100 * p_size >= 300 then 100 * p_size end as dimension from part")
def label_values(spark, sf):
    s = F.col("p_size").cast("string")
    p = _t(spark, sf, "part")
    return p.select("p_partkey", milli(tx.area_label(F.concat(F.lit("A = "), s, F.lit(",5 m²")))).alias("area_milli"), tx.scale_ratio(F.concat(F.lit("TL 1 : "), s)).alias("ratio"), tx.dimension_value(F.concat(s, F.lit("00 mm"))).alias("dimension"))


@query("select p_partkey, [p_size / 100.0, -1.5] as levels, p_size::varchar as reference from part")
def level_and_schedule(spark, sf):
    s = F.format_string("+%d.%02d", F.floor(F.col("p_size") / 100).cast("int"), F.col("p_size") % 100)
    text = F.concat(F.lit("FFL "), s, F.lit(" / SSL - 1,50"))
    text = F.replace(text, F.lit("- 1,50"), F.lit("-1,50"))
    return _t(spark, sf, "part").select("p_partkey", tx.level_values(text).alias("levels"), tx.schedule_reference(F.concat(F.lit("D-"), F.col("p_size").cast("string"))).alias("reference"))


@query(f"with p as ({_XY}) select id, floor(round(105.8342 + degrees(x / (6378137.0 * cos(radians(21.0278)))), 9) * 1e6 + 0.5)::bigint as lon, floor(round(21.0278 + degrees(y / 6378137.0), 9) * 1e6 + 0.5)::bigint as lat from p")
def geojson_project(spark, sf):
    at = g.to_lon_lat(F.col("x") * 1000, F.col("y") * 1000, 21.0278, 105.8342)
    e6 = lambda c: F.floor(c * 1e6 + 0.5).cast("bigint")
    return _spots(spark, sf).select("id", e6(at["lon"]).alias("lon"), e6(at["lat"]).alias("lat"))


@query("""with recursive c as (select distinct floor((c_custkey * 37 % 1000) / 20)::int as x, floor((c_custkey * 91 % 1000) / 20)::int as y from customer),
 n as (select x * 50 + y as id, x, y from c), r(a, b) as (select id, id from n union select r.a, m.id from r join n k on k.id = r.b join n m on abs(m.x - k.x) <= 1 and abs(m.y - k.y) <= 1)
select a::bigint as node, min(b)::bigint as component from r group by a""")
def hatch_components(spark, sf):
    """Components of touching cells: 3 x 3 neighbour keys, then labels along the edges."""
    c = _spots(spark, sf).select(F.floor(F.col("x") / 20).alias("x"), F.floor(F.col("y") / 20).alias("y")).distinct()
    cell = c.select((F.col("x") * 50 + F.col("y")).alias("node"), "x", "y")
    near = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    around = cell.select(F.col("node").alias("a"), near.alias("q")).select("a", F.col("q.x").alias("x"), F.col("q.y").alias("y"))
    edges = around.join(cell.withColumnRenamed("node", "b"), ["x", "y"]).select(F.lit(1).alias("plan"), "a", "b")
    return graph.components(cell.select(F.lit(1).alias("plan"), "node"), edges, ["plan"]).select("node", "component")


@query("select c_custkey, floor(case when d > pi() then d - 2 * pi() else d end * 1000 + 0.5)::bigint as diff_milli, least(f, pi() - f) <= radians(2) as parallel from (select c_custkey, u - floor(u / (2 * pi())) * 2 * pi() as d, u - floor(u / pi()) * pi() as f from (select c_custkey, (c_custkey % 360 - c_custkey * 7 % 360 + 0.5) * pi() / 180 as u from customer))")
def angles(spark, sf):
    a, b = F.radians(F.col("c_custkey") % 360 + 0.5), F.radians(F.col("c_custkey") * 7 % 360)
    d = g.angle_diff(a, b)
    return _t(spark, sf, "customer").select("c_custkey", milli(d).alias("diff_milli"), g.is_parallel(F.cos(a), F.sin(a), F.cos(b), F.sin(b), 2.0).alias("parallel"))


@query(_STRIP + "select plan::varchar as plan_id, count(*)::bigint as rooms, (top + 4)::bigint as walls, count(*) filter (where door and k < top)::bigint as openings, floor(sum(w * 4) / 1000.0 * 1000 + 0.5)::bigint as total_milli, count(*) filter (where k < top)::bigint as edges, coalesce(bool_and(door) filter (where k < top), true) as connected from s group by plan, top")
def export_json(spark, sf):
    """Values read back from the JSON documents."""
    from plinth.sinks.documents import json_documents

    doc = json_documents(_models(spark, sf))
    value = lambda path: F.get_json_object("document", path)
    count = lambda path: F.size(F.from_json(value(path), "array<string>")).cast("bigint")
    counts = [value(f"$.summary.{c}").cast("bigint").alias(c) for c in ("rooms", "walls", "openings")]
    total = milli(value("$.summary.total_area_m2").cast("double")).alias("total_milli")
    return doc.select("plan_id", *counts, total, count("$.graph.edges").alias("edges"), value("$.graph.connected").cast("boolean").alias("connected"))


@query(_STRIP + """, n as (select plan, k, w, sum(w) over (partition by plan order by k) - w as x0, (k > 0 and coalesce(lag(door) over (partition by plan order by k), false))::int + (k < top and door)::int as near from s)
select plan::varchar as plan_id, x0::bigint as left_mm, 0::bigint as bottom_mm, (w * 4)::bigint as area_milli, near::bigint as neighbours from n""")
def export_geojson(spark, sf):
    """Room features read back from the GeoJSON documents: the ring's least corner, seen from the
    least corner of the plan, area and walkable neighbours."""
    from plinth.sinks.documents import geojson_documents

    doc = geojson_documents(_models(spark, sf), include=("rooms",))
    shape = "features array<struct<id:string,geometry:struct<coordinates:array<array<array<double>>>>,properties:struct<area_gross_m2:double,neighbours:array<string>>>>"
    f = doc.select("plan_id", F.explode(F.from_json("document", shape)["features"]).alias("f"))
    least = lambda k: F.floor(F.array_min(F.transform(F.col("f.geometry.coordinates")[0], lambda p: p[k])) * 1000 + 0.5).cast("bigint")
    return f.select("plan_id", least(0).alias("left_mm"), least(1).alias("bottom_mm"), milli(F.col("f.properties.area_gross_m2")).alias("area_milli"), F.size("f.properties.neighbours").cast("bigint").alias("neighbours"))


@query(None)
def export_files(spark, sf):
    """IFC, SVG and GIF of every plan."""
    from plinth.sinks.files import render

    made = render(_models(spark, sf), ["ifc", "svg", "gif"])
    return made.select("plan_id", "format", F.length("content").cast("bigint").alias("bytes"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    files = sheets.sheets(_dealt(spark, sf, "part", "p_partkey"))
    return reader.decode(files)


# sums of a shape's n points on the page that is turned back
_TURNED = """case p_partkey % 4 when 0 then x when 1 then y when 2 then 600 * n - x else 800 * n - y end as x,
 case p_partkey % 4 when 0 then y when 1 then 600 * n - x when 2 then 800 * n - y else x end as y"""
_SHEET = """with s as (select p_partkey, p_name, p_size::bigint as size, p_partkey % 100 as k from part), p as (
 select p_partkey, 0 as prim_id, 2 as n, 2 * k + size as x, 20 as y, false as closed, false as filled, 2 as width, null as layer from s
 union all select p_partkey, 1, 4, 440 + 4 * size, 480 + 4 * size, true, true, 4, null from s
 union all select p_partkey, 2, 3, 900 + 2 * size, 910, true, false, 2, 'A-WALL' from s
 union all select p_partkey, 3, 2, 630, 630, false, false, 2, 'A-WALL' from s
 union all select p_partkey, 4, 2, 40 + 2 * size, 10 + k, false, false, 2, null from s),
"""


@query(_SHEET + "o as (select * replace (x - 5 * n as x, y - 7 * n as y) from p), r as (select * exclude (x, y), " + _TURNED + """ from o)
select p_partkey::varchar || '#0' as plan_id, prim_id::int as prim_id, n::int as points, (1000 * x)::bigint as x_milli, (1000 * y)::bigint as y_milli, closed, filled, (1000 * width)::bigint as width_milli, layer from r""")
def decode_primitives(spark, sf):
    """Paths of a PDF of each part: the sums of their points, and their paint, width and layer."""
    found = reader.primitives_of(_pages(spark, sf))
    total = lambda c: milli(F.aggregate(f"points.{c}", F.lit(0.0), lambda a, v: a + v))
    return found.select("plan_id", "prim_id", F.size("points").alias("points"), total("x").alias("x_milli"), total("y").alias("y_milli"), "closed", "filled", milli(F.col("width")).alias("width_milli"), "layer")


@query("with t as (select p_partkey, 0 as text_id, p_name as text, 1 as n, p_partkey % 100 - 5 as x, 493 as y from part union all select p_partkey, 1, '#' || p_partkey, 1, p_partkey % 100 - 5, 479 from part), r as (select * exclude (x, y), " + _TURNED + """ from t)
select p_partkey::varchar || '#0' as plan_id, text_id::int as text_id, text, (1000 * x)::bigint as x_milli, (1000 * y)::bigint as y_milli, 12000::bigint as height_milli, ([0, -90, 180, 90])[1 + p_partkey % 4]::bigint as angle from r""")
def decode_texts(spark, sf):
    """Texts of a PDF of each part: place, height and direction in degrees, over -180."""
    found = reader.texts_of(_pages(spark, sf))
    turn = F.round(F.degrees("angle")).cast("bigint")
    return found.select("plan_id", "text_id", "text", milli(F.col("x")).alias("x_milli"), milli(F.col("y")).alias("y_milli"), milli(F.col("height")).alias("height_milli"), F.when(turn == -180, 180).otherwise(turn).alias("angle"))


@query("select p_partkey::varchar || '#0' as plan_id, (case p_partkey % 2 when 0 then 600 else 800 end)::bigint as wide, (case p_partkey % 2 when 0 then 800 else 600 end)::bigint as high, 5::bigint as primitives, 2::bigint as texts, true as readable from part")
def decode_pages(spark, sf):
    """The turned box of each page, and what it holds."""
    size = [F.size(c).cast("bigint").alias(c) for c in ("primitives", "texts")]
    return _pages(spark, sf).select("plan_id", F.col("box.x1").cast("bigint").alias("wide"), F.col("box.y1").cast("bigint").alias("high"), *size, F.col("error").isNull().alias("readable"))


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").repartition(spark.sparkContext.defaultParallelism).withColumn("id", F.col("p_partkey").cast("string"))


def _at(x, y) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def _arc(x: float, radius: Column, degrees: int, steps: int) -> Column:
    turn = lambda i: F.radians(i * F.lit(degrees / steps))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: _at(x + radius * F.cos(turn(i)), radius * F.sin(turn(i))))


def _meta(name: str, kind: str) -> Column:
    return F.get_json_object("meta", f"$.{name}").cast(kind)


def _whole(name: str) -> Column:
    return F.round(_meta(name, "double")).cast("bigint").alias(name)


@query("""with s as (select p_partkey, 3 + p_size % 12 as n, 210 + 10 * (p_partkey % 19) as going from part)
select p_partkey::varchar as id, n::bigint as treads, going::bigint as going, 1000::bigint as flight_width, floor(1000 * least(0.95, 0.7 + 0.25 * least(1, (n - 3) / 6)) + 0.5)::bigint as confidence_milli from s""")
def symbol_stairs(spark, sf):
    """Flights of parallel treads, found by the library's detector."""
    treads = F.transform(F.sequence(F.lit(0), 2 + F.col("p_size") % 12), lambda i: F.array(_at(0, i * (210 + 10 * (F.col("p_partkey") % 19))), _at(1000, i * (210 + 10 * (F.col("p_partkey") % 19)))))
    found = symbols_of(_drawn(spark, sf).select("id", treads.alias("strokes")), "room").where("symbol = 'stairs'")
    return found.select("id", _whole("treads"), _whole("going"), _whole("flight_width"), milli(F.col("confidence")).alias("confidence_milli"))


@query("""with s as (select p_partkey, 650 + 10 * p_size as r, p_partkey % 2 = 0 as leaf from part)
select p_partkey::varchar as id, 'door_swing' as symbol, 'door' as kind, r::bigint as leaf_width, leaf, floor(1000 * least(0.98, 0.95 - 0.2 * abs(r / 900 - 1) / 0.35 + case when leaf then 0.05 else 0 end) + 0.5)::bigint as confidence_milli from s""")
def symbol_door_swing(spark, sf):
    """The best symbol of an opening of 900 mm with a quarter arc about a jamb, every other with its leaf."""
    r = (650 + 10 * F.col("p_size")).cast("double")
    arc = _arc(-450.0, r, 90, 16)
    leaf = F.array(_at(-450, 0), _at(-450, r))
    strokes = F.when(F.col("p_partkey") % 2 == 0, F.array(arc, leaf)).otherwise(F.array(arc))
    found = symbols_of(_drawn(spark, sf).select("id", strokes.alias("strokes"), F.lit(900.0).cast("double").alias("width"), F.lit(110.0).cast("double").alias("thickness")), "opening")
    return found.select("id", "symbol", "kind", _whole("leaf_width"), _meta("leaf_line", "boolean").alias("leaf"), milli(F.col("confidence")).alias("confidence_milli"))


@query("""with s as (select p_partkey, 1305 + 10 * p_size as d from part)
select p_partkey::varchar as id, d::bigint as diameter, case when abs(d - 1500) <= 120 then 860 else 780 end::bigint as confidence_milli from s where d between 1400 and 1900""")
def symbol_turning_circle(spark, sf):
    """Clear wheelchair circles; those that are too small are none."""
    ring = _arc(3000.0, (1305 + 10 * F.col("p_size")) / F.lit(2.0), 360, 32)
    found = symbols_of(_drawn(spark, sf).select("id", F.array(ring).alias("strokes")), "room").where("symbol = 'turning_circle'")
    return found.select("id", _whole("diameter"), milli(F.col("confidence")).alias("confidence_milli"))


@query("""with s as (select p_partkey, 2 + p_partkey % 4 as n, 6000 + 10 * p_size as v from part)
select p_partkey::varchar as id, floor(1000 * least(0.92, 0.7 + 0.08 * least(2, n - 2) + case when abs((6000 - v) / v) <= 0.02 then 0.1 else 0 end) + 0.5)::bigint as confidence_milli from s""")
def symbol_dimension_chain(spark, sf):
    """Dimensions in a row, whose sum fits what is drawn in some plans only."""
    i = F.sequence(F.lit(0), (1 + F.col("p_partkey") % 4).cast("int"))
    links = F.transform(i, lambda k: F.array(_at(6000 * k, 0), _at(6000 * (k + 1), 0)))
    text = (6000 + 10 * F.col("p_size")).cast("string")
    texts = F.transform(i, lambda k: F.struct(text.alias("text"), (3000.0 + 6000 * k).cast("double").alias("x"), F.lit(100.0).cast("double").alias("y"), F.lit(200.0).cast("double").alias("height")))
    found = symbols_of(_drawn(spark, sf).select("id", links.alias("strokes"), texts.alias("texts")), "plan").where("symbol = 'dimension_chain'")
    return found.select("id", milli(F.col("confidence")).alias("confidence_milli"))


def _box(x, y, w, h) -> Column:
    return F.array(_at(x, y), _at(x + w, y), _at(x + w, y + h), _at(x, y + h), _at(x, y))


@query("""with s as (select p_partkey, 2 + p_partkey % 3 as n, (60 + 2 * (p_size % 20)) / 100 as cover from part)
select p_partkey::varchar as id, 'window' as symbol, n::bigint as glazing_lines, (1000 * cover)::bigint as coverage_milli, floor(1000 * least(0.95, 0.55 + 0.1 * least(2, n - 2) + 0.25 * cover) + 0.5)::bigint as confidence_milli from s""")
def symbol_window(spark, sf):
    """The best symbol of an opening of 1200 mm with two to four panes that cover a part of it."""
    n, half = 2 + F.col("p_partkey") % 3, 6.0 * (60 + 2 * (F.col("p_size") % 20))
    y = lambda k: (80.0 * k / (n - 1) - 40).cast("double")
    panes = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.array(_at(-half, y(k)), _at(half, y(k))))
    found = symbols_of(_drawn(spark, sf).select("id", panes.alias("strokes"), F.lit(1200.0).cast("double").alias("width"), F.lit(110.0).cast("double").alias("thickness")), "opening")
    return found.select("id", "symbol", _whole("glazing_lines"), milli(_meta("coverage", "double")).alias("coverage_milli"), milli(F.col("confidence")).alias("confidence_milli"))


@query("""select p_partkey::varchar as id, 'lift' as symbol, floor(1000 * (0.82 + 0.08 * (3000 - abs(1200 + 20 * p_size - 1600)) / 3000) + 0.5)::bigint as confidence_milli from part
union all select p_partkey::varchar, 'parking_bay', (660 + 80 * least(2, p_partkey % 4))::bigint from part where p_partkey % 4 > 0""")
def symbol_lift_and_parking(spark, sf):
    """A crossed car and a row of one to four parking bays in each room; one bay alone is none."""
    long, short = 1200 + 20 * F.col("p_size"), 1000 + 16 * F.col("p_size")
    car = [_box(F.lit(0), F.lit(0), long, short), F.array(_at(0, 0), _at(long, short)), F.array(_at(0, short), _at(long, 0))]
    bays = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int")), lambda k: _box(10000 + 2500 * k, F.lit(0), F.lit(2400), F.lit(5000)))
    found = symbols_of(_drawn(spark, sf).select("id", F.concat(F.array(*car), bays).alias("strokes")), "room").where("symbol in ('lift', 'parking_bay')")
    return found.select("id", "symbol", milli(F.col("confidence")).alias("confidence_milli"))

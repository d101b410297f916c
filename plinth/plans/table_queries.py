"""Registered queries of the operators that work on tables of plans, each on inputs encoded from whole
tables, with SQL that gets the answer by arithmetic, by all pairs, or row by row in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import geometry as g
from plinth.operators import rounds, segments
from plinth.plans import room_tables, scale_tables, strips, wall_tables
from plinth.plans.queries import _dealt, _spots, _t, milli, query
from plinth.symbols import chains, detectors

PLAN = ["plan"]


def _d(value) -> F.Column:
    return (value if isinstance(value, F.Column) else F.lit(float(value))).cast("double")


def _segment(ax, ay, bx, by) -> F.Column:
    return F.struct(_d(ax).alias("ax"), _d(ay).alias("ay"), _d(bx).alias("bx"), _d(by).alias("by"))


@query("""with d as (select p_partkey, 2 + p_size % 9 as m from part)
select p_partkey, least(m, 8)::bigint as facets, (least(m, 8) + 1)::bigint as corners from d where m <= 9""")
def facet_chains(spark, sf):
    """The concertina of an opening of each part: two to ten leaves from jamb to jamb, drawn with small
    gaps, an end that leads nowhere drawn first, and one short cut from the second corner to the fourth."""
    k, s = F.col("p_partkey"), F.col("p_size")
    m, width = (2 + s % 9).cast("double"), (900 + 10 * (k % 50)).cast("double")
    x = lambda i: -width / 2 + width * i / m
    y = lambda i: F.when(F.lit(i % 2 == 1) & (m != i), 300.0).otherwise(0.0)
    leaf = lambda i: F.when(m > i, _segment(x(i), y(i), x(i + 1) + 5, y(i + 1)))
    lost = _segment(x(1) + 60, 900, x(1), y(1))
    drawn = F.array(lost, *[leaf(i) for i in range(10)], F.when(m >= 4, _segment(x(1), y(1), x(3), y(3))))
    part = _t(spark, sf, "part").select(k.alias("plan"), width.alias("width"), drawn.alias("d"))
    segs = part.select("plan", F.posexplode("d").alias("seq", "s")).where("s is not null").select("plan", "seq", "s.*")
    found = chains.facet_chains(segs, part.select("plan", "width"), PLAN, 8)
    return found.groupBy(F.col("plan").alias("p_partkey")).agg(F.max("place").cast("bigint").alias("facets"), F.count("*").alias("corners"))


# streets: a column of cells between each customer's street and the next


@query("""with c as (select c_nationkey as plan, c_custkey, (sum(1000 + c_custkey * 37 % 7 * 100) over (partition by c_nationkey order by c_custkey))::bigint as x from customer),
 s as (select plan, x, x - lag(x) over (partition by plan order by x) as w from c),
 f as (select plan, 4 as darts, 2 * w as area_milli, 2 as n from s where w is not null
       union all select plan, 2 * (count(*) - 1) + 4, -4 * (max(x) - min(x)), 1 from s group by plan having count(*) > 1)
select plan, darts::bigint as darts, area_milli::bigint as area_milli, sum(n)::bigint as faces from f group by all""")
def street_faces(spark, sf):
    """Splitting, welding, pruning of the ends that stick out, and faces of a street plan of each nation."""
    at = F.sum(1000 + F.col("c_custkey") * 37 % 7 * 100).over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("plan"), F.col("c_custkey").alias("seg"), at.alias("x"))
    across = c.groupBy("plan").agg((F.min("x") - 500).alias("lo"), (F.max("x") + 500).alias("hi"))
    rows = across.select("plan", F.explode(F.array(*[F.struct(F.lit((1 << 40) + i).alias("seg"), _segment(F.col("lo"), y, F.col("hi"), y).alias("s")) for i, y in enumerate((0, 2000, 4000))])).alias("r"))
    segs = c.select("plan", "seg", _segment(F.col("x"), -500, F.col("x"), 4500).alias("s")).select("plan", "seg", "s.*").unionByName(rows.select("plan", "r.seg", "r.s.*"))
    vertices, edges = segments.arrangement(segs, PLAN, size=2000.0)
    faced = rounds.settled(segments.faces_of(segments.darts_of(vertices, edges, PLAN), PLAN))
    areas = segments.face_areas(faced, PLAN).select("plan", "darts", milli(F.col("area") / 1e6).alias("area_milli"))
    return areas.groupBy("plan", "darts", "area_milli").agg(F.count("*").alias("faces"))


_SEGS = """s as (select c_nationkey as plan, c_custkey as seg, (c_custkey * 37 % 1000)::double as ax, (c_custkey * 91 % 1000)::double as ay,
  (c_custkey * 37 % 1000 + c_custkey * 53 % 301 - 150)::double as ex, (c_custkey * 91 % 1000 + c_custkey * 71 % 301 - 150)::double as ey from customer)"""
_MET = """d as (select p.plan, p.seg as one, q.seg as two, p.ax, p.ay, p.ex, p.ey, (p.ex - p.ax) * (q.ey - q.ay) - (p.ey - p.ay) * (q.ex - q.ax) as det,
   (q.ax - p.ax) * (q.ey - q.ay) - (q.ay - p.ay) * (q.ex - q.ax) as sn, (q.ax - p.ax) * (p.ey - p.ay) - (q.ay - p.ay) * (p.ex - p.ax) as tn
  from s p join s q on p.plan = q.plan and p.seg < q.seg),
 m as (select plan, one, two, ax + sn / det * (ex - ax) as x, ay + sn / det * (ey - ay) as y from d where abs(det) >= 1e-9 and sn / det between -1e-7 and 1 + 1e-7 and tn / det between -1e-7 and 1 + 1e-7)"""


def _crossed(spark, sf) -> DataFrame:
    """A segment of each customer, in the plan of its nation."""
    p, key = _spots(spark, sf), F.col("id")
    return p.select(F.col("n").alias("plan"), key.alias("seg"), _segment(F.col("x"), F.col("y"), F.col("x") + key * 53 % 301 - 150, F.col("y") + key * 71 % 301 - 150).alias("s")).select("plan", "seg", "s.*")


@query(f"with {_SEGS}, {_MET} select one, two, floor(x * 1000 + 0.5)::bigint as x_milli, floor(y * 1000 + 0.5)::bigint as y_milli from m")
def segment_crossings(spark, sf):
    found = segments.crossings(_crossed(spark, sf), PLAN, 100.0)
    return found.select("one", "two", milli(F.col("x")).alias("x_milli"), milli(F.col("y")).alias("y_milli"))


@query(f"""with {_SEGS}, {_MET}, e as (select plan, ax as px, ay as py from s union select plan, ex, ey from s),
 l as (select *, ex - ax as dx, ey - ay as dy, sqrt((ex - ax) ** 2 + (ey - ay) ** 2) as len from s where (ex - ax) ** 2 + (ey - ay) ** 2 > 0),
 c as (select l.*, ((m.x - ax) * dx + (m.y - ay) * dy) / (dx * dx + dy * dy) as t from l join m on l.plan = m.plan and l.seg in (m.one, m.two)
       union all select l.*, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy) from l join e on l.plan = e.plan
       where abs((px - ax) * dy - (py - ay) * dx) <= 3 * len and ((px - ax) * dx + (py - ay) * dy) > 0 and ((px - ax) * dx + (py - ay) * dy) < dx * dx + dy * dy),
 k as (select distinct seg, len, round(t, 9) as t from c where t > 3 / len and t < 1 - 3 / len union select seg, len, unnest([0.0, 1.0]) from l),
 u as (select seg, len, lead(t) over (partition by seg order by t) - t as part from k)
select seg, count(*)::bigint as pieces, floor(sum(part * len) * 1000 + 0.5)::bigint as length_milli from u where part * len > 3 group by seg""")
def split_pieces(spark, sf):
    """Segments cut where others cross them or end on them."""
    cut_up = segments.split(_crossed(spark, sf), PLAN, 3.0, 100.0)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return cut_up.groupBy("seg").agg(F.count("*").alias("pieces"), milli(F.sum(length)).alias("length_milli"))


_NEAR = 60.0


@query(f"""with recursive p as (select c_nationkey as plan, c_custkey as id, c_custkey * 37 % 1000 + c_custkey % 97 * 0.0137::double as x, c_custkey * 91 % 1000 + c_custkey % 89 * 0.0173::double as y,
   row_number() over (partition by c_nationkey order by c_custkey) as k from customer),
 w as (select distinct plan, 0::bigint as k, []::struct(id bigint, x double, y double)[] as l from p
   union all select w.plan, p.k, case when len(list_filter(l, lambda q: sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) <= {_NEAR})) = 0 then list_append(l, {{'id': p.id, 'x': p.x, 'y': p.y}}) else l end
   from w join p on p.plan = w.plan and p.k = w.k + 1),
 l as (select plan, unnest(arg_max(l, k)) as q from w group by plan)
select p.id, arg_min(q.id, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2)) as vertex from p join l on p.plan = l.plan and q.id <= p.id and sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) <= {_NEAR} group by p.id""")
def weld_points(spark, sf):
    """Points welded to the nearest of those that came first."""
    key = F.col("id")
    p = _spots(spark, sf).select(F.col("n").alias("plan"), key.alias("seq"), (F.col("x") + key % 97 * F.lit(0.0137)).alias("x"), (F.col("y") + key % 89 * F.lit(0.0173)).alias("y"))
    return segments.weld(p, PLAN, _NEAR).select(F.col("seq").alias("id"), "vertex")


_LINKS = """c as (select c_nationkey as plan, c_custkey as key, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as n from customer),
 b as (select plan, i as u, i - 1 - key * 7 % greatest(least(i, 5), 1) as v from c where i > 0 union select plan, i, (i * 3 + 1) % n from c where key % 4 = 0),
 e as (select distinct plan, least(u, v)::bigint as u, greatest(u, v)::bigint as v from b where u <> v)"""


@query(f"""with recursive {_LINKS}, r as (select plan, 0 as step, list({{'u': u, 'v': v}}) as e from e group by plan
  union all select plan, step + 1, f from (select plan, step, e, list_filter(e, lambda x: len(list_filter(e, lambda y: y.u = x.u or y.v = x.u)) > 1 and len(list_filter(e, lambda y: y.u = x.v or y.v = x.v)) > 1) as f from r) where len(f) < len(e)),
 z as (select plan, unnest(arg_max(e, step)) as x from r group by plan) select plan, x.u as u, x.v as v from z""")
def peel_edges(spark, sf):
    """What stays of a graph of each nation's customers when ends are taken off again and again."""
    by = Window.partitionBy("c_nationkey")
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("plan"), F.col("c_custkey").alias("key"), (F.row_number().over(by.orderBy("c_custkey")) - 1).cast("long").alias("i"), F.count("*").over(by).alias("n"))
    tree = c.where("i > 0").select("plan", F.col("i").alias("u"), (F.col("i") - 1 - F.col("key") * 7 % F.greatest(F.least(F.col("i"), F.lit(5)), F.lit(1))).alias("v"))
    more = c.where("key % 4 = 0").select("plan", F.col("i").alias("u"), ((F.col("i") * 3 + 1) % F.col("n")).alias("v"))
    edges = tree.unionByName(more).where("u <> v").select("plan", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return rounds.peel(edges, PLAN)


@query("""with recursive p as (select p_brand as plan, p_partkey as id, p_size as size, p_retailprice::double as price, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part),
 w as (select distinct plan, 0::bigint as k, []::struct(id bigint, size bigint, price double)[] as l from p
   union all select w.plan, p.k, case when len(list_filter(l, lambda q: abs(q.size - p.size) <= 6 and q.price - p.price <= 40)) = 0 then list_append(l, {'id': p.id, 'size': p.size, 'price': p.price}) else l end
   from w join p on p.plan = w.plan and p.k = w.k + 1)
select unnest(arg_max(l, k)).id as p_partkey from w group by plan""")
def greedy_suppression(spark, sf):
    """Parts of a brand, dearest first, without those near a kept one in size and price.

    Parts of seven sizes and a band of prices are all near each other, so each such cell keeps one at
    most and crowds form no pairs.  The band is a little narrower than the reach, so that a rounded
    difference can't put two of one cell out of it; what is in reach is then at most two cells away.
    """
    price, size = F.col("p_retailprice").cast("double"), F.col("p_size")
    cell = F.struct(F.floor(size / 7).alias("cx"), F.floor(price / 39.9).alias("cy"))
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("plan"), F.struct((-price).alias("price"), "p_partkey").alias("seq"), cell.alias("cell"), size.cast("double").alias("x"), price.alias("y"))
    near = lambda a, b: (F.abs(F.col(f"{a}x") - F.col(f"{b}x")) <= 6) & (F.col(f"{a}y") - F.col(f"{b}y") <= 40)
    return rounds.elect(p, PLAN, near, 2).select(F.col("seq.p_partkey").alias("p_partkey"))


@query("""with w as (select p_partkey, 3000 + p_size * 100 as len, 100 + 10 * (p_partkey % 20) as thick, 100 * (p_partkey % 9) as a, 400 * (p_partkey % 4) as b from part)
select p_partkey, len::bigint as length, thick::bigint as thickness, ((a >= 350)::int + (b >= 350)::int)::bigint as openings, (case when a >= 350 then a else 0 end + case when b >= 350 then b else 0 end)::bigint as gap from w""")
def wall_faces(spark, sf):
    """A wall of each part between faces of unequal length, with lines of glazing inside the thick ones,
    upright for odd parts: pairs over all that either face covers, thinner ones inside suppressed."""
    k = F.col("p_partkey")
    length, thick, a, b = 3000 + F.col("p_size") * 100, 100 + 10 * (k % 20), 100 * (k % 9), 400 * (k % 4)
    mid = thick / 2
    faces = [(F.lit(True), 0, 0, length), (F.lit(True), thick, a, length - b), (thick >= 200, mid - 35, 200, length - 200), (thick >= 200, mid + 35, 200, length - 200)]
    turned = lambda y, lo, hi: F.when(k % 2 == 1, _segment(y, lo, y, hi)).otherwise(_segment(lo, y, hi, y))
    drawn = F.array(*[F.when(there, F.struct(F.lit(i).cast("long").alias("seg"), turned(y, lo, hi).alias("s"))) for i, (there, y, lo, hi) in enumerate(faces)])
    segs = _t(spark, sf, "part").select(k.alias("plan"), F.explode(F.array_compact(drawn)).alias("f")).select("plan", "f.seg", "f.s.*", F.lit("A-WALL").alias("layer"))
    walls, gaps = wall_tables.find_walls(segs, PLAN)
    sums = gaps.groupBy("plan", "wall").agg(F.count("*").alias("openings"), F.sum(F.col("t1") - F.col("t0")).alias("gap"))
    whole = lambda c: F.round(c).cast("long")
    sized = walls.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).join(sums, ["plan", "wall"], "left")
    return sized.select(F.col("plan").alias("p_partkey"), whole(F.col("length")).alias("length"), whole(F.col("thickness")).alias("thickness"), F.coalesce("openings", F.lit(0)).alias("openings"), whole(F.coalesce("gap", F.lit(0.0))).alias("gap"))


@query("""with l as (select p_partkey, 100 + 50 * (p_partkey % 60) as one, 100 + 70 * (p_partkey % 41) as two, 100 + 90 * (p_partkey % 31) as three from part),
 v as (select *, one <= 3000 and two <= 3000 as near, one + 500 <= 3000 and three <= 3000 as far from l),
 t as (select *, case when near and (not far or two <= 500 + three) then 1 when far then 2 else 0 end as with_wall from v),
 w as (select p_partkey, 0 as wall, 4000 + case with_wall when 1 then one when 2 then one + 500 else 0 end as length, with_wall > 0 as bridged from t
   union all select p_partkey, 1, 4000 + case when with_wall = 1 then two else 0 end, with_wall = 1 from t union all select p_partkey, 2, 4000 + case when with_wall = 2 then three else 0 end, with_wall = 2 from t)
select p_partkey, wall::bigint as wall, length::bigint as length, case when bridged then 'corner-bridged' else 'paired-faces' end as source, bridged::bigint as openings from w""")
def corner_bridges(spark, sf):
    """Three walls of each part whose ends miss two corners: the nearer corner is put back."""
    k = F.col("p_partkey")
    one, two, three = 100 + 50 * (k % 60), 100 + 70 * (k % 41), 100 + 90 * (k % 31)
    drawn = F.array(*[F.struct(F.lit(i).cast("long").alias("wall"), s.alias("s")) for i, s in enumerate((_segment(one, 0, one + 4000, 0), _segment(0, two, 0, two + 4000), _segment(-500, three, -500, three + 4000)))])
    walls = _t(spark, sf, "part").select(k.alias("plan"), F.explode(drawn).alias("w")).select("plan", "w.wall", "w.s.*", F.lit(200.0).alias("thickness"), F.lit(None).cast("string").alias("layer"))
    none = walls.select("plan", "wall", F.lit(0.0).alias("t0"), F.lit(0.0).alias("t1")).limit(0)
    grown, gaps = wall_tables.bridge_corners(walls, none, PLAN)
    n = gaps.groupBy("plan", "wall").agg(F.count("*").alias("openings"))
    length = F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).cast("long")
    return grown.join(n, ["plan", "wall"], "left").select(F.col("plan").alias("p_partkey"), "wall", length.alias("length"), "source", F.coalesce("openings", F.lit(0)).alias("openings"))


@query(f"""with {_SEGS}, l as (select *, ex - ax as dx, ey - ay as dy from s where sqrt((ex - ax) ** 2 + (ey - ay) ** 2) >= 30),
 p as (select c_nationkey as plan, c_custkey as id, c_custkey * 37 % 1000 + 3.3::double as x, c_custkey * 91 % 1000 + 1.7::double as y, 20.0 + c_custkey % 50 as reach from customer),
 t as (select p.id, p.x, p.y, reach, l.*, greatest(0.0, least(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) as t from p join l on p.plan = l.plan and l.seg <> p.id),
 d as (select id, seg, reach, sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) as d from t)
select id, arg_min(seg, (d, seg)) as seg, floor(min(d) * 1000 + 0.5)::bigint as d_milli from d where d <= reach group by id""")
def nearest_segments(spark, sf):
    """Each point's nearest line within a reach of its own."""
    key = F.col("id")
    points = _spots(spark, sf).select(F.col("n").alias("plan"), key.alias("point"), (F.col("x") + 3.3).alias("px"), (F.col("y") + 1.7).alias("py"), (20.0 + key % 50).alias("reach"))
    fits = (F.hypot(F.col("s_bx") - F.col("s_ax"), F.col("s_by") - F.col("s_ay")) >= 30) & (F.col("s_seg") != F.col("point"))
    lines = _crossed(spark, sf)
    found = segments.nearest_segment(points, lines, PLAN, 60.0, fits, [F.col("s_seg")], segments.spacing(lines, PLAN))
    return found.select(F.col("point").alias("id"), F.col("s_seg").alias("seg"), milli(F.col("distance")).alias("d_milli"))


@query("""with s as (select p_partkey, case when p_size % 5 = 0 and p_size % 11 <> 0 then 'explicit' when p_size % 3 = 0 then 'dimension' when p_size % 2 = 0 then 'titleblock' when p_size % 7 = 0 then 'door' else 'default' end as source, p_size from part)
select p_partkey, source, floor(case source when 'explicit' then (20 + p_size) * 25.4 / 72 when 'dimension' then 20 + p_size when 'titleblock' then (10 + p_size) * 25.4 / 72 when 'door' then 900.0 / (18 + p_size % 5) else 50 * 25.4 / 72 end * 1000 + 0.5)::bigint as mm_milli from s""")
def scale_priority(spark, sf):
    """The scale of a sheet of each part: an argument (one in eleven can't be read), a dimension beside its
    line with others farther off and across it, a title, the arc of a door, or none."""
    s = F.col("p_size")
    part = _dealt(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("plan_id"), "p_size")
    plans = part.select("plan_id", F.when(s % 5 == 0, F.when(s % 11 == 0, "1 to 50").otherwise(F.concat(F.lit("1 : "), 20 + s))).alias("explicit"))
    line = lambda *xy: F.array(g.point(_d(xy[0]), _d(xy[1])), g.point(_d(xy[2]), _d(xy[3])))
    quarter = g.arc_points(F.lit(300.0), F.lit(300.0), (18 + s % 5).cast("double"), F.lit(0.0), F.lit(1.5707963267948966))
    shapes = [line(100, 108, 180, 108), line(120, 100.5, 121, 140), line(100, 100, 140, 100), F.when(s % 7 == 0, quarter)]
    prims = part.select("plan_id", F.posexplode(F.array(*shapes)).alias("prim_id", "points")).where("points is not null").withColumn("closed", F.lit(False))
    said = lambda there, i, text, x, y: F.when(there, F.struct(F.lit(i).alias("text_id"), text.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2.5).alias("height"), F.lit(0.0).alias("angle")))
    texts = F.array(said(s % 3 == 0, 0, F.concat((40 * (20 + s)).cast("string"), F.lit(" mm")), 120.0, 101.0), said(s % 2 == 0, 1, F.concat(F.lit("Scale 1:"), 10 + s), 500.0, 20.0), said(F.lit(True), 2, F.lit("1200"), 700.0, 700.0))
    labels = part.select("plan_id", F.explode(F.array_compact(texts)).alias("t")).select("plan_id", "t.*")
    found = scale_tables.find_scale(plans, prims, labels)
    return found.select(F.col("plan_id").alias("p_partkey"), "source", milli(F.col("mm_per_pt")).alias("mm_milli"))


_WINDOWS = """o as (select s_nationkey as plan, s_suppkey as opening, (s_suppkey * 37 % 1000)::double as ox, (s_suppkey * 91 % 1000)::double as oy, (30 + s_suppkey % 40)::double as w,
  [1.0, 0.0, -1.0, 0.0, 0.6][s_suppkey % 5 + 1] as ux, [0.0, 1.0, 0.0, -1.0, 0.8][s_suppkey % 5 + 1] as uy from supplier)"""


@query(f"""with {_SEGS}, {_WINDOWS}, v as (select plan, seg, ax as px, ay as py, least(ax, ex) as x0, greatest(ax, ex) as x1, least(ay, ey) as y0, greatest(ay, ey) as y1 from s
   union all select plan, seg, ex, ey, least(ax, ex), greatest(ax, ex), least(ay, ey), greatest(ay, ey) from s)
select distinct opening, seg as stroke from v join o on v.plan = o.plan and abs((px - ox) * ux + (py - oy) * uy) <= 1.4::double * w and abs((py - oy) * ux - (px - ox) * uy) <= 1.5::double * w
 and x1 >= ox - 1.5 * w and x0 <= ox + 1.5 * w and y1 >= oy - 1.5 * w and y0 <= oy + 1.5 * w""")
def opening_strokes(spark, sf):
    """Strokes of a nation's customers in the turned windows of its suppliers' openings."""
    k = F.col("s_suppkey")
    way = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 5 + 1).cast("int"))
    o = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("plan"), k.alias("opening"), (k * 37 % 1000).cast("double").alias("ox"), (k * 91 % 1000).cast("double").alias("oy"), (30.0 + k % 40).alias("width"), way([1.0, 0.0, -1.0, 0.0, 0.6]).alias("ux"), way([0.0, 1.0, 0.0, -1.0, 0.8]).alias("uy"))
    strokes = _crossed(spark, sf).select("plan", F.col("seg").alias("stroke"), F.array(g.point(F.col("ax"), F.col("ay")), g.point(F.col("bx"), F.col("by"))).alias("points"))
    return room_tables.opening_strokes(o, strokes, PLAN, 50.0).select("opening", "stroke")


@query(f"""with {_SEGS}, r as (select s_nationkey as plan, s_suppkey as room, s_suppkey * 37 % 800 + 0.25 as x0, s_suppkey * 91 % 800 + 0.25 as y0, s_suppkey * 37 % 800 + 100.25 + s_suppkey % 7 * 50 as x1, s_suppkey * 91 % 800 + 300.25 as y1 from supplier),
 v as (select plan, seg, ax as px, ay as py from s union all select plan, seg, (ax + ex) / 2, (ay + ey) / 2 from s union all select plan, seg, ex, ey from s),
 n as (select seg, room, count(*) as inside from v join r on v.plan = r.plan and px between x0 and x1 and py between y0 and y1 group by all)
select seg as stroke, arg_min(room, (-inside, room)) as room, max(inside)::bigint as inside from n group by seg""")
def stroke_owners(spark, sf):
    """The room that holds most of each stroke."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 800).cast("double") + 0.25, (k * 91 % 800).cast("double") + 0.25
    x1, y1 = x + 100 + k % 7 * 50, y + 300
    ring = F.array(g.point(x, y), g.point(x1, y), g.point(x1, y1), g.point(x, y1))
    rooms = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("plan"), k.alias("room"), ring.alias("ring"))
    mid = g.point((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    strokes = _crossed(spark, sf).select("plan", F.col("seg").alias("stroke"), F.array(g.point(F.col("ax"), F.col("ay")), mid, g.point(F.col("bx"), F.col("by"))).alias("points"))
    return room_tables.stroke_rooms(strokes, rooms, PLAN, 50.0).select("stroke", "room", "inside")


@query("""with s as (select p_partkey // 4 as plan, p_partkey % 4 as k, p_partkey, p_size, row_number() over (partition by p_partkey // 4 order by p_partkey) as a, count(*) over (partition by p_partkey // 4) as n from part),
 e as (select plan, a, a + 1 as b, 'door' as kind, p_size % 3 as n from s where a < n and p_size % 3 > 0 union all select plan, a, a + 1, 'wall', 1 from s where a < n and p_size % 3 = 0
   union all select plan, a, null, 'window', 1 from s union all select plan, a, null, 'door', 1 from s where p_partkey % 5 = 0)
select plan::varchar as plan, a::int as a, b::int as b, kind, n::bigint as n from e""")
def room_openings(spark, sf):
    """Rooms and their openings from the walls' middle lines: up to two doors in a partition, a window for
    each room in one long wall and doors in the other, each counted once."""
    rooms = strips.strips(_t(spark, sf, "part").withColumn("_key", F.col("p_partkey")))
    key = F.col("plan_id").cast("long") * 4 + F.col("k")
    sized = rooms.withColumn("key", key).join(_t(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size").hint("merge"), "key").select(F.col("plan_id").alias("plan"), "k", "key", "x0", "x1", "last", "p_size")
    ends = sized.groupBy("plan").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    row = lambda seg, *xy: F.struct(F.lit(seg).cast("long").alias("seg"), _segment(*xy).alias("s"))
    long_walls = ends.select("plan", F.explode(F.array(row(1, F.col("lo"), 0, F.col("hi"), 0), row(2, F.col("lo"), 4000, F.col("hi"), 4000), row(3, F.col("lo"), 0, F.col("lo"), 4000))).alias("w"))
    across = sized.select("plan", F.struct((F.col("k") + 10).cast("long").alias("seg"), _segment(F.col("x1"), 0, F.col("x1"), 4000).alias("s")).alias("w"))
    segs = long_walls.unionByName(across).select("plan", "w.seg", "w.s.*")
    vertices, edges = segments.arrangement(segs, PLAN)
    faced = rounds.settled(segments.faces_of(segments.darts_of(vertices, edges, PLAN), PLAN))
    mid = (F.col("x0") + F.col("x1")) / 2
    hole = lambda there, n, seg, x, y, kind: F.when(there, F.struct((F.col("key") * 8 + n).alias("via"), seg.cast("long").alias("seg"), _d(x).alias("px"), _d(y).alias("py"), F.lit(kind).alias("kind")))
    doors = F.col("p_size") % 3
    holes = F.array(hole(~F.col("last") & (doors > 0), 0, F.col("k") + 10, F.col("x1"), 1000, "door"), hole(~F.col("last") & (doors > 1), 1, F.col("k") + 10, F.col("x1"), 3000, "door"), hole(F.lit(True), 2, F.lit(2), mid, 4000, "window"), hole(F.col("key") % 5 == 0, 3, F.lit(1), mid, 0, "door"))
    openings = sized.select("plan", F.explode(F.array_compact(holes)).alias("o")).select("plan", "o.*")
    found = room_tables.room_edges(faced, rounds.settled(room_tables.rooms_of(faced, PLAN)), openings, PLAN)
    return found.groupBy("plan", "a", "b", "kind").agg(F.count("*").alias("n"))


@query("""with r as (select p_partkey, p_size as s, p_partkey % 6 as kind from part),
 f as (select p_partkey, 'sanitary' as symbol, s % 3 + 1 as n, 0.63 + 0.12 * (s % 3) as told from r where kind = 0
  union all select p_partkey, 'parking_bay', 1 + s % 4, 0.66 + 0.08 * least(2, s % 4) + 0.10 * (s % 2) from r where kind = 1 and (s % 4 > 0 or s % 2 = 1)
  union all select p_partkey, 'theatre_seating', 12 + 6 * (s % 3), least(0.93, 0.76 + 0.10 * (6 * (s % 3)) / 40 + 0.08 * (s % 2)) from r where kind = 2
  union all select p_partkey, 'ward_bay', 2 + s % 4, 0.76 + 0.08 * least(2, s % 4 - 1) + 0.08 * (s % 2) from r where kind = 3 and s % 4 > 0
  union all select p_partkey, 'stairs', 4 + s % 8, 0.70 + 0.25 * least(1, (1 + s % 8) / 6) from r where kind = 4
  union all select p_partkey, 'raised_floor', least(3 + s % 6, 5), 0.70 + 0.10 * (least(3 + s % 6, 5) - 4) / 6 + 0.08 * (s % 2) from r where kind = 5 and s % 6 > 0)
select p_partkey, symbol, n::bigint as n, floor(least(told, case symbol when 'stairs' then 0.95 when 'theatre_seating' then 0.93 when 'raised_floor' then 0.90 else 0.92 end) * 1000 + 0.5)::bigint as told_milli from f""")
def room_symbols(spark, sf):
    """A room of each part, of one of six kinds by its key: fittings, bays, seats, beds, treads or tiles."""
    s, kind = F.col("p_size"), F.col("p_partkey") % 6
    corner = lambda x, y: g.point(_d(x), _d(y))
    box = lambda x, y, w, h: F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h), corner(x, y))
    line = lambda ax, ay, bx, by: F.array(corner(ax, ay), corner(bx, by))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), f)
    fittings = F.slice(F.array(box(F.lit(100), 100, 700, 380), box(F.lit(1000), 100, 500, 400), box(F.lit(100), 900, 1700, 750)), 1, (s % 3 + 1).cast("int"))
    bays = each(1 + s % 4, lambda i: box(100 + i * 2600, F.lit(100), 2500, 5000))
    seats = each(12 + 6 * (s % 3), lambda i: box(100 + i % 6 * 600, 100 + F.floor(i / 6) * (900 + s % 2 * 100), 500, 500))
    beds = each(2 + s % 4, lambda i: box(100 + i * 2400, F.lit(100), 2000, 1000))
    treads = each(4 + s % 8, lambda i: line(F.lit(100), 100 + i * (250 + s % 10 * 10), F.lit(1100), 100 + i * (250 + s % 10 * 10)))
    tile = F.when(s % 2 == 1, 600).otherwise(500)
    tiles = F.concat(each(3 + s % 6, lambda i: line(100 + i * tile, F.lit(0), 100 + i * tile, F.lit(6000))), each(F.lit(5), lambda i: line(F.lit(0), 100 + i * tile, F.lit(6000), 100 + i * tile)))
    drawn = F.when(kind == 0, fittings).when(kind == 1, bays).when(kind == 2, seats).when(kind == 3, beds).when(kind == 4, treads).otherwise(tiles)
    odd = s % 2 == 1
    category = F.when(kind == 0, "bathroom").when((kind == 1) & odd, "garage").when((kind == 2) & odd, "auditorium").when((kind == 3) & odd, "ward").otherwise("other")
    side = F.when(kind == 0, 5000).when(kind == 5, 6000).otherwise(14000)
    part = _dealt(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("plan"), drawn.alias("drawn"), category.alias("category"), box(F.lit(0), F.lit(0), side, side).alias("ring"))
    strokes = part.select("plan", F.posexplode("drawn").alias("stroke", "points"))
    found = detectors.room_symbols(strokes, part.select("plan", "category", "ring"), PLAN)
    return found.select(F.col("plan").alias("p_partkey"), "symbol", F.col("n").cast("bigint").alias("n"), milli(F.round("confidence", 6)).alias("told_milli"))

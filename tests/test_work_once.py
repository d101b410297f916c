"""Work that grows with plans and rooms is done once, and what crowds share is not paired."""

from plinth.symbols import base
from plinth.symbols.base import RoomContext, all_matches


def test_room_detectors_share_the_measures_of_strokes(monkeypatch):
    seen = []
    monkeypatch.setattr(base, "oriented_extent", lambda pts, measure=base.oriented_extent: seen.append(1) or measure(pts))
    ring = [0j, 1600 + 0j, 1600 + 1400j, 1400j, 0j]
    room = RoomContext([ring, [0j, 1600 + 1400j], [1400j, 1600 + 0j]])
    assert any(s.id == "lift" for s, _ in all_matches(room, "room")) and len(seen) == 1


def _parts(spark, tmp_path, n=12):
    from pyspark.sql import functions as F

    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_plans_are_extracted_once_for_a_graph(spark, tmp_path, monkeypatch):
    from plinth.plans import extract, queries

    tried = spark.sparkContext.accumulator(0)

    def counted(*given, make=extract._extract):
        def run(batches):
            for rows in make(*given)(batches):
                tried.add(len(rows))
                yield rows

        return run

    monkeypatch.setattr(extract, "_extract", counted)
    where = _parts(spark, tmp_path)
    for name in ("graph_connected", "walkable_neighbours"):
        before = tried.value
        assert queries.QUERIES[name](spark, where).count() > 0
        assert tried.value - before == 3, name


def test_frames_share_covers_and_flat_parts_are_one_step(monkeypatch):
    import numpy as np

    from plinth.sinks import raster

    made = []
    monkeypatch.setattr(raster.Canvas, "_polygon", lambda self, shape, make=raster.Canvas._polygon: made.append(1) or make(self, shape))
    covers: dict = {}
    for colour in ((1, 2, 3), (4, 5, 6)):
        c = raster.Canvas(20, 20, covers=covers)
        c.polygon([(2, 2), (15, 2), (15, 15), (2, 15)], colour)
        assert (c.pixels[2:15, 2:15] == colour).all() and (c.pixels[15:] == raster.PAPER).all()
    assert len(made) == 1
    flat = np.repeat(np.array([0, 1, 2, 1, 0, 3], np.uint8), [500, 7, 1, 90, 4000, 2])
    read, data, width, table, last = [], int.from_bytes(raster.lzw(flat.tobytes(), 2), "little"), 3, [], b""
    while (code := data & ((1 << width) - 1)) != 5:
        data >>= width
        if code == 4:
            table, width, last = [bytes([i]) for i in range(4)] + [b"", b""], 3, b""
            continue
        now = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + now[:1])
        width += len(table) == 1 << width and width < 12
        read.append(now)
        last = now
    assert b"".join(read) == flat.tobytes()


def test_frames_are_drawn_together_and_parsed_once(monkeypatch):
    """A film has the frames of canvases drawn one by one; frames that differ in colours only share their parse."""
    import numpy as np

    from plinth.sinks import raster

    colours = [(1, 2, 3), (40, 50, 60), (7, 80, 9)]
    film, frames = raster.Film(30, 20, 3), []
    film.polygon([(2, 2), (15.3, 2), (15, 15)], colours)
    film.line((1, 1), (28, 14.5), colours, 2.5)
    film.ring(20, 8, 3, colours[1:])  # from the second frame on
    film.circle(29, 19, 4, colours)
    film.text(3, 9, "R01", colours[2:])
    for k, colour in enumerate(colours):
        c = raster.Canvas(30, 20)
        c.polygon([(2, 2), (15.3, 2), (15, 15)], colour)
        c.line((1, 1), (28, 14.5), colour, 2.5)
        if k > 0:
            c.ring(20, 8, 3, colour)
        c.circle(29, 19, 4, colour)
        if k > 1:
            c.text(3, 9, "R01", colour)
        frames.append((c.pixels, 8))
    assert all((a == b).all() for a, (b, _) in zip(film.shown(), frames, strict=True))
    assert film.gif([8, 8, 8]) == raster.gif(frames)
    parses = []
    monkeypatch.setattr(raster, "_codes", lambda *given, parse=raster._codes: parses.append(1) or parse(*given))
    flat = np.arange(60).reshape(6, 10) % 7 // 2
    raster.gif([(np.array([(k, 0, 0), (0, 9, k), (k, k, k), (200, 0, k)], np.uint8)[flat], 8) for k in (10, 90, 120)])
    assert len(parses) == 1


def test_heavy_parts_are_dealt_out_and_scales_too(spark, tmp_path):
    from plinth.plans import queries, table_queries  # noqa: F401

    plan = queries.QUERIES["scale_priority"](spark, _parts(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_lines_of_one_heading_stand_for_election_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from plinth.functions import geometry as g
    from plinth.symbols import detectors

    rows = []
    monkeypatch.setattr(detectors, "elect", lambda points, *rest, take=detectors.elect: rows.append(points.count()) or take(points, *rest))
    at = lambda x, y: g.point(x.cast("double"), y.cast("double"))
    y = F.col("id") % 10 * 280
    treads = spark.range(30).select((F.col("id") % 3).alias("plan"), F.col("id").alias("stroke"), F.array(at(F.lit(0), y), at(F.lit(1000), y)).alias("points"))
    found = detectors.stairs(treads, ["plan"]).collect()
    assert [(r["plan"], r["n"]) for r in sorted(found)] == [(0, 10), (1, 10), (2, 10)] and rows == [3]


def test_nearest_segments_are_the_same_in_growing_reaches(spark):
    from pyspark.sql import functions as F

    from plinth.operators import segments

    k = F.col("id")
    x, y = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")
    segs = spark.range(600).select((k % 2).alias("plan"), k.alias("seg"), x.alias("ax"), y.alias("ay"), (x + k * 53 % 301 - 150).alias("bx"), (y + k * 71 % 301 - 150).alias("by"))
    points = spark.range(300).select((k % 2).alias("plan"), k.alias("point"), (x + 3.3).alias("px"), (y + 1.7).alias("py"), (20.0 + k % 50).alias("reach"))
    told = lambda first: sorted(map(tuple, segments.nearest_segment(points, segs, ["plan"], 60.0, F.col("s_seg") != F.col("point"), [F.col("s_seg")], first).select("point", "reach", "s_seg", "distance").collect()))
    assert 20 < segments.spacing(segs, ["plan"]) < 100
    assert told(None) == told(1.5) == told(segments.spacing(segs, ["plan"])) and told(None)


def test_decoded_pages_are_arrow_and_numbers_are_read_once(monkeypatch):
    import pyarrow as pa

    from plinth.sources import pdf, reader

    files = pa.RecordBatch.from_pydict({"path": ["a"], "content": [b"no drawing"]})
    (frame,) = reader._decode(0)(iter([files]))
    assert isinstance(frame, pa.RecordBatch) and frame.schema == reader.MADE and frame.to_pylist()[0]["plan_id"] == "a#0"
    seen = []
    monkeypatch.setattr(pdf.Lexer, "token", lambda self, read=pdf.Lexer.token: seen.append(1) or read(self))
    lexer = pdf.Lexer(b"1 -2 3.5 4 0 R 5 % 0 R\n6 %x\n0 R[7 0 R 8]true")
    assert [lexer.read() for _ in range(9)] == [1, -2, 3.5, pdf.Ref(4), 5, pdf.Ref(6), [pdf.Ref(7), 8], True, pdf.END]
    assert len(seen) == 12


def test_models_are_given_back_as_arrow():
    import pyarrow as pa

    from plinth.plans import extract

    page = pa.RecordBatch.from_pylist([{"plan_id": "a", "primitives": [], "texts": []}])
    (models,) = extract._extract("1mm", extract.MIN_AREA)(iter([page]))
    assert models.schema == extract.MADE and models.num_rows == 1 and models.to_pylist()[0]["plan_id"] == "a"

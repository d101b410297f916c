"""JSON and GeoJSON documents of plan models, as DataFrame expressions: one row per plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geometry import to_lon_lat

SCHEMA = "plinth/1.0"


def _pair(p: Column) -> Column:
    return F.array(F.round(p["x"], 1), F.round(p["y"], 1))


def _meta(rows: Column, fields: list[str]) -> Column:
    return F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields], F.try_parse_json(r["meta"]).alias("meta")))


def _kinds(openings: Column) -> Column:
    kinds = F.array_distinct(F.transform(openings, lambda o: o["kind"]))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(openings, lambda o: o["kind"] == k))))


def json_documents(models: DataFrame) -> DataFrame:
    """(plan_id, document): the whole model as one JSON text, coordinates to 0.1 mm."""
    c = F.col
    total = F.round(F.aggregate("rooms", F.lit(0.0), lambda a, r: a + r["area_gross_m2"]), 2)
    rooms = F.transform(
        "rooms",
        lambda r: F.struct(
            *[r[f].alias(f) for f in ("id", "name", "category", "area_gross_m2", "area_net_m2", "perimeter_m")],
            _pair(r["centroid_mm"]).alias("centroid_mm"),
            _pair(r["label_point_mm"]).alias("label_point_mm"),
            F.transform(r["polygon_mm"], _pair).alias("polygon_mm"),
            *[r[f].alias(f) for f in ("labelled_area_m2", "area_delta_pct", "area_check", "texts")],
        ),
    )
    walls = F.transform("walls", lambda w: F.struct(w["id"].alias("id"), _pair(w["start_mm"]).alias("start_mm"), _pair(w["end_mm"]).alias("end_mm"), *[w[f].alias(f) for f in ("length_mm", "thickness_mm", "layer", "openings")]))
    openings = F.transform(
        "openings",
        lambda o: F.struct(
            *[o[f].alias(f) for f in ("id", "kind", "symbol", "confidence", "wall", "width_mm")],
            *[_pair(o[f]).alias(f) for f in ("centre_mm", "start_mm", "end_mm")],
            F.try_parse_json(o["meta"]).alias("meta"),
        ),
    )
    edge = ("a", "b", "kind", "via", "symbol", "confidence", "shared_length_m")
    inner = F.transform(F.filter("edges", lambda e: ~e["exterior"]), lambda e: F.struct(*[e[f].alias(f) for f in edge]))
    outer = F.transform(F.filter("edges", lambda e: e["exterior"]), lambda e: F.struct(e["a"].alias("room"), *[e[f].alias(f) for f in ("kind", "via", "symbol")]))
    doc = F.struct(
        F.lit(SCHEMA).alias("schema"),
        F.struct(F.substring_index("plan_id", "#", 1).alias("file"), F.element_at(F.split("plan_id", "#"), -1).alias("page")).alias("source"),
        F.struct(F.lit("mm").alias("length"), F.lit("m2").alias("area")).alias("units"),
        c("scale"),
        F.array(*[c("bounds_mm")[k] for k in ("x0", "y0", "x1", "y1")]).alias("bounds_mm"),
        F.struct(F.size("rooms").alias("rooms"), F.size("walls").alias("walls"), F.size("openings").alias("openings"), total.alias("total_area_m2"), _kinds(c("openings")).alias("by_kind")).alias("summary"),
        rooms.alias("rooms"),
        walls.alias("walls"),
        openings.alias("openings"),
        F.struct(F.transform("rooms", lambda r: r["id"]).alias("nodes"), inner.alias("edges"), outer.alias("exterior"), c("connected")).alias("graph"),
        _meta(c("features"), ["room", "symbol", "kind", "confidence"]).alias("features"),
        _meta(c("plan_features"), ["symbol", "kind", "confidence"]).alias("plan_features"),
        c("warnings"),
    )
    return models.select("plan_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def geojson_documents(models: DataFrame, origin: tuple[float, float] | None = None, rotation_deg: float = 0.0, include: tuple[str, ...] = ("rooms", "walls", "openings")) -> DataFrame:
    """(plan_id, document): a FeatureCollection from the least corner of each plan's bounds; metres,
    or longitude and latitude about ``origin`` (latitude, longitude)."""

    cos, sin = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))

    def at(p: Column) -> Column:
        x, y = (p[k] - F.coalesce(F.col("bounds_mm")[f"{k}0"], F.lit(0.0)) for k in ("x", "y"))
        if origin is None:
            return F.array(F.round((x * cos - y * sin) / 1000, 4), F.round((x * sin + y * cos) / 1000, 4))
        where = to_lon_lat(x, y, *origin, rotation_deg)
        return F.array(where["lon"], where["lat"])

    # one struct type for all features: absent properties are null and not written
    names = {"name": "string", "category": "string", "area_gross_m2": "double", "area_net_m2": "double", "perimeter_m": "double", "area_check": "string", "neighbours": "array<string>", "thickness_mm": "double", "length_mm": "double", "cad_layer": "string", "kind": "string", "symbol": "string", "confidence": "double", "width_mm": "double"}

    def feature(layer: str, key: Column, geometry: Column, **props: Column) -> Column:
        told = [props.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
        return F.to_json(F.struct(F.lit("Feature").alias("type"), key.alias("id"), geometry.alias("geometry"), F.struct(F.lit(layer).alias("layer"), *told).alias("properties")))

    def ring(r: Column) -> Column:
        pts = F.transform(r, at)
        return F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(pts, F.slice(pts, 1, 1))).alias("coordinates"))

    line = lambda a, b: F.struct(F.lit("LineString").alias("type"), F.array(at(a), at(b)).alias("coordinates"))

    def near(r: Column) -> Column:
        inner = F.filter(F.col("edges"), lambda e: ~e["exterior"] & (e["kind"] != "wall") & ((e["a"] == r["id"]) | (e["b"] == r["id"])))
        return F.transform(inner, lambda e: F.when(e["a"] == r["id"], e["b"]).otherwise(e["a"]))

    parts = {
        "rooms": F.transform("rooms", lambda r: feature("room", r["id"], ring(r["polygon_mm"]), name=r["name"], category=r["category"], area_gross_m2=r["area_gross_m2"], area_net_m2=r["area_net_m2"], perimeter_m=r["perimeter_m"], area_check=r["area_check"], neighbours=near(r))),
        "walls": F.transform("walls", lambda w: feature("wall", w["id"], line(w["start_mm"], w["end_mm"]), thickness_mm=w["thickness_mm"], length_mm=w["length_mm"], cad_layer=w["layer"])),
        "openings": F.transform("openings", lambda o: feature("opening", o["id"], line(o["start_mm"], o["end_mm"]), kind=o["kind"], symbol=o["symbol"], confidence=o["confidence"], width_mm=o["width_mm"])),
    }
    features = F.concat(*[parts[k] for k in include]) if include else F.array().cast("array<string>")
    return models.select("plan_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")).alias("document"))

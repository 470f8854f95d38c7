"""GeoJSON, CSV and KML in and out.

A feature is ``geom_type, parts, properties``: ``parts`` is
``array<array<array<struct<x,y>>>>`` (part, ring or line, point) and ``properties`` is JSON text.
Sinks stream their rows to part files; each part file is a complete document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.sources.split_json import feature_texts

PARTS = "array<array<array<struct<x:double,y:double>>>>"

# Column names that choose themselves, and weak ones that need confirmation.
STRONG = {"lon": ("lon", "longitude", "lng"), "lat": ("lat", "latitude")}
WEAK = {"lon": ("x",), "lat": ("y",)}
ID_NAMES = ("id", "fid", "feature_id")
MAX_PROPERTY_KEYS = 5000


def _points(raw: Column, depth: int) -> Column:
    """Coordinates of a geometry as ``parts``, by the nesting of its type."""
    def pt(p: Column) -> Column:
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    line = "array<array<double>>"
    if depth == 0:
        return F.array(F.array(F.array(pt(F.from_json(raw, "array<double>")))))
    if depth == 1:
        return F.array(F.array(F.transform(F.from_json(raw, line), pt)))
    if depth == 2:
        return F.array(F.transform(F.from_json(raw, f"array<{line}>"), lambda r: F.transform(r, pt)))
    return F.transform(F.from_json(raw, f"array<array<{line}>>"), lambda g: F.transform(g, lambda r: F.transform(r, pt)))


def parts_of(geom_type: Column, raw: Column) -> Column:
    multi_point = F.transform(F.from_json(raw, "array<array<double>>"), lambda p: F.array(F.array(F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    multi_line = F.transform(F.from_json(raw, "array<array<array<double>>>"), lambda ln: F.array(F.transform(ln, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    return (F.when(geom_type == "Point", _points(raw, 0)).when(geom_type == "MultiPoint", multi_point).when(geom_type == "LineString", _points(raw, 1))
            .when(geom_type == "MultiLineString", multi_line).when(geom_type == "Polygon", _points(raw, 2)).when(geom_type == "MultiPolygon", _points(raw, 3)))


_FEATURE = "geometry struct<type:string,coordinates:string>, properties string"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of FeatureCollection documents, or of newline-delimited features; both are read in splits, however large a file is."""
    raw = spark.read.schema(_FEATURE).json(path) if lines else feature_texts(spark, path).select(F.from_json("text", _FEATURE).alias("f")).select("f.*")
    kind = F.col("geometry.type")
    return raw.select(kind.alias("geom_type"), parts_of(kind, F.col("geometry.coordinates")).cast(PARTS).alias("parts"), "properties")


def _documents(rows: DataFrame, head: str, tail: str, joiner: str) -> DataFrame:
    """Wrap the text rows of every partition between a head and a tail, without holding them."""
    def wrap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        first = True
        for f in frames:
            v = f["value"]
            if len(v) and joiner:
                v = joiner + v
                if first:
                    v.iloc[0] = v.iloc[0][len(joiner):]
            first = first and not len(v)
            yield pd.DataFrame({"value": v})
        yield pd.DataFrame({"value": [tail]})
    return rows.mapInPandas(wrap, "value string")


def _coordinates(geom_type: Column, parts: Column) -> Column:
    pts = F.transform(parts, lambda g: F.transform(g, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    first = F.element_at(pts, 1)
    return (F.when(geom_type == "Point", F.to_json(F.element_at(F.element_at(first, 1), 1)))
            .when(geom_type == "MultiPoint", F.to_json(F.transform(pts, lambda g: F.element_at(F.element_at(g, 1), 1))))
            .when(geom_type == "LineString", F.to_json(F.element_at(first, 1)))
            .when(geom_type == "MultiLineString", F.to_json(F.transform(pts, lambda g: F.element_at(g, 1))))
            .when(geom_type == "Polygon", F.to_json(first)).when(geom_type == "MultiPolygon", F.to_json(pts)))


def _feature_text() -> Column:
    geometry = F.when(F.col("geom_type").isNull(), F.lit("null")).otherwise(F.concat(
        F.lit('{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), _coordinates(F.col("geom_type"), F.col("parts")), F.lit("}")))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.coalesce("properties", F.lit("{}")), F.lit("}"))


def feature_lines(features: DataFrame) -> DataFrame:
    return features.select(_feature_text().alias("value"))


def write_geojson(features: DataFrame, path: str, lines: bool = False) -> None:
    out = feature_lines(features)
    if not lines:
        out = _documents(out, '{"type":"FeatureCollection","features":[', "]}", ",")
    out.write.text(path)


# ---- CSV ------------------------------------------------------------------------------------

def csv_candidates(columns: list[str]) -> dict[str, list[tuple[str, str]]]:
    """Per role the matching columns with the strength of the match."""
    low = {c: c.strip().lower() for c in columns}
    out: dict[str, list[tuple[str, str]]] = {"id": [(c, "strong") for c, n in low.items() if n in ID_NAMES]}
    for role in ("lon", "lat"):
        out[role] = [(c, "strong") for c, n in low.items() if n in STRONG[role]] + [(c, "weak") for c, n in low.items() if n in WEAK[role]]
    return out


def import_csv(spark: SparkSession, path: str, encoding: str, mapping: dict[str, str] | None = None) -> tuple[str, DataFrame | None, dict]:
    """(status, points, candidates). Only one strong column per axis, or a given mapping, is taken without asking."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    found = csv_candidates(raw.columns)
    if mapping is None:
        strong = {r: [c for c, s in found[r] if s == "strong"] for r in ("lon", "lat")}
        if any(len(v) != 1 for v in strong.values()):
            return "needs_confirmation", None, found
        mapping = {r: v[0] for r, v in strong.items()}
        if len(found["id"]) == 1:
            mapping["id"] = found["id"][0][0]
    lon, lat = (F.col(f"`{mapping[r]}`").try_cast("double") for r in ("lon", "lat"))
    used = {mapping["lon"], mapping["lat"]}
    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c not in used]))
    fid = F.col(f"`{mapping['id']}`") if "id" in mapping else F.lit(None).cast("string")
    issue = F.when(lon.isNull() | lat.isNull(), "not-a-number").when(~(lon.between(-180, 180) & lat.between(-90, 90)), "out-of-range")
    return "ready", raw.select(fid.alias("feature_id"), lon.alias("lon"), lat.alias("lat"), props.alias("properties"), issue.alias("issue")), found


def property_keys(features: DataFrame, position: str) -> list[str]:
    """Union of property keys in first-seen order (a schema, hence small; refused when it is not)."""
    seen = features.select(F.col(position).alias("p"), F.posexplode(F.json_object_keys("properties")).alias("i", "key")).groupBy("key").agg(F.min(F.struct("p", "i")).alias("at"))
    rows = seen.orderBy("at").limit(MAX_PROPERTY_KEYS + 1).collect()
    if len(rows) > MAX_PROPERTY_KEYS:
        raise ValueError("too many property keys for one table")
    return [r["key"] for r in rows]


def csv_rows(features: DataFrame, position: str) -> DataFrame:
    """One row per point or MultiPoint part; other geometry is refused, nested values stay JSON."""
    bad = features.where(~F.col("geom_type").isin("Point", "MultiPoint")).limit(1).count()
    if bad:
        raise ValueError("a point table was asked for, but the layer has other shapes")
    keys = property_keys(features, position)
    cells = [F.get_json_object("properties", f"$['{k}']").alias(k) for k in keys]
    return features.where(F.col("geom_type").isNotNull()).select(F.explode("parts").alias("_p"), *cells).select(
        F.col("_p")[0][0]["x"].alias("lon"), F.col("_p")[0][0]["y"].alias("lat"), *[F.col(f"`{k}`") for k in keys])


def export_csv(features: DataFrame, path: str, position: str) -> None:
    csv_rows(features, position).write.option("header", True).option("escape", '"').csv(path)


# ---- KML ------------------------------------------------------------------------------------

_RING = "struct<LinearRing:struct<coordinates:string>>"
_POLY = f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>"
_LEAF = "struct<coordinates:string>"
_PLACEMARK = (f"name string, ExtendedData struct<Data:array<struct<_name:string,value:string>>>, Point {_LEAF}, LineString {_LEAF}, Polygon {_POLY}, "
              f"MultiGeometry struct<Point:array<{_LEAF}>,LineString:array<{_LEAF}>,Polygon:array<{_POLY}>>")


def _kml_points(text: Column) -> Column:
    def pt(s: Column) -> Column:
        v = F.split(s, ",")
        return F.struct(F.get(v, F.lit(0)).try_cast("double").alias("x"), F.get(v, F.lit(1)).try_cast("double").alias("y"))
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), pt)


def _kml_polygon(p: Column) -> Column:
    outer = F.array(_kml_points(p["outerBoundaryIs"]["LinearRing"]["coordinates"]))
    inner = F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{_RING}>")), lambda r: _kml_points(r["LinearRing"]["coordinates"]))
    return F.concat(outer, inner)


def _whole_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of files that are read as a whole."""
    return spark.read.format("xml").option("rowTag", "Placemark").schema(_PLACEMARK).load(path)


def _split_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of files that are read in splits, cut at the closing tags.

    That needs closing tags which all end a placemark: where a tag has inner space, or a comment or CDATA section is still open at one or holds another start, files are read as a whole.
    """
    pieces = spark.read.option("lineSep", "</Placemark>").text(path)
    count = lambda text: F.regexp_count("value", F.lit(text))
    start = r"<Placemark[\s/>]"
    odd = (count(start) > 1) | (count("<!--") != count("-->")) | (count(r"<!\[CDATA\[") != count(r"\]\]>")) | F.col("value").rlike(r"</Placemark\s|<Placemark[^>]*/>")
    if pieces.where(odd).limit(1).count():
        return _whole_kml(spark, path)
    marks = pieces.where(F.col("value").rlike(start)).select(F.concat(F.regexp_substr("value", F.lit(rf"(?s){start}.*")), F.lit("</Placemark>")).alias("mark"))
    return marks.select(F.from_xml("mark", _PLACEMARK, {"rowTag": "Placemark"}).alias("k")).select("k.*")


def import_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks as WGS84 features. A MultiGeometry of one kind becomes Multi*; a mixed one is refused by name."""
    k = _split_kml(spark, path)
    mg = F.col("MultiGeometry")
    has = {n: F.coalesce(F.size(mg[n]), F.lit(0)) > 0 for n in ("Point", "LineString", "Polygon")}
    kinds = sum((F.when(c, 1).otherwise(0) for c in has.values()), F.lit(0))
    single = {"Point": F.array(F.array(_kml_points(F.col("Point.coordinates")))), "LineString": F.array(F.array(_kml_points(F.col("LineString.coordinates")))),
              "Polygon": F.array(_kml_polygon(F.col("Polygon")))}
    many = {"Point": F.transform(mg["Point"], lambda p: F.array(_kml_points(p["coordinates"]))),
            "LineString": F.transform(mg["LineString"], lambda p: F.array(_kml_points(p["coordinates"]))), "Polygon": F.transform(mg["Polygon"], _kml_polygon)}
    kind, parts = None, None
    for n in single:
        cond = F.col(n).isNotNull()
        kind = F.when(cond, n) if kind is None else kind.when(cond, n)
        parts = F.when(cond, single[n]) if parts is None else parts.when(cond, single[n])
    for n in many:
        cond = has[n] & (kinds == 1)
        kind, parts = kind.when(cond, f"Multi{n}"), parts.when(cond, many[n])
    data = F.col("ExtendedData.Data")
    props = F.to_json(F.map_from_entries(F.coalesce(F.transform(data, lambda d: F.struct(d["_name"].alias("k"), d["value"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))))
    return k.select("name", kind.alias("geom_type"), parts.cast(PARTS).alias("parts"), props.alias("properties"),
                    F.when(kinds > 1, "mixed-geometry").when(kind.isNull(), "no-geometry").alias("issue"))


def external_references(spark: SparkSession, path: str) -> DataFrame:
    """Count of external links in KML text; they are never followed."""
    text = spark.read.text(path)
    return text.agg(F.sum(F.regexp_count("value", F.lit(r"<(href|Link|NetworkLink)\b"))).alias("external_references"))


def _escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def placemarks(features: DataFrame, fallback: str = "feature") -> DataFrame:
    """One Placemark per part, holes kept, scalar properties as ExtendedData."""
    def coords(r: Column) -> Column:
        return F.array_join(F.transform(r, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    kind = F.regexp_replace("geom_type", "^Multi", "")
    part = F.col("part")
    ring = F.concat(F.lit("<coordinates>"), coords(part[0]), F.lit("</coordinates>"))
    holes = F.array_join(F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda r: F.concat(
        F.lit("<innerBoundaryIs><LinearRing><coordinates>"), coords(r), F.lit("</coordinates></LinearRing></innerBoundaryIs>"))), "")
    body = F.when(F.col("kind") == "Polygon", F.concat(F.lit("<outerBoundaryIs><LinearRing>"), ring, F.lit("</LinearRing></outerBoundaryIs>"), holes)).otherwise(ring)
    entries = F.map_entries(F.from_json("properties", "map<string,string>"))
    scalars = F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^[\[{]"))
    data = F.array_join(F.transform(scalars, lambda e: F.concat(F.lit('<Data name="'), _escape(e["key"]), F.lit('"><value>'), _escape(e["value"]), F.lit("</value></Data>"))), "")
    name = _escape(F.coalesce(F.get_json_object("properties", "$.name"), F.lit(fallback)))
    d = features.where("geom_type IS NOT NULL").select(kind.alias("kind"), "properties", F.explode("parts").alias("part"))
    return d.select(F.concat(F.lit("<Placemark><name>"), name, F.lit("</name>"), F.when(data == "", "").otherwise(F.concat(F.lit("<ExtendedData>"), data, F.lit("</ExtendedData>"))),
                             F.lit("<"), F.col("kind"), F.lit(">"), body, F.lit("</"), F.col("kind"), F.lit("></Placemark>")).alias("value"))


def export_kml(features: DataFrame, path: str, name: str = "export") -> DataFrame:
    """Write the documents; returns the counts of placemarks written and features skipped."""
    head = f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{name}</name>'
    _documents(placemarks(features), head, "</Document></kml>", "").write.text(path)
    return features.agg(F.coalesce(F.sum(F.when(F.col("geom_type").isNotNull(), F.size("parts"))), F.lit(0)).alias("placemarks"), F.count_if(F.col("geom_type").isNull()).alias("skipped"))


def export_layers(features: DataFrame, path: str, layer: str, ref: str, algorithm: str) -> DataFrame:
    """One folder per layer, and the manifest of what was written."""
    lines = features.select(layer, _feature_text().alias("value"))
    lines.write.partitionBy(layer).text(path)
    return features.groupBy(layer).agg(F.count(F.lit(1)).alias("feature_count")).select(
        F.lit(ref).alias("ref"), F.lit(algorithm).alias("algorithm"), F.concat_ws("/", F.lit(path), F.concat_ws("=", F.lit(layer), F.col(layer).cast("string"))).alias("source_ref"),
        F.col(layer).alias("layer_id"), "feature_count")


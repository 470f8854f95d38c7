"""Sources and sinks: each query writes under the shared folder and reads back."""

from pyspark.sql import functions as F

from terralog.fixtures import lat_of, lon_of, lonlat_sql, with_sql
from terralog.queries.registry import query
from terralog.session import scratch_path
from terralog.sources import chunked as C
from terralog.sources import vector as V


def _features(t):
    """A point, line or polygon per customer; every 31st has no geometry."""
    k = F.col("c_custkey")
    lon, lat = lon_of(k), lat_of(k)

    def v(dx, dy):
        return F.struct((lon + dx).alias("x"), (lat + dy).alias("y"))
    point = F.array(F.array(F.array(v(0.0, 0.0))))
    multi = F.array(F.array(F.array(v(0.0, 0.0))), F.array(F.array(v(0.5, 0.5))))
    line = F.array(F.array(F.array(v(0.0, 0.0), v(0.25, 0.0), v(0.25, 0.25))))
    poly = F.array(F.array(F.array(v(0.0, 0.0), v(1.0, 0.0), v(1.0, 1.0), v(0.0, 0.0)), F.array(v(0.5, 0.25), v(0.75, 0.25), v(0.75, 0.5), v(0.5, 0.25))))
    kind = F.when(k % 31 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, ("Point", "MultiPoint", "LineString", "Polygon"))), (k % 4 + 1).cast("int")))
    parts = F.when(k % 31 == 0, None).when(k % 4 == 0, point).when(k % 4 == 1, multi).when(k % 4 == 2, line).otherwise(poly)
    props = F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return t.customer.select(kind.alias("geom_type"), parts.cast(V.PARTS).alias("parts"), props.alias("properties"), "c_mktsegment", k)


_FEAT = f"""f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 31 <> 0 THEN ['Point','MultiPoint','LineString','Polygon'][c_custkey % 4 + 1] END AS geom_type, c_mktsegment AS segment, {lonlat_sql('c_custkey')} FROM customer)"""
_SUMMARY = """SELECT id, geom_type, CASE WHEN geom_type IS NOT NULL THEN CASE geom_type WHEN 'MultiPoint' THEN 2 ELSE 1 END END AS parts, CASE geom_type WHEN 'Point' THEN 1 WHEN 'MultiPoint' THEN 2 WHEN 'LineString' THEN 3 WHEN 'Polygon' THEN 8 END AS points,
 CASE WHEN geom_type IS NOT NULL THEN round(lon, 9) END AS lon, CASE WHEN geom_type IS NOT NULL THEN round(lat, 9) END AS lat, segment FROM f"""


def _summary(df, id_type="bigint"):
    flat = F.flatten(F.flatten("parts"))
    return df.select(F.get_json_object("properties", "$.id").cast(id_type).alias("id"), "geom_type", F.when(F.col("parts").isNotNull(), F.size("parts")).alias("parts"),
                     F.when(F.col("parts").isNotNull(), F.size(flat)).alias("points"), F.round(flat[0]["x"], 9).alias("lon"), F.round(flat[0]["y"], 9).alias("lat"), F.get_json_object("properties", "$.segment").alias("segment"))


@query("scan_geojson", f"WITH {_FEAT} {_SUMMARY}")
def scan_geojson(t):
    path = scratch_path(t.spark, "geojson")
    V.write_geojson(_features(t), path)
    return _summary(V.read_geojson(t.spark, path))


@query("export_geojson", f"WITH {_FEAT} {_SUMMARY}")
def export_geojson(t):
    path = scratch_path(t.spark, "geojsonl")
    V.write_geojson(_features(t), path, lines=True)
    return _summary(V.read_geojson(t.spark, path, lines=True))


@query("import_kml", f"WITH {_FEAT}, p AS (SELECT id, CASE geom_type WHEN 'MultiPoint' THEN 'Point' ELSE geom_type END AS geom_type, u, round(lon + CASE WHEN u = 1 THEN 0.5 ELSE 0 END, 9) AS lon, segment FROM f, (VALUES (0), (1)) x(u) WHERE geom_type IS NOT NULL AND (u = 0 OR geom_type = 'MultiPoint')) SELECT id, geom_type, lon, CASE geom_type WHEN 'Point' THEN 1 WHEN 'LineString' THEN 3 ELSE 8 END AS points, segment FROM p")
def import_kml(t):
    path = scratch_path(t.spark, "kml")
    V.export_kml(_features(t), path)
    return _summary(V.import_kml(t.spark, path)).select("id", "geom_type", "lon", "points", "segment")


@query("export_kml", f"WITH {_FEAT} SELECT sum(CASE WHEN geom_type = 'MultiPoint' THEN 2 WHEN geom_type IS NULL THEN 0 ELSE 1 END)::BIGINT AS placemarks, count(*) FILTER (geom_type IS NULL) AS skipped FROM f")
def export_kml(t):
    return V.export_kml(_features(t), scratch_path(t.spark, "kml"))


@query("export_csv_points", f"WITH {_FEAT} SELECT id, round(lon + CASE WHEN u = 1 THEN 0.5 ELSE 0 END, 9) AS lon, round(lat + CASE WHEN u = 1 THEN 0.5 ELSE 0 END, 9) AS lat, segment FROM f, (VALUES (0), (1)) x(u) WHERE geom_type = 'MultiPoint' OR (geom_type = 'Point' AND u = 0)")
def export_csv_points(t):
    path = scratch_path(t.spark, "csv")
    V.export_csv(_features(t).where("geom_type IN ('Point', 'MultiPoint')"), path, "c_custkey")
    back = t.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col("id").cast("long").alias("id"), F.round(F.col("lon").cast("double"), 9).alias("lon"), F.round(F.col("lat").cast("double"), 9).alias("lat"), "segment")


@query("import_csv_points", with_sql("arrivals") + """ SELECT CAST(event_id AS VARCHAR) AS feature_id, round(CASE WHEN event_id % 97 <> 0 THEN lon END, 9) AS lon, round(lat, 9) AS lat, CASE WHEN event_id % 97 = 0 THEN 'not-a-number' WHEN lon > 180 THEN 'out-of-range' END AS issue FROM arrivals""")
def import_csv_points(t):
    path = scratch_path(t.spark, "csv")
    a = t.arrivals.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("lon").cast("string")).alias("Longitude"), F.col("lat").alias("Latitude"), "value")
    a.write.option("header", True).csv(path)
    status, df, _ = V.import_csv(t.spark, path, "UTF-8")
    if status != "ready":
        raise ValueError(status)
    return df.select("feature_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "issue")


@query("export_per_layer", "SELECT 'res-map@v1' AS ref, 'export@1' AS algorithm, c_mktsegment AS layer_id, count(*) AS feature_count FROM customer GROUP BY ALL")
def export_per_layer(t):
    m = V.export_layers(_features(t), scratch_path(t.spark, "layers"), "c_mktsegment", "res-map@v1", "export@1")
    return m.drop("source_ref")


_CH = with_sql("units") + f", ch AS (SELECT *, (row_number() OVER (ORDER BY unit_id) - 1) // 100 AS chunk FROM units)"


def _version(t):
    path = scratch_path(t.spark, "version")
    u = t.units.select("unit_id", "lon", "lat", "value", "zone")
    return C.ingest(u, "unit_id", 100, path), C.rows(t.spark, path, u)


@query("scale_ingest", _CH + " SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS rows, round(min(lon), 9) AS west, round(min(lat), 9) AS south, round(max(lon), 9) AS east, round(max(lat), 9) AS north FROM ch GROUP BY 1")
def scale_ingest(t):
    m, _ = _version(t)
    return m.select("chunk", "rows", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


@query("scale_read_range", _CH + " SELECT unit_id, CAST(chunk AS BIGINT) AS chunk, value FROM ch WHERE chunk >= 3 AND chunk < 6")
def scale_read_range(t):
    return C.read_range(_version(t)[1], 3, 3).select("unit_id", "chunk", "value")


@query("scale_read_tile", with_sql("units") + " SELECT unit_id FROM units WHERE CAST(floor((lon+180)/360*512) AS BIGINT) = 421 AND CAST(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*512) AS BIGINT) = 193")
def scale_read_tile(t):
    m, rows = _version(t)
    return C.read_tile(rows, m, 9, 421, 193).select("unit_id")


@query("scale_read_query", with_sql("units") + " SELECT unit_id, value FROM units WHERE value >= 5000")
def scale_read_query(t):
    return C.read_query(_version(t)[1], "value", ">=", 5000).select("unit_id", "value")


@query("scale_scan", _CH + " SELECT count(DISTINCT chunk) AS chunks_done, count(*) AS rows_scanned, count(*) FILTER (value < 0) AS matched, (SELECT string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY unit_id) FROM (SELECT unit_id FROM units WHERE value < 0 ORDER BY unit_id LIMIT 20)) AS sample FROM ch")
def scale_scan(t):
    m, rows = _version(t)
    return C.scan(rows, m, "unit_id", "value", "<", 0, 20).select("chunks_done", "rows_scanned", "matched", "sample")


@query("log_export", with_sql("log") + " SELECT session_id, seq, type, time_ms FROM log")
def log_export(t):
    from terralog.sources.logs import export_log
    path = scratch_path(t.spark, "log")
    export_log(t.log, path)
    return t.spark.read.schema(t.log.schema).json(f"{path}/log").select("session_id", "seq", "type", "time_ms")

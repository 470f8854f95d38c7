"""Row-wise geometry and record queries."""

from pyspark.sql import functions as F

from terralog.fixtures import lon_of, lat_of, lonlat_sql, hav_sql, with_sql
from terralog.functions import geo
from terralog.operators import geometry as G
from terralog.operators import records as R
from terralog.queries.registry import query

PI = "pi()"


@query("geo_distance", with_sql("units") + f"""
SELECT unit_id, round({hav_sql('units', 'o')}, 6) AS dist_m FROM units, (SELECT 116.404::DOUBLE AS lon, 39.915::DOUBLE AS lat) o""")
def geo_distance(t):
    return t.units.select("unit_id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(116.404), F.lit(39.915)), 6).alias("dist_m"))


def _gcj_sql(sign: str) -> str:
    return f""", p AS (SELECT unit_id, CASE WHEN unit_id % 5 = 0 THEN lon - 60 ELSE lon END AS lon, lat FROM units),
q AS (SELECT *, lon - 105 AS x, lat - 35 AS y, 1 - 0.00669342162296594323::DOUBLE * pow(sin(radians(lat)), 2) AS m FROM p),
o AS (SELECT *,
 (-100 + 2*x + 3*y + 0.2::DOUBLE*y*y + 0.1::DOUBLE*x*y + 0.2::DOUBLE*sqrt(abs(x))
  + (20*sin(6*x*pi()) + 20*sin(2*x*pi()) + 20*sin(y*pi()) + 40*sin(y/3*pi()) + 160*sin(y/12*pi()) + 320*sin(y*pi()/30))*2/3) AS north,
 (300 + x + 2*y + 0.1::DOUBLE*x*x + 0.1::DOUBLE*x*y + 0.1::DOUBLE*sqrt(abs(x))
  + (20*sin(6*x*pi()) + 20*sin(2*x*pi()) + 20*sin(x*pi()) + 40*sin(x/3*pi()) + 150*sin(x/12*pi()) + 300*sin(x/30*pi()))*2/3) AS east FROM q),
s AS (SELECT *, lon BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 AS inside,
 east*180/(6378245.0::DOUBLE/sqrt(m)*cos(radians(lat))*pi()) AS dlon,
 north*180/(6378245.0::DOUBLE*(1-0.00669342162296594323::DOUBLE)/(m*sqrt(m))*pi()) AS dlat FROM o)
SELECT unit_id, round(CASE WHEN inside THEN lon {sign} dlon ELSE lon END, 8) AS lon,
 round(CASE WHEN inside THEN lat {sign} dlat ELSE lat END, 8) AS lat FROM s"""


def _gcj_input(t):
    return t.units.withColumn("lon", F.when(F.col("unit_id") % 5 == 0, F.col("lon") - 60).otherwise(F.col("lon")))


@query("gcj02_forward", with_sql("units") + _gcj_sql("+"))
def gcj02_forward(t):
    lon, lat = geo.wgs84_to_gcj02(F.col("lon"), F.col("lat"))
    return _gcj_input(t).select("unit_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("gcj02_inverse", with_sql("units") + _gcj_sql("-"))
def gcj02_inverse(t):
    lon, lat = geo.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    return _gcj_input(t).select("unit_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


# Input: identity, mercator and zone 39 (wkid 4548, central meridian 117E) by unit, plus an unknown code.
_CRS_SQL = with_sql("units") + """, k AS (SELECT *, unit_id % 4 AS r, 1/298.257222101::DOUBLE/(2-1/298.257222101::DOUBLE) AS n FROM units),
p AS (SELECT unit_id, CASE r WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN 4548 ELSE 9999 END AS wkid, n,
 CASE r WHEN 1 THEN radians(lon)*6378137.0::DOUBLE WHEN 2 THEN 500000 + (lon - 117)*85000.0::DOUBLE ELSE lon END AS x,
 CASE r WHEN 1 THEN ln(tan(pi()/4 + radians(lat)/2))*6378137.0::DOUBLE WHEN 2 THEN lat*111000.0::DOUBLE ELSE lat END AS y FROM k),
q AS (SELECT *, y/(6378137.0::DOUBLE/(1+n)*(1+n*n/4+pow(n,4)/64)) AS xi, (x-500000)/(6378137.0::DOUBLE/(1+n)*(1+n*n/4+pow(n,4)/64)) AS eta,
 n/2-2*n*n/3+37*pow(n,3)/96-pow(n,4)/360 AS b1, n*n/48+pow(n,3)/15-437*pow(n,4)/1440 AS b2, 17*pow(n,3)/480-37*pow(n,4)/840 AS b3, 4397*pow(n,4)/161280 AS b4,
 2*n-2*n*n/3-2*pow(n,3)+116*pow(n,4)/45 AS d1, 7*n*n/3-8*pow(n,3)/5-227*pow(n,4)/45 AS d2, 56*pow(n,3)/15-136*pow(n,4)/35 AS d3, 4279*pow(n,4)/630 AS d4 FROM p),
z AS (SELECT *, CASE WHEN wkid = 4548 THEN xi-b1*sin(2*xi)*cosh(2*eta)-b2*sin(4*xi)*cosh(4*eta)-b3*sin(6*xi)*cosh(6*eta)-b4*sin(8*xi)*cosh(8*eta) END AS xp,
 CASE WHEN wkid = 4548 THEN eta-b1*cos(2*xi)*sinh(2*eta)-b2*cos(4*xi)*sinh(4*eta)-b3*cos(6*xi)*sinh(6*eta)-b4*cos(8*xi)*sinh(8*eta) END AS ep FROM q),
c AS (SELECT *, asin(sin(xp)/cosh(ep)) AS chi FROM z)
SELECT unit_id, wkid,
 round(CASE wkid WHEN 4326 THEN x WHEN 3857 THEN degrees(x/6378137.0::DOUBLE) WHEN 4548 THEN 117 + degrees(atan2(sinh(ep), cos(xp))) END, 8) AS lon,
 round(CASE wkid WHEN 4326 THEN y WHEN 3857 THEN degrees(pi()/2 - 2*atan(exp(-y/6378137.0::DOUBLE)))
  WHEN 4548 THEN degrees(chi+d1*sin(2*chi)+d2*sin(4*chi)+d3*sin(6*chi)+d4*sin(8*chi)) END, 8) AS lat,
 CASE WHEN wkid = 9999 THEN 'unsupported-crs' END AS issue FROM c"""


@query("crs_to_wgs84", _CRS_SQL)
def crs_to_wgs84(t):
    r = F.col("unit_id") % 4
    mx, my = geo.wgs84_to_mercator(F.col("lon"), F.col("lat"))
    src = t.units.select(
        "unit_id", F.when(r == 0, 4326).when(r == 1, 3857).when(r == 2, 4548).otherwise(9999).alias("wkid"),
        F.when(r == 1, mx).when(r == 2, 500000 + (F.col("lon") - 117) * 85000.0).otherwise(F.col("lon")).alias("x"),
        F.when(r == 1, my).when(r == 2, F.col("lat") * 111000.0).otherwise(F.col("lat")).alias("y"))
    return G.to_wgs84(src).select("unit_id", "wkid", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), "issue")


@query("tile_of", with_sql("units") + """
SELECT unit_id, 12 AS z, CAST(floor((lon+180)/360*4096) AS BIGINT) AS x,
 CAST(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*4096) AS BIGINT) AS y FROM units""")
def tile_of(t):
    return t.units.select("unit_id", F.lit(12).alias("z"), geo.tile_x(F.col("lon"), 12).alias("x"), geo.tile_y(F.col("lat"), 12).alias("y"))


@query("geom_admit", with_sql("arrivals") + """
SELECT event_id, dup, CASE WHEN event_id % 37 = 0 THEN 'empty' WHEN lon > 180 THEN 'out-of-range' END AS issue FROM arrivals""")
def geom_admit(t):
    vertices = F.when(F.col("event_id") % 37 == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    return t.arrivals.select("event_id", "dup", G.admit_issue(vertices).alias("issue"))


def shapes(t):
    """A small square per customer; some rings are crossed, open or carry a repeated point."""
    k = F.col("c_custkey")
    s = 0.001 * (1 + k % 5)
    lon, lat = lon_of(k), lat_of(k)

    def v(dx, dy):
        return F.struct((lon + dx * s).alias("x"), (lat + dy * s).alias("y"))
    bow, open_, rep = k % 7 == 0, k % 11 == 0, k % 13 == 0
    ring = F.array(v(0, 0), F.when(rep, v(0, 0)).otherwise(v(1, 0)), F.when(bow, v(0, 1)).otherwise(v(1, 1)),
                   F.when(bow, v(1, 1)).otherwise(v(0, 1)), F.when(open_, v(0, 2)).otherwise(v(0, 0)))
    return t.customer.select(k.alias("unit_id"), F.col("c_nationkey").alias("zone"), ring.alias("ring"))


SHAPES_SQL = f"""shapes AS (SELECT c_custkey AS unit_id, c_nationkey AS zone, i, lon + dx*(0.001::DOUBLE*(1 + c_custkey % 5)) AS x,
 lat + dy*(0.001::DOUBLE*(1 + c_custkey % 5)) AS y FROM (SELECT *, {lonlat_sql('c_custkey')},
 CASE i WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END WHEN 2 THEN CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END
  WHEN 3 THEN CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END ELSE 0 END AS dx,
 CASE i WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END ELSE 0 END AS dy
 FROM customer, (VALUES (0),(1),(2),(3),(4)) v(i)))"""


@query("ring_valid", f"""WITH {SHAPES_SQL},
seg AS (SELECT a.unit_id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM shapes a JOIN shapes b ON a.unit_id = b.unit_id AND b.i = a.i + 1),
pair AS (SELECT s.unit_id, s.ax, s.ay, s.bx, s.by_, t.ax AS cx, t.ay AS cy, t.bx AS dx, t.by_ AS dy,
 (s.bx-s.ax)*(t.ay-s.ay)-(s.by_-s.ay)*(t.ax-s.ax) AS o1, (s.bx-s.ax)*(t.by_-s.ay)-(s.by_-s.ay)*(t.bx-s.ax) AS o2,
 (t.bx-t.ax)*(s.ay-t.ay)-(t.by_-t.ay)*(s.ax-t.ax) AS o3, (t.bx-t.ax)*(s.by_-t.ay)-(t.by_-t.ay)*(s.bx-t.ax) AS o4
 FROM seg s JOIN seg t ON s.unit_id = t.unit_id AND t.i >= s.i + 2 AND NOT (s.i = 0 AND t.i = 3)),
crossed AS (SELECT DISTINCT unit_id FROM pair WHERE ((o1 > 0) <> (o2 > 0) AND (o3 > 0) <> (o4 > 0))
 OR (o1 = 0 AND cx BETWEEN least(ax,bx) AND greatest(ax,bx) AND cy BETWEEN least(ay,by_) AND greatest(ay,by_))
 OR (o2 = 0 AND dx BETWEEN least(ax,bx) AND greatest(ax,bx) AND dy BETWEEN least(ay,by_) AND greatest(ay,by_))
 OR (o3 = 0 AND ax BETWEEN least(cx,dx) AND greatest(cx,dx) AND ay BETWEEN least(cy,dy) AND greatest(cy,dy))
 OR (o4 = 0 AND bx BETWEEN least(cx,dx) AND greatest(cx,dx) AND by_ BETWEEN least(cy,dy) AND greatest(cy,dy)))
SELECT c_custkey AS unit_id, c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND crossed.unit_id IS NULL AS valid
FROM customer LEFT JOIN crossed ON crossed.unit_id = c_custkey""")
def ring_valid(t):
    return shapes(t).select("unit_id", G.ring_valid(F.col("ring")).alias("valid"))


@query("geom_parts", f"""WITH {SHAPES_SQL} SELECT unit_id, CAST(i AS INT) AS part_index, round(x, 9) AS x, round(y, 9) AS y FROM shapes""")
def geom_parts(t):
    parts = G.geom_parts(shapes(t).withColumnRenamed("ring", "parts"))
    return parts.select("unit_id", "part_index", F.round("part.x", 9).alias("x"), F.round("part.y", 9).alias("y"))


@query("bbox", with_sql("units") + """
, e AS (SELECT zone, unit_id % 2 AS half, min(lon) w, min(lat) s, max(lon) e, max(lat) n FROM units GROUP BY ALL
 UNION ALL SELECT -1, unit_id, lon, lat, lon, lat FROM units)
SELECT zone, half, round(CASE WHEN e - w < 2.3e-16 THEN w - 0.01 ELSE w END, 8) AS west, round(CASE WHEN n - s < 2.3e-16 THEN s - 0.01 ELSE s END, 8) AS south,
 round(CASE WHEN e - w < 2.3e-16 THEN e + 0.01 ELSE e END, 8) AS east, round(CASE WHEN n - s < 2.3e-16 THEN n + 0.01 ELSE n END, 8) AS north FROM e""")
def bbox(t):
    u = t.units.select("unit_id", "zone", "lon", "lat")
    both = u.select("zone", (F.col("unit_id") % 2).alias("half"), "lon", "lat").unionByName(
        u.select(F.lit(-1).alias("zone"), F.col("unit_id").alias("half"), "lon", "lat"))
    b = G.bbox(both, ["zone", "half"])
    return b.select("zone", "half", *[F.round(c, 8).alias(c) for c in ("west", "south", "east", "north")])


@query("geo_area", f"""WITH {SHAPES_SQL}
SELECT a.unit_id, round(abs(sum(radians(b.x-a.x)*(2+sin(radians(a.y))+sin(radians(b.y)))))*6371008.8::DOUBLE*6371008.8::DOUBLE/2, 2) AS area_m2
FROM shapes a JOIN shapes b ON a.unit_id = b.unit_id AND b.i = a.i + 1 GROUP BY a.unit_id""")
def geo_area(t):
    return shapes(t).select("unit_id", F.round(geo.polygon_area_m2(F.array("ring")), 2).alias("area_m2"))


@query("geo_buffer", with_sql("units") + """, v AS (SELECT unit_id, lon, lat, i, 500.0::DOUBLE/6371008.8::DOUBLE AS d, radians((i % 16)*22.5::DOUBLE) AS th FROM units, range(17) r(i)),
w AS (SELECT *, sin(radians(lat))*cos(d)+cos(radians(lat))*sin(d)*cos(th) AS s2 FROM v),
p AS (SELECT unit_id, i, lon + degrees(atan2(sin(th)*sin(d)*cos(radians(lat)), cos(d)-sin(radians(lat))*s2)) AS x, degrees(asin(s2)) AS y FROM w)
SELECT a.unit_id, round(abs(sum(radians(b.x-a.x)*(2+sin(radians(a.y))+sin(radians(b.y)))))*6371008.8::DOUBLE*6371008.8::DOUBLE/2, 1) AS area_m2,
 round(min(a.x), 7) AS west, round(max(a.y), 7) AS north FROM p a JOIN p b ON a.unit_id = b.unit_id AND b.i = a.i + 1 GROUP BY a.unit_id""")
def geo_buffer(t):
    b = G.geo_buffer(t.units.select("unit_id", "lon", "lat"), 500.0, 16)
    return b.select("unit_id", F.round("area_m2", 1).alias("area_m2"),
                    F.round(F.array_min(F.transform("ring", lambda p: p["x"])), 7).alias("west"),
                    F.round(F.array_max(F.transform("ring", lambda p: p["y"])), 7).alias("north"))


# One "image" per supplier: corner controls from its position, plus two noisy check points.
def _controls(t):
    k = F.col("s_suppkey")
    w, h = (640 + k % 100).cast("double"), (480 + k % 50).cast("double")
    lon, lat = lon_of(k), lat_of(k)
    sx = F.when(k % 23 == 0, 0.0).otherwise(0.001 + (k % 7) * 0.0001)
    noise = (k % 5) * 0.0000015

    def row(role, u, v, n):
        return F.struct(F.lit(role).alias("role"), u.alias("u"), v.alias("v"),
                        (lon + sx * u + n).alias("x"), (lat - 0.001 * v).alias("y"))
    zero = F.lit(0.0)
    rows = F.array(row("p0", zero, zero, 0.0), row("px", w, zero, 0.0), row("py", zero, h, 0.0),
                   row("check", w / 2, h / 2, noise * 100), row("check", w / 4, h / 3, noise * 1000))
    return t.supplier.select(k.alias("image_id"), w.alias("width"), h.alias("height"), F.inline(rows))


CONTROLS_SQL = f"""base AS (SELECT s_suppkey AS k, (640 + s_suppkey % 100)::DOUBLE AS w, (480 + s_suppkey % 50)::DOUBLE AS h, {lonlat_sql('s_suppkey')},
 CASE WHEN s_suppkey % 23 = 0 THEN 0.0::DOUBLE ELSE 0.001::DOUBLE + (s_suppkey % 7)*0.0001::DOUBLE END AS sx, (s_suppkey % 5)*0.0000015::DOUBLE AS noise FROM supplier),
fit AS (SELECT *, ((lon + sx*w) - lon)/w AS a, 0.0::DOUBLE AS b, lon AS c, 0.0::DOUBLE AS d, ((lat - 0.001::DOUBLE*h) - lat)/h AS e, lat AS f FROM base),
chk AS (SELECT *, a*u + c - (lon + sx*u + nz) AS dx, e*v + f - (lat - 0.001::DOUBLE*v) AS dy, a*e AS det FROM
 (SELECT *, w/2 AS u, h/2 AS v, noise*100 AS nz FROM fit UNION ALL SELECT *, w/4, h/3, noise*1000 FROM fit)),
res AS (SELECT k, max(CASE WHEN det <> 0 THEN sqrt(pow(e*dx/det, 2) + pow(a*dy/det, 2)) END) AS residual FROM chk GROUP BY k),
aff AS (SELECT fit.*, CASE WHEN a*e = 0 THEN 'singular-mapping' WHEN residual > 1 THEN 'excessive-residual' ELSE 'affine' END AS status, residual FROM fit JOIN res USING (k))"""


@query("affine_fit", f"WITH {CONTROLS_SQL} SELECT k AS image_id, round(a, 9) AS a, round(e, 9) AS e, round(c, 9) AS c, round(f, 9) AS f, status, round(residual, 4) AS residual FROM aff")
def affine_fit(t):
    fit = G.affine_fit(_controls(t))
    return fit.select("image_id", *[F.round(c, 9).alias(c) for c in "aecf"], "status", F.round("residual", 4).alias("residual"))


@query("pixel_to_world", f"""WITH {CONTROLS_SQL},
px AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity*20 AS u, l_quantity*11 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, issue, round(CASE WHEN issue IS NULL THEN a*u + c END, 8) AS lon, round(CASE WHEN issue IS NULL THEN e*v + f END, 8) AS lat
FROM (SELECT *, CASE WHEN status <> 'affine' THEN status WHEN u > w OR v > h THEN 'outside-map' END AS issue FROM px JOIN aff ON k = l_suppkey)""")
def pixel_to_world(t):
    k = F.col("l_suppkey")
    px = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", k.alias("image_id"), (F.col("l_quantity") * 20).alias("u"), (F.col("l_quantity") * 11).alias("v"),
                           (640 + k % 100).alias("width"), (480 + k % 50).alias("height"))
    out = G.pixel_to_world(px, G.affine_fit(_controls(t)))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "issue", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query("canonical_digest", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS digest FROM part""")
def canonical_digest(t):
    return t.part.select("p_partkey", R.canonical_digest({"size": F.col("p_size"), "name": F.col("p_name"), "brand": F.col("p_brand")}).alias("digest"))


@query("feature_ref", """SELECT p_partkey, 'f-' || substring(sha256('{"id":' || p_partkey || ',"type":"' || p_type || '"}'), 1, 16) AS ref FROM part""")
def feature_ref(t):
    return t.part.select("p_partkey", R.feature_ref({"type": F.col("p_type"), "id": F.col("p_partkey")}).alias("ref"))


@query("import_fingerprint", """SELECT doc_id, sha256('{"candidates":["lon","lat"],"encoding":"utf-8","format":"csv","nativeCrs":"EPSG:4326","sourceDigest":"' || sha256(text) || '"}') AS fingerprint FROM documents""")
def import_fingerprint(t):
    return t.documents.select("doc_id", R.import_fingerprint(
        F.lit("csv"), F.sha2(F.col("text"), 256), F.lit("utf-8"), F.lit("EPSG:4326"), F.array(F.lit("lon"), F.lit("lat"))).alias("fingerprint"))


@query("sanitize_records", """WITH f AS (SELECT event_id, event_type, user_id, ['Api-Key','user_token','note','geometry'][event_id % 4 + 1] AS k,
 CASE WHEN event_id % 3 = 0 THEN '/home/u' || user_id || '/data.csv' WHEN event_id % 3 = 1 THEN '[1,2]' ELSE event_type END AS v FROM events),
m AS (SELECT *, CASE WHEN k IN ('Api-Key','user_token') THEN 'credential' WHEN k = 'geometry' AND v LIKE '[%' THEN 'geometry' WHEN v LIKE '/home/%' THEN 'path' END AS mark FROM f)
SELECT event_id, k, CASE mark WHEN 'credential' THEN '[redacted:' || k || ']' WHEN 'geometry' THEN '{"obsRedacted":"geometry"}' WHEN 'path' THEN '<path>' ELSE v END AS v,
 coalesce(mark || ':' || k, '') AS redactions FROM m""")
def sanitize_records(t):
    e = F.col("event_id")
    key = F.element_at(F.array(*map(F.lit, ("Api-Key", "user_token", "note", "geometry"))), (e % 4 + 1).cast("int"))
    val = F.when(e % 3 == 0, F.concat(F.lit("/home/u"), F.col("user_id"), F.lit("/data.csv"))).when(e % 3 == 1, "[1,2]").otherwise(F.col("event_type"))
    rows = t.events.select(e, key.alias("k"), F.create_map(key, val, F.lit("kind"), F.lit("plain")).alias("fields"))
    return R.sanitize_map(rows).select("event_id", "k", F.col("fields")[F.col("k")].alias("v"), F.array_join("redactions", ",").alias("redactions"))


@query("display_supported", """SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'GeometryCollection' WHEN 3 THEN 'MultiLineString' END AS geom_type,
 coalesce(event_id % 5 IN (0, 1, 3), false) AS supported, count(*) AS n FROM events GROUP BY ALL""")
def display_supported(t):
    e = F.col("event_id") % 5
    g = F.when(e == 0, "Point").when(e == 1, "Polygon").when(e == 2, "GeometryCollection").when(e == 3, "MultiLineString")
    return (t.events.select("event_type", g.alias("geom_type")).withColumn("supported", R.display_supported(F.col("geom_type")))
            .groupBy("event_type", "geom_type", "supported").agg(F.count(F.lit(1)).alias("n")))


_NAME_WORDS = ("business park", "bus stop", "Rivers", "city boundary", "main road", "water road", "layer")


@query("infer_semantic", f"""SELECT p_partkey, name, CASE WHEN name LIKE '%bus stop%' THEN 'transit' WHEN name LIKE '%Rivers%' OR name LIKE '%water%' THEN 'water'
 WHEN name LIKE '%boundary%' THEN 'boundary' WHEN name LIKE '%road%' THEN 'road' END AS semantic
 FROM (SELECT p_partkey, p_name || ' ' || {list(_NAME_WORDS)}[p_partkey % 7 + 1] AS name FROM part)""")
def infer_semantic(t):
    word = F.element_at(F.array(*map(F.lit, _NAME_WORDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", word).alias("name")).withColumn("semantic", R.infer_semantic(F.col("name")))


_URL = """CASE page_id % 6 WHEN 1 THEN replace(url, 'http://', 'http://user:pw@') WHEN 2 THEN replace(url, 'http://', 'ftp://')
 WHEN 3 THEN repeat(url, 60) WHEN 4 THEN 'http://' ELSE url END"""


@query("url_policy", f"""SELECT page_id, CASE WHEN length(u) > 2048 THEN 'too-long' WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'invalid'
 WHEN NOT regexp_matches(u, '^https?:', 'i') THEN 'scheme' WHEN NOT regexp_matches(u, '^https?://[^/?#]+', 'i') THEN 'invalid'
 WHEN regexp_matches(u, '^https?://[^/?#]*@', 'i') THEN 'credentials' ELSE 'ok' END AS policy FROM (SELECT page_id, {_URL} AS u FROM pages)""")
def url_policy(t):
    return t.pages.select("page_id", F.expr(_URL).alias("u")).select("page_id", R.url_policy(F.col("u")).alias("policy"))

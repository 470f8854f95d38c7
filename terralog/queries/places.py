"""Access, overlay and terrain queries."""

from pyspark.sql import functions as F

from terralog.fixtures import hav_sql, lat_of, lon_of, lonlat_sql, with_sql
from terralog.functions.geo import micro
from terralog.operators import access as A
from terralog.operators import geometry as G
from terralog.operators import overlay as O
from terralog.operators import shapes as P
from terralog.operators import terrain as R
from terralog.queries.registry import query

PF = with_sql("population", "facilities")


@query("straight_line_explore", PF + f" SELECT unit_id, fac_id, round({hav_sql('p', 'f')}, 6) AS dist_m, false AS network_evidence FROM population p JOIN facilities f ON {hav_sql('p', 'f')} <= 5000")
def straight_line_explore(t):
    return A.straight_line(t.population, t.facilities, 5000.0).withColumn("dist_m", micro(F.col("dist_m")))


@query("nearest_facility", PF + f", d AS (SELECT unit_id, fac_id, {hav_sql('p', 'f')} AS d FROM population p, facilities f) SELECT unit_id, fac_id, round(d, 6) AS dist_m, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY d, fac_id) AS rn FROM d) WHERE rn <= 2")
def nearest_facility(t):
    return A.nearest(t.population, t.facilities, 2).withColumn("dist_m", F.round("dist_m", 6))


STEP, LAT0 = 300.0, 40.0
_NODE = "CAST(floor(lon*(6371008.8::DOUBLE*pi()/180*cos(radians(40.0::DOUBLE)))/300) AS BIGINT) AS ix, CAST(floor(lat*(6371008.8::DOUBLE*pi()/180)/300) AS BIGINT) AS iy"
# Bike at 250 m/min: 1.2 min per step; 6 minutes are 5 steps. Barriers: the nodes of rich customers.
_OD = PF.replace("WITH ", "WITH RECURSIVE ") + f""", bar AS (SELECT DISTINCT {_NODE} FROM (SELECT {lonlat_sql('c_custkey')} FROM customer WHERE c_acctbal > 9000)), home AS (SELECT fac_id, {_NODE} FROM facilities),
bfs AS (SELECT fac_id, ix, iy, 0 AS s FROM home WHERE (ix, iy) NOT IN (FROM bar) UNION SELECT fac_id, ix + dx, iy + dy, s + 1 FROM bfs, (VALUES (1,0),(-1,0),(0,1),(0,-1)) m(dx, dy) WHERE s < 5 AND (ix + dx, iy + dy) NOT IN (FROM bar)),
reach AS (SELECT fac_id, ix, iy, min(s)*1.2::DOUBLE AS minutes FROM bfs GROUP BY ALL), pn AS (SELECT *, {_NODE} FROM population), od AS (SELECT unit_id, fac_id, minutes, population FROM pn JOIN reach USING (ix, iy))"""


def _reach(t):
    k = F.col("c_custkey")
    ix, iy = A.node_of(lon_of(k), lat_of(k), STEP, LAT0)
    bar = t.customer.where("c_acctbal > 9000").select(ix.alias("ix"), iy.alias("iy")).distinct()
    return A.reach_nodes(t.facilities, bar, STEP, LAT0, 6.0, "bike")


def _od(t):
    return A.od_cost(t.population, _reach(t), STEP, LAT0)


@query("od_cost_matrix", _OD + " SELECT unit_id, fac_id, round(minutes, 6) AS minutes FROM od")
def od_cost_matrix(t):
    return _od(t).withColumn("minutes", F.round("minutes", 6))


@query("service_area", _OD + " SELECT fac_id, ix, iy, round(minutes, 6) AS minutes FROM reach WHERE minutes <= 3.7")
def service_area(t):
    return A.service_area(_reach(t), 3.7).withColumn("minutes", F.round("minutes", 6))


# Nodes of customers in debt take three times as long to cross, those with little money twice: costs in half steps of 0.6 minutes, ten at most.
_OW = PF.replace("WITH ", "WITH RECURSIVE ") + f""", bar AS (SELECT DISTINCT {_NODE} FROM (SELECT {lonlat_sql('c_custkey')} FROM customer WHERE c_acctbal > 9000)), home AS (SELECT fac_id, {_NODE} FROM facilities),
slow AS (SELECT ix, iy, max(f) AS f FROM (SELECT {_NODE}, CASE WHEN c_acctbal < 0 THEN 3 ELSE 2 END AS f FROM (SELECT *, {lonlat_sql('c_custkey')} FROM customer WHERE c_acctbal < 1500)) GROUP BY ALL),
walk AS (SELECT fac_id, h.ix, h.iy, 0 AS c, coalesce(f, 1) AS own FROM home h LEFT JOIN slow USING (ix, iy) WHERE (h.ix, h.iy) NOT IN (FROM bar)
 UNION SELECT w.fac_id, w.ix + dx, w.iy + dy, c + own + coalesce(f, 1), coalesce(f, 1) FROM walk w CROSS JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) m(dx, dy) LEFT JOIN slow ON slow.ix = w.ix + dx AND slow.iy = w.iy + dy
 WHERE c + own + coalesce(f, 1) <= 10 AND (w.ix + dx, w.iy + dy) NOT IN (FROM bar)),
reach AS (SELECT fac_id, ix, iy, min(c)*0.6::DOUBLE AS minutes FROM walk GROUP BY ALL), pn AS (SELECT *, {_NODE} FROM population)"""


def _slow_reach(t):
    k = F.col("c_custkey")
    ix, iy = A.node_of(lon_of(k), lat_of(k), STEP, LAT0)
    node = t.customer.select("c_acctbal", ix.alias("ix"), iy.alias("iy"))
    slow = node.where("c_acctbal < 1500").select("ix", "iy", F.when(F.col("c_acctbal") < 0, 3).otherwise(2).alias("factor"))
    return A.reach_nodes(t.facilities, node.where("c_acctbal > 9000").select("ix", "iy").distinct(), STEP, LAT0, 6.0, "bike", slowness=slow)


@query("od_cost_weighted", _OW + " SELECT unit_id, fac_id, round(minutes, 6) AS minutes FROM pn JOIN reach USING (ix, iy)")
def od_cost_weighted(t):
    return A.od_cost(t.population, _slow_reach(t), STEP, LAT0).withColumn("minutes", F.round("minutes", 6))


@query("service_area_weighted", _OW + " SELECT fac_id, ix, iy, round(minutes, 6) AS minutes FROM reach WHERE minutes <= 3.7")
def service_area_weighted(t):
    return A.service_area(_slow_reach(t), 3.7).withColumn("minutes", F.round("minutes", 6))


@query("coverage", _OD + """ SELECT CAST(sum(population) AS BIGINT) AS denominator, CAST(sum(population) FILTER (unit_id IN (SELECT unit_id FROM od)) AS BIGINT) AS covered, CAST(sum(population) FILTER (unit_id NOT IN (SELECT unit_id FROM od)) AS BIGINT) AS uncovered,
 sum(population) FILTER (unit_id IN (SELECT unit_id FROM od))/sum(population)::DOUBLE AS ratio, 'partial' AS outcome FROM population""")
def coverage(t):
    return A.coverage(t.population, _od(t), 6.0)


@query("coverage_capacity", _OD + """, b AS (SELECT unit_id, min(minutes) AS m, arg_min(fac_id, (minutes, fac_id)) AS fac_id, any_value(population) AS population FROM od GROUP BY 1),
r AS (SELECT *, sum(population) OVER (PARTITION BY fac_id ORDER BY m, unit_id) AS upto FROM b)
SELECT r.fac_id, capacity, CAST(sum(population) AS BIGINT) AS demand, CAST(coalesce(sum(population) FILTER (upto <= capacity), 0) AS BIGINT) AS served, count(*) FILTER (upto > capacity) AS turned_away FROM r JOIN (SELECT fac_id, 100 + fac_id % 200 AS capacity FROM facilities) f ON f.fac_id = r.fac_id GROUP BY ALL""")
def coverage_capacity(t):
    facs = t.facilities.withColumn("capacity", 100 + F.col("fac_id") % 200)
    return A.capacity_load(t.population, _od(t), facs, 6.0)


# ---- shapes ----------------------------------------------------------------------------------

def _squares(t, where: str = "true"):
    k = F.col("c_custkey")
    s = 0.001 * (1 + k % 5)
    lon, lat = lon_of(k), lat_of(k)

    def v(dx, dy):
        return F.struct((lon + dx * s).alias("x"), (lat + dy * s).alias("y"))
    return t.customer.where(where).select(k.alias("unit_id"), F.array(v(0, 0), v(1, 0), v(1, 1), v(0, 1), v(0, 0)).alias("ring"))


def _zone_rings(t):
    def v(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return t.zones.select("zone_id", F.array(v("west", "south"), v("east", "south"), v("east", "north"), v("west", "north"), v("west", "south")).alias("ring"))


_SQ = f"sq AS (SELECT c_custkey AS unit_id, lon AS w, lat AS s, lon + 0.001::DOUBLE*(1 + c_custkey % 5) AS e, lat + 0.001::DOUBLE*(1 + c_custkey % 5) AS n, c_mktsegment AS seg FROM (SELECT *, {lonlat_sql('c_custkey')} FROM customer))"


@query("geo_intersect", with_sql("zones") + f""", {_SQ}, i AS (SELECT unit_id, zone_id, greatest(w, west) AS w, least(e, east) AS e, greatest(s, south) AS s, least(n, north) AS n FROM sq JOIN zones ON w <= east AND e >= west AND s <= north AND n >= south)
SELECT unit_id, zone_id, round(radians(e - w)*(sin(radians(n)) - sin(radians(s)))*6371008.8::DOUBLE*6371008.8::DOUBLE, 1) AS area_m2 FROM i WHERE e - w > 1e-12 AND n - s > 1e-12""")
def geo_intersect(t):
    return P.intersects(_squares(t), _zone_rings(t), "unit_id", "zone_id").where("area_m2 > 1e-4").withColumn("area_m2", F.round("area_m2", 1))


@query("geo_within", with_sql("units", "zones") + " SELECT zone_id, count(*) AS n, min(unit_id) AS first_unit FROM units JOIN zones ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY 1")
def geo_within(t):
    hit = A.within(t.units.select("unit_id", "lon", "lat"), _zone_rings(t), 0.05, "unit_id", "zone_id")
    return hit.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.min("unit_id").alias("first_unit"))


CELL = 0.0005


_CELL_AREA = f"6371008.8::DOUBLE*6371008.8::DOUBLE*radians({CELL}::DOUBLE)*(sin(radians((cy + 1)*{CELL}::DOUBLE)) - sin(radians(cy*{CELL}::DOUBLE)))"


def _ov_sql(setop: str) -> str:
    def cells(seg: str) -> str:
        return f"""SELECT DISTINCT x AS cx, y AS cy FROM sq, LATERAL (SELECT unnest(generate_series(CAST(floor(w/{CELL}::DOUBLE) AS BIGINT), CAST(floor(e/{CELL}::DOUBLE) AS BIGINT))) AS x), LATERAL (SELECT unnest(generate_series(CAST(floor(s/{CELL}::DOUBLE) AS BIGINT), CAST(floor(n/{CELL}::DOUBLE) AS BIGINT))) AS y)
 WHERE seg {seg} AND (x + 0.5::DOUBLE)*{CELL}::DOUBLE >= w AND (x + 0.5::DOUBLE)*{CELL}::DOUBLE < e AND (y + 0.5::DOUBLE)*{CELL}::DOUBLE >= s AND (y + 0.5::DOUBLE)*{CELL}::DOUBLE < n"""
    def at(c: str) -> str:
        return f"CAST(floor({c}/{CELL}::DOUBLE) AS BIGINT)"
    return f"""WITH {_SQ}, ix AS (SELECT {at('w')} AS c0, {at('e')} AS c1, {at('s')} AS r0, {at('n')} AS r1 FROM sq), a AS ({cells("IN ('BUILDING', 'MACHINERY')")}), b AS ({cells("NOT IN ('BUILDING', 'MACHINERY')")}), o AS (FROM a {setop} FROM b),
bd AS (SELECT unnest(range(r0, r1 + 1)) AS cy, 2 AS cells FROM ix UNION ALL SELECT unnest([r0, r1]) AS cy, c1 - c0 + 1 AS cells FROM ix)
SELECT count(*) AS cells, round(sum({_CELL_AREA}), 0) AS area_m2, {CELL}::DOUBLE AS resolution_deg, (SELECT round(sum(cells*{_CELL_AREA}), 0) FROM bd) AS error_bound_m2 FROM o"""


def _overlay(t, op):
    seg = "c_mktsegment IN ('BUILDING', 'MACHINERY')"
    o = O.overlay_area(_squares(t, seg), _squares(t, f"NOT {seg}"), op, CELL)
    return o.select("cells", F.round("area_m2", 0).alias("area_m2"), "resolution_deg", F.round("error_bound_m2", 0).alias("error_bound_m2"))


@query("geo_union", _ov_sql("UNION"))
def geo_union(t):
    return _overlay(t, "union")


@query("geo_difference", _ov_sql("EXCEPT"))
def geo_difference(t):
    return _overlay(t, "difference")


@query("geo_overlay_intersect", _ov_sql("INTERSECT"))
def geo_overlay_intersect(t):
    return _overlay(t, "intersect")


# ---- terrain ---------------------------------------------------------------------------------

SF = with_sql("surface")
_CORN = """, cn AS (SELECT p.gx, p.gy, p.elev AS a, b.elev AS b, c.elev AS c, d.elev AS d FROM surface p JOIN surface b ON b.gx = p.gx + 1 AND b.gy = p.gy JOIN surface c ON c.gx = p.gx + 1 AND c.gy = p.gy + 1 JOIN surface d ON d.gx = p.gx AND d.gy = p.gy + 1)"""


@query("terrain_slope", SF + """, n AS (SELECT p.gx, p.gy, count(*) AS n, sum(q.elev*(q.gx - p.gx)*(2 - abs(q.gy - p.gy))) AS x, sum(q.elev*(q.gy - p.gy)*(2 - abs(q.gx - p.gx))) AS y
 FROM surface p JOIN (SELECT s.*, dx, dy FROM surface s, (VALUES (-1),(0),(1)) a(dx), (VALUES (-1),(0),(1)) b(dy)) q ON q.gx = p.gx + q.dx AND q.gy = p.gy + q.dy GROUP BY ALL)
SELECT gx, gy, round(degrees(atan(sqrt(pow(x/800, 2) + pow(y/800, 2)))), 6) AS slope_deg FROM n WHERE n = 9""")
def terrain_slope(t):
    return R.slope(t.surface, 100.0).withColumn("slope_deg", F.round("slope_deg", 6))


@query("terrain_contours", SF + _CORN + """, l AS (SELECT *, (a >= level) AS ua, (b >= level) AS ub, (c >= level) AS uc, (d >= level) AS ud FROM cn, (VALUES (15.0::DOUBLE), (30.0::DOUBLE), (45.0::DOUBLE)) v(level)),
e AS (SELECT gx, gy, level, ua = ((a + b + c + d)/4 >= level) AS joined, CASE WHEN ua <> ub THEN [gx + (level - a)/(b - a), gy] END AS s, CASE WHEN ub <> uc THEN [gx + 1, gy + (level - b)/(c - b)] END AS e,
 CASE WHEN ud <> uc THEN [gx + (level - d)/(c - d), gy + 1] END AS n, CASE WHEN ua <> ud THEN [gx, gy + (level - a)/(d - a)] END AS w FROM l),
h AS (SELECT *, list_filter([s, e, n, w], lambda v: v IS NOT NULL) AS hs FROM e),
g AS (SELECT gx, gy, level, unnest(CASE WHEN len(hs) = 2 THEN [[hs[1], hs[2]]] WHEN len(hs) = 4 AND joined THEN [[s, e], [n, w]] WHEN len(hs) = 4 THEN [[s, w], [e, n]] ELSE [] END) AS sg FROM h)
SELECT gx, gy, level, round(sg[1][1], 6) AS x1, round(sg[1][2], 6) AS y1, round(sg[2][1], 6) AS x2, round(sg[2][2], 6) AS y2 FROM g""")
def terrain_contours(t):
    c = R.contours(t.surface, [15.0, 30.0, 45.0])
    return c.select("gx", "gy", "level", *[F.round(k, 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("terrain_sample", SF + _CORN + """, p AS (SELECT event_id, (event_id * 37 % 13100)/100.0::DOUBLE AS x, (event_id * 91 % 9000)/100.0::DOUBLE AS y FROM events)
SELECT event_id, round(a*(1-fx)*(1-fy) + b*fx*(1-fy) + c*fx*fy + d*(1-fx)*fy, 6) AS elev, CASE WHEN a IS NULL THEN 'off-surface' END AS issue FROM (SELECT event_id, x - floor(x) AS fx, y - floor(y) AS fy, floor(x) AS px, floor(y) AS py FROM p) LEFT JOIN cn ON gx = px AND gy = py""")
def terrain_sample(t):
    e = F.col("event_id")
    p = t.events.select(e, ((e * 37 % 13100) / 100.0).alias("x"), ((e * 91 % 9000) / 100.0).alias("y"))
    return R.sample(t.surface, p).select("event_id", F.round("elev", 6).alias("elev"), "issue")


def los_sql(keys: str, spacing: float, acc: float, obs_m: float) -> str:
    """CTEs ending in v(keys, status, first_obstruction_m) over lines ln(keys, x1, y1, x2, y2) with unit interval."""
    on = " AND ".join(f"m.{k} = n.{k}" for k in keys.split(", "))
    return f"""sm AS (SELECT *, i/st::DOUBLE AS f FROM (SELECT *, unnest(range(0, st + 1)) AS i FROM (SELECT *, greatest(CAST(ceil(sqrt(pow(x2-x1, 2) + pow(y2-y1, 2))) AS INT), 1) AS st, sqrt(pow(x2-x1, 2) + pow(y2-y1, 2)) AS span FROM ln))),
sp AS (SELECT *, x1 + (x2-x1)*f AS sx, y1 + (y2-y1)*f AS sy FROM sm),
gr AS (SELECT sp.*, f*span*{spacing} AS dist, a*(1-(sx-floor(sx)))*(1-(sy-floor(sy))) + b*(sx-floor(sx))*(1-(sy-floor(sy))) + c*(sx-floor(sx))*(sy-floor(sy)) + d*(1-(sx-floor(sx)))*(sy-floor(sy)) AS ground FROM sp LEFT JOIN cn ON gx = floor(sx) AND gy = floor(sy)),
en AS (SELECT {keys}, max(ground) FILTER (i = 0) AS z1, max(ground) FILTER (i = st) AS z2, bool_or(ground IS NULL) AS outside FROM gr GROUP BY ALL),
cl AS (SELECT {', '.join('m.' + k for k in keys.split(', '))}, dist, z1 + {obs_m} + (z2 - z1 - {obs_m})*f - ground AS clear FROM gr m JOIN en n ON {on} WHERE i > 0 AND i < st),
pr AS (SELECT {keys}, bool_or(clear < -{acc}) AS blocked, bool_or(abs(clear) <= {acc}) AS grazes, min(dist) FILTER (clear < -{acc}) AS fd FROM cl GROUP BY ALL),
v AS (SELECT {', '.join('m.' + k for k in keys.split(', '))}, CASE WHEN outside THEN 'outside' WHEN blocked THEN 'blocked' WHEN grazes THEN 'indeterminate' ELSE 'visible' END AS status, CASE WHEN NOT outside THEN fd END AS first_obstruction_m FROM en m LEFT JOIN pr n ON {on})"""


@query("geo_line_of_sight", SF + _CORN + """, ln AS (SELECT p_partkey AS line_id, CAST(p_partkey % 120 AS DOUBLE) AS x1, CAST(p_partkey * 13 % 90 AS DOUBLE) AS y1, CAST(p_partkey % 120 + p_partkey % 7 + 1 AS DOUBLE) AS x2, CAST(p_partkey * 13 % 90 + p_partkey % 5 AS DOUBLE) AS y2 FROM part), """
       + los_sql("line_id", 100.0, 1.5, 20.0) + " SELECT line_id, status, round(first_obstruction_m, 3) AS first_obstruction_m FROM v")
def geo_line_of_sight(t):
    k = F.col("p_partkey")
    lines = t.part.select(k.alias("line_id"), (k % 120).cast("double").alias("x1"), (k * 13 % 90).cast("double").alias("y1"),
                          (k % 120 + k % 7 + 1).cast("double").alias("x2"), (k * 13 % 90 + k % 5).cast("double").alias("y2"))
    los = R.line_of_sight(t.surface, lines, 100.0, 1.0, accuracy_m=1.5, observer_m=20.0)
    return los.select("line_id", "status", F.round("first_obstruction_m", 3).alias("first_obstruction_m"))


@query("terrain_viewshed", SF + _CORN + """, ln AS (SELECT s_suppkey AS obs_id, tt AS t, x1, y1, x1 + tt % 11 - 5 AS x2, y1 + tt // 11 - 5 AS y2 FROM (SELECT s_suppkey, CAST(s_suppkey * 7 % 128 AS DOUBLE) AS x1, CAST(s_suppkey * 11 % 117 AS DOUBLE) AS y1 FROM supplier), range(0, 121) r(tt)
 WHERE pow(tt % 11 - 5, 2) + pow(tt // 11 - 5, 2) BETWEEN 1 AND 25), """ + los_sql("obs_id, t", 100.0, 0.5, 10.0)
       + """, ok AS (SELECT DISTINCT obs_id FROM ln JOIN cn ON gx = x1 AND gy = y1)
SELECT obs_id, count(*) FILTER (o.obs_id IS NOT NULL AND status = 'visible') AS visible, count(*) FILTER (o.obs_id IS NOT NULL AND status = 'blocked') AS blocked, count(*) FILTER (o.obs_id IS NOT NULL AND status = 'indeterminate') AS indeterminate,
 count(*) FILTER (o.obs_id IS NOT NULL AND status = 'outside') AS outside, CAST(any_value(o.obs_id) IS NULL AS BIGINT) AS refused, count(o.obs_id) AS targets FROM v LEFT JOIN ok o USING (obs_id) GROUP BY 1""")
def terrain_viewshed(t):
    k = F.col("s_suppkey")
    obs = t.supplier.select(k.alias("obs_id"), (k * 7 % 128).cast("double").alias("x"), (k * 11 % 117).cast("double").alias("y"))
    return R.tallies(R.viewshed(t.surface, obs, 5, 100.0, accuracy_m=0.5, observer_m=10.0))


@query("geo_buffer_cells", f"""WITH {_SQ}, g AS (SELECT unit_id, w AS x1, s AS y1, e - w AS ex, n - s AS ey, 6371008.8::DOUBLE*pi()/180*cos(radians((s + n)/2)) AS kx, 6371008.8::DOUBLE*pi()/180 AS ky FROM sq),
c AS (SELECT g.*, x AS cx, y AS cy, ((x + 0.5::DOUBLE)*0.001::DOUBLE - x1)*kx AS px, ((y + 0.5::DOUBLE)*0.001::DOUBLE - y1)*ky AS py, ex*kx AS dx, ey*ky AS dy FROM g,
 LATERAL (SELECT unnest(range(CAST(floor(x1/0.001::DOUBLE) AS BIGINT) - 4, CAST(floor(x1/0.001::DOUBLE) AS BIGINT) + 12)) AS x), LATERAL (SELECT unnest(range(CAST(floor(y1/0.001::DOUBLE) AS BIGINT) - 4, CAST(floor(y1/0.001::DOUBLE) AS BIGINT) + 12)) AS y)),
d AS (SELECT *, greatest(0, least(1, (px*dx + py*dy)/(dx*dx + dy*dy))) AS t FROM c)
SELECT unit_id, count(*) AS cells FROM d WHERE pow(px - t*dx, 2) + pow(py - t*dy, 2) <= 150.0::DOUBLE*150 GROUP BY 1""")
def geo_buffer_cells(t):
    lines = _squares(t).select("unit_id", F.array(F.col("ring")[0], F.col("ring")[2]).alias("ring"))
    return A.buffer_cells(lines, 150.0, 0.001, "unit_id").groupBy("unit_id").agg(F.count(F.lit(1)).alias("cells"))

"""Space-time pattern queries over ``events``."""

from pyspark.sql import functions as F

from terralog.fixtures import hav_sql, with_sql
from terralog.operators import patterns as P
from terralog.queries.registry import query

BASE, COMP = ("2024-01-01 00:00:00", "2024-01-15 00:00:00"), ("2024-01-15 00:00:00", "2024-01-29 00:00:00")
OBS = with_sql("observations")


@query("time_bin", "SELECT event_id, date_trunc('day', ts) AS d, date_trunc('week', ts) AS w, date_trunc('month', ts) AS m FROM events")
def time_bin(t):
    return t.events.select("event_id", *[P.time_bin(F.col("ts"), g).alias(a) for g, a in (("day", "d"), ("week", "w"), ("month", "m"))])


@query("coverage_bins", """SELECT count(DISTINCT date_trunc('day', ts)) FILTER (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-10') AS occupied, count(*) FILTER (NOT (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-10')) AS excluded,
 38 AS expected, count(DISTINCT date_trunc('day', ts)) FILTER (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-10')/38.0::DOUBLE AS ratio FROM events""")
def coverage_bins(t):
    return P.bin_coverage(t.events, "2024-01-03 00:00:00", "2024-02-10 00:00:00", "day")


@query("calendar_frames", """WITH f AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-02-25', INTERVAL 7 DAY)) AS frame), n AS (SELECT date_trunc('week', ts + INTERVAL 8 HOUR) AS frame, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-25' GROUP BY 1)
SELECT f.frame, coalesce(n, 0) AS n, n IS NOT NULL AS occupied FROM f LEFT JOIN n ON n.frame = f.frame""")
def calendar_frames(t):
    return P.calendar_frames(t.events, "2024-01-10 00:00:00", "2024-02-25 00:00:00", "week", "Asia/Shanghai")


_CH = "value FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15')"


@query("pattern_change", """WITH o AS (SELECT user_id*13 + hour(ts) AS unit_id, ts, value FROM events), a AS (SELECT unit_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS c,
 avg(value) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-27') AS p FROM o WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT unit_id, round(b, 6) AS base_mean, round(c, 6) AS comp_mean, round(c - b, 6) AS delta, round(CASE WHEN b IS NOT NULL THEN c - p END, 6) AS drift, CASE WHEN c - b IS NULL THEN 'unknown' ELSE 'succeeded' END AS status, CASE WHEN c - b IS NULL THEN 'missing-window' END AS reason FROM a""")
def pattern_change(t):
    o = t.events.select((F.col("user_id") * 13 + F.hour("ts")).alias("unit_id"), "ts", "value")
    d = P.change(o, "unit_id", BASE, COMP)
    return d.select("unit_id", *[F.round(c, 6).alias(c) for c in ("base_mean", "comp_mean", "delta", "drift")], "status", "reason")


@query("pattern_change_blocks", OBS + """ SELECT CAST(floor(lon/(20000/(6371008.8::DOUBLE*pi()/180))) AS BIGINT) AS bx, CAST(floor(lat/(20000/(6371008.8::DOUBLE*pi()/180))) AS BIGINT) AS by,
 round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') - avg(value) FILTER (ts < TIMESTAMP '2024-01-15'), 6) AS delta, count(*) AS n FROM observations WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29' GROUP BY ALL""")
def pattern_change_blocks(t):
    return P.change_blocks(t.observations, BASE, COMP, 20000.0).withColumn("delta", F.round("delta", 6))


_MV = OBS + """, c AS (SELECT entity_id, ts, obs_id, CAST(floor(lon/0.1::DOUBLE) AS BIGINT) || ':' || CAST(floor(lat/0.1::DOUBLE) AS BIGINT) AS cell, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS bin FROM observations),
l AS (SELECT *, lag(cell) OVER w AS pc, lag(bin) OVER w AS pb FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY ts, obs_id)), mv AS (SELECT pc AS from_cell, cell AS to_cell, bin, bin - pb > 1 AS broken FROM l WHERE pc IS NOT NULL)"""


def _moves(t):
    return P.moves(t.observations, "entity_id", ["ts", "obs_id"], 0.1, "day", 1)


@query("pattern_flow", _MV + " SELECT from_cell, to_cell, count(*) AS n FROM mv WHERE NOT broken AND from_cell <> to_cell GROUP BY ALL")
def pattern_flow(t):
    return P.flow(_moves(t))


_TOPK = """, f1 AS (SELECT from_cell || '>' || to_cell AS key FROM mv WHERE NOT broken AND from_cell <> to_cell GROUP BY from_cell, to_cell ORDER BY count(*) DESC, from_cell, to_cell LIMIT 50),
f2 AS (SELECT from_cell || '>' || to_cell AS key FROM mv WHERE NOT broken AND from_cell <> to_cell AND bin <= (SELECT max(bin) FROM mv) - 7 GROUP BY from_cell, to_cell ORDER BY count(*) DESC, from_cell, to_cell LIMIT 50),
j AS (SELECT (SELECT count(*) FROM (SELECT key FROM f1 INTERSECT SELECT key FROM f2)) AS i, (SELECT count(*) FROM (SELECT key FROM f1 UNION SELECT key FROM f2)) AS u)"""


@query("pattern_flow_stability", _MV + _TOPK + """ SELECT count(*) FILTER (broken) AS broken, count(*) FILTER (NOT broken AND from_cell <> to_cell) AS moves, count(*) FILTER (NOT broken AND from_cell = to_cell) AS stays, (SELECT i/u::DOUBLE FROM j) AS jaccard FROM mv""")
def pattern_flow_stability(t):
    return P.flow_stability(_moves(t), 50, 7)


@query("jaccard_topk", """WITH a AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 100), b AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 100)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b))/(SELECT count(*) FROM (FROM a UNION FROM b))::DOUBLE AS jaccard, (SELECT count(*) FROM (FROM a UNION FROM b)) AS union_size""")
def jaccard_topk(t):
    g = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"))
    return P.jaccard(g.orderBy(F.desc("q"), "l_partkey").limit(100), g.orderBy(F.desc("c"), "l_partkey").limit(100), "l_partkey")


EPS, MIN_PTS = 1200.0, 3
_DB = OBS.replace("WITH ", "WITH RECURSIVE ") + f""", o AS (SELECT obs_id, lon, lat, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS bin FROM observations),
nb AS (SELECT a.obs_id AS i, b.obs_id AS j FROM o a JOIN o b ON b.bin BETWEEN a.bin - 1 AND a.bin + 1 AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.03 AND {hav_sql('a', 'b')} <= {EPS}),
core AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= {MIN_PTS}), ce AS (SELECT nb.i, nb.j FROM nb SEMI JOIN core c1 ON c1.i = nb.i SEMI JOIN core c2 ON c2.i = nb.j),
reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, ce.j FROM reach JOIN ce ON ce.i = reach.j), lab AS (SELECT i, min(j) AS label FROM reach GROUP BY i)"""


def _binned(t):
    return t.observations.select("obs_id", "lon", "lat", F.unix_date(F.to_date("ts")).cast("long").alias("bin"))


@query("pattern_cluster", _DB + """, bl AS (SELECT nb.i, min(label) AS label FROM nb JOIN lab ON lab.i = nb.j GROUP BY nb.i)
SELECT obs_id, CASE WHEN lab.i IS NOT NULL THEN 'core' WHEN bl.i IS NOT NULL THEN 'border' ELSE 'noise' END AS role, coalesce(lab.label, bl.label) AS label FROM o LEFT JOIN lab ON lab.i = obs_id LEFT JOIN bl ON bl.i = obs_id""")
def pattern_cluster(t):
    return P.cluster(_binned(t), EPS, 1, MIN_PTS)


@query("pattern_cluster_reach", OBS + f""", o AS (SELECT obs_id, lon, lat, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS bin FROM observations), e AS (SELECT max(bin) - 5 AS edge FROM o), fit AS (SELECT o.* FROM o, e WHERE bin <= edge),
core AS (SELECT a.obs_id, a.lon, a.lat, a.bin FROM fit a JOIN fit b ON b.bin BETWEEN a.bin - 1 AND a.bin + 1 AND abs(a.lat - b.lat) < 0.02 AND {hav_sql('a', 'b')} <= {EPS} GROUP BY ALL HAVING count(*) >= {MIN_PTS}),
late AS (SELECT o.* FROM o, e WHERE bin > edge), hit AS (SELECT DISTINCT l.obs_id FROM late l JOIN core c ON l.bin BETWEEN c.bin - 1 AND c.bin + 1 AND {hav_sql('l', 'c')} <= {EPS})
SELECT (SELECT count(*) FROM late) AS later, (SELECT count(*) FROM hit) AS reached, (SELECT count(*) FROM hit)/(SELECT count(*) FROM late)::DOUBLE AS share""")
def pattern_cluster_reach(t):
    return P.cluster_reach(_binned(t), EPS, 1, MIN_PTS, 5)


@query("recurrence", """SELECT o_orderkey, CASE WHEN at_ >= tgt THEN tgt + (at_ - tgt) // step * step END AS occurrence, CASE WHEN at_ >= tgt THEN tgt + ((at_ - tgt) // step + 1) * step ELSE tgt END AS next FROM
 (SELECT o_orderkey, (300 + o_orderkey % 86100)*1000 AS step, o_custkey*1000 + (300 + o_orderkey % 86100)*1000 AS tgt, o_custkey*1000 + (o_orderkey*7919) % 86399999 AS at_ FROM orders)""")
def recurrence(t):
    k = F.col("o_orderkey")
    occ, nxt = P.recurrence(F.col("o_custkey") * 1000, 300 + k % 86100, F.col("o_custkey") * 1000 + (k * 7919) % 86399999)
    return t.orders.select(k, occ.alias("occurrence"), nxt.alias("next"))

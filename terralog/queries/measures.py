"""Profiles, classification, grids and record roll-ups."""

from pyspark.sql import functions as F

from terralog.fixtures import hav_sql, with_sql
from terralog.operators import rollups as A
from terralog.operators import viz as V
from terralog.plans.running import int_block
from terralog.queries.registry import query

_ZONAL = """count(value) AS count, count(*) - count(value) AS missing, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
 round(stddev_pop(value), 6) AS sd, round(sum(value*denominator)/sum(CASE WHEN value IS NOT NULL THEN denominator END), 6) AS weighted_mean,
 round(sum(CASE WHEN denominator > 0 THEN value END)/sum(CASE WHEN value IS NOT NULL THEN denominator END), 6) AS sum_rate,
 count(*) FILTER (value IS NOT NULL AND denominator IS NULL) AS excluded"""


@query("stats_zonal", with_sql("units") + f" SELECT zone, {_ZONAL} FROM units GROUP BY zone")
def stats_zonal(t):
    z = A.zonal(t.units, "zone", "value", "denominator")
    return z.select("zone", "count", "missing", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), "min", "max",
                    F.round("sd", 6).alias("sd"), F.round("weighted_mean", 6).alias("weighted_mean"), F.round("sum_rate", 6).alias("sum_rate"), "excluded")


@query("stats_zonal_excluded", with_sql("units") + " SELECT unit_id, zone FROM units WHERE value IS NOT NULL AND denominator IS NULL")
def stats_zonal_excluded(t):
    return A.zonal_excluded(t.units, "unit_id", "zone", "value", "denominator")


def _props():
    return F.to_json(F.struct(
    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    F.when(F.col("event_id") % 5 == 0, F.lit("2024-02-30T00:00:00Z")).when(F.col("event_id") % 5 == 1, F.lit("2024-01-05T00:00:00"))
     .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"),
    F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.lit("  ")).alias("blank"), F.lit(4).alias("same")))


@query("field_profile", """WITH f AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, ts, event_type FROM events)
SELECT 'value' AS field, count(value) AS present, count(value) AS numeric, count(*) FILTER (value > 0) AS positive, count(*) FILTER (value >= 0) AS nonnegative, 0 AS timestamps, 0 AS identities,
 least(2, count(DISTINCT value)) AS distinct, least(2, count(DISTINCT value)) AS numeric_distinct, 0 AS in_window FROM f
UNION ALL SELECT 'time', count(*), 0, 0, 0, count(*) FILTER (event_id % 5 > 1), count(*), 2, 0, count(*) FILTER (event_id % 5 > 1 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) < TIMESTAMP '2024-01-20') FROM f
UNION ALL SELECT 'kind', count(*), 0, 0, 0, 0, count(*), least(2, count(DISTINCT event_type)), 0, 0 FROM f
UNION ALL SELECT 'blank', count(*) FILTER (event_id % 2 = 0), 0, 0, 0, 0, 0, 1, 0, 0 FROM f
UNION ALL SELECT 'same', count(*), count(*), count(*), count(*), 0, 0, 1, 1, 0 FROM f
UNION ALL SELECT 'missing', 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM f WHERE event_id = 0""")
def field_profile(t):
    return V.field_profile(t.events.select(_props().alias("props")), "props", ["value", "time", "kind", "blank", "same", "missing", "value"],
                           ("2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z"))


@query("ratio_profile", with_sql("units") + """ SELECT count(value/denominator) AS valid, least(2, count(DISTINCT value/denominator)) AS distinct FROM units WHERE denominator > 0""")
def ratio_profile(t):
    return V.ratio_profile(t.units, "value", "denominator")


@query("geometry_families", """SELECT array_to_string(list_sort(list(DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'point' WHEN 'STANDARD' THEN 'polygon' WHEN 'PROMO' THEN 'line' ELSE 'unknown' END)), ',') AS families FROM part""")
def geometry_families(t):
    g = F.when(F.col("p_type") == "ECONOMY", "Point").when(F.col("p_type") == "STANDARD", "MultiPolygon").when(F.col("p_type") == "PROMO", "LineString")
    return t.part.agg(F.array_join(F.sort_array(F.collect_set(V.geometry_family(g))), ",").alias("families"))


def breaks_sql(source: str, col: str, k: int, name: str = "breaks") -> str:
    """CTEs giving the quantile breaks of ``col`` over ``source``."""
    return f"""{name}_d AS (SELECT v, row_number() OVER (ORDER BY v) AS r, lead(v) OVER (ORDER BY v) AS nxt, count(*) OVER () AS n
 FROM (SELECT DISTINCT {col} AS v FROM {source} WHERE {col} IS NOT NULL)),
{name} AS (SELECT DISTINCT (v + nxt)/2 AS brk FROM {name}_d, range(1, {k}) i(i) WHERE r = CAST(ceil(i*n/{k}::DOUBLE) AS BIGINT) AND nxt IS NOT NULL)"""


@query("quantile_breaks", f"WITH {breaks_sql('lineitem', 'l_extendedprice', 7)} SELECT round(brk, 6) AS brk FROM breaks")
def quantile_breaks(t):
    return V.quantile_breaks(t.lineitem, "l_extendedprice", 7).select(F.round("brk", 6).alias("brk"))


@query("equal_interval_breaks", """SELECT round(lo + (hi - lo)*i/5, 6) AS brk FROM (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), range(1, 5) r(i)""")
def equal_interval_breaks(t):
    return V.equal_interval_breaks(t.lineitem, "l_extendedprice", 5).select(F.round("brk", 6).alias("brk"))


_CLASS = """CASE WHEN v IS NULL THEN 'missing' WHEN v < -500 THEN 'underflow' WHEN v > 9000 THEN 'overflow'
 ELSE CAST((v >= 1000)::INT + (v >= 3000)::INT + (v >= 6000)::INT AS VARCHAR) END"""


def _style():
    return V.literal_style((1000, 3000, 6000), -500, 9000)



@query("classify_value", with_sql("units") + f" SELECT unit_id, {_CLASS} AS class FROM (SELECT unit_id, value AS v FROM units)")
def classify_value(t):
    return t.units.select("unit_id", V.classify(F.col("value"), _style()).alias("class"))


@query("class_counts", with_sql("units") + f" SELECT {_CLASS} AS class, count(*) AS n FROM (SELECT value AS v FROM units) GROUP BY 1")
def class_counts(t):
    return V.class_counts(t.units, F.col("value"), _style())


@query("measure_value", with_sql("units") + " SELECT unit_id, round(value/denominator, 6) AS rate, value AS total FROM units")
def measure_value(t):
    return t.units.select("unit_id", F.round(V.measure("rate", F.col("value"), F.col("denominator")), 6).alias("rate"), V.measure("total", F.col("value")).alias("total"))


_HIST = f"""WITH {breaks_sql('lineitem', 'l_extendedprice', 5)}, e AS (SELECT brk AS x FROM breaks UNION ALL SELECT min(l_extendedprice) FROM lineitem UNION ALL SELECT max(l_extendedprice) FROM lineitem),
b AS (SELECT row_number() OVER (ORDER BY x) - 1 AS c, x AS lo, lead(x) OVER (ORDER BY x) AS hi, count(*) OVER () AS m FROM e),
bins AS (SELECT c, lo, hi, c = m - 2 AS top FROM b WHERE hi IS NOT NULL)"""


@query("histogram", _HIST + """ SELECT CAST(c AS VARCHAR) AS class, round(lo, 6) AS "from", round(hi, 6) AS "to", count(l_orderkey) AS n
FROM bins LEFT JOIN lineitem ON l_extendedprice >= lo AND (l_extendedprice < hi OR (top AND l_extendedprice <= hi)) GROUP BY ALL""")
def histogram(t):
    li = t.lineitem.select("l_extendedprice")
    style = V.style_of(li, "l_extendedprice", V.quantile_breaks(li, "l_extendedprice", 5))
    return V.histogram(li, F.col("l_extendedprice"), style, li.agg(F.count(F.lit(1)).alias("c"))).select(
        "class", F.round("from", 6).alias("from"), F.round("to", 6).alias("to"), "n")


@query("legend", _HIST + """ SELECT CAST(c AS INT) AS class, round(lo, 6) AS "from", round(hi, 6) AS "to", top AS to_inclusive, 'class' AS kind FROM bins""")
def legend(t):
    li = t.lineitem.select("l_extendedprice")
    style = V.style_of(li, "l_extendedprice", V.quantile_breaks(li, "l_extendedprice", 5))
    return V.legend(style, li.agg(F.count(F.lit(1)).alias("c"))).select(
        "class", F.round("from", 6).alias("from"), F.round("to", 6).alias("to"), "to_inclusive", "kind")


@query("style_version", """SELECT p_brand, 'sty-' || substring(sha256('{"classes":5,"field":"' || p_brand || '","max":' || max(p_size) || ',"measure":"total"}'), 1, 12) || '@v1' AS version FROM part GROUP BY p_brand""")
def style_version(t):
    return t.part.groupBy("p_brand").agg(F.max("p_size").alias("m")).select("p_brand", V.style_version(
        {"measure": F.lit("total"), "field": F.col("p_brand"), "classes": F.lit(5), "max": F.col("m")}).alias("version"))


@query("unify_domains", f"""WITH u AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'a' ELSE 'b' END AS layer, o_totalprice AS v FROM orders ),
{breaks_sql('u', 'v', 6)} SELECT layer, CAST((SELECT count(*) FROM breaks WHERE brk <= v) AS VARCHAR) AS class, count(*) AS n FROM u GROUP BY ALL""")
def unify_domains(t):
    o = t.orders.select((F.col("o_orderstatus") == "O").alias("first"), F.col("o_totalprice").alias("v"))
    return V.unify(o.where("first"), o.where("NOT first"), "v", 6)


@query("selection_filter", """SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value >= 5 AND value < 60""")
def selection_filter(t):
    return V.selection(t.events, "value", "ts", ("2024-01-05 00:00:00", "2024-01-20 00:00:00"), (5.0, 60.0), 1e9).select("event_id", "value")


@query("attribute_rows", """SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 200 AS truncated FROM orders ORDER BY o_orderkey LIMIT 200""")
def attribute_rows(t):
    return V.bounded_rows(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.col("o_orderkey")], 200)


@query("topk_bounded", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 256 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 256""")
def topk_bounded(t):
    return V.bounded_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 256)


@query("viz_aggregate", with_sql("observations") + """ SELECT CAST(floor(lon/0.05::DOUBLE) AS BIGINT) AS cx, CAST(floor(lat/0.05::DOUBLE) AS BIGINT) AS cy, count(*) AS n, count(value) AS valued,
 round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM observations GROUP BY ALL""")
def viz_aggregate(t):
    g = V.grid_aggregate(t.observations, 0.05, "value")
    return g.select("cx", "cy", "n", "valued", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), "min", "max")


@query("viz_density", with_sql("units") + f""", c AS (SELECT a.cx, b.cy, (a.cx + 0.5)*0.02::DOUBLE AS lon, (b.cy + 0.5)*0.02::DOUBLE AS lat FROM range(5790, 5860) a(cx), range(1970, 2035) b(cy)),
d AS (SELECT c.cx, c.cy, {hav_sql('units', 'c')} AS d FROM units, c)
SELECT cx, cy, round(sum(3/(pi()*3000.0::DOUBLE*3000)*pow(1 - pow(d/3000, 2), 2))*1e9, 3) AS density FROM d WHERE d < 3000 GROUP BY ALL""")
def viz_density(t):
    return V.kernel_density(t.units, 0.02, 3000.0).select("cx", "cy", F.round(F.col("density") * 1e9, 3).alias("density"))


@query("average_ranks", """SELECT l_extendedprice AS v, count(*) AS n, min(r) + (count(*) - 1)/2.0::DOUBLE AS rank FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY 1""")
def average_ranks(t):
    return A.average_ranks(t.lineitem.select(F.col("l_extendedprice").alias("v")), "v")


@query("p_adjust", """WITH p AS (SELECT (1 + o_orderkey % 1000)*(1 + o_custkey % 7)/7200.0::DOUBLE AS p FROM orders), c AS (SELECT p, count(*) AS n FROM p GROUP BY p),
r AS (SELECT p, sum(n) OVER (ORDER BY p) AS upto, sum(n) OVER () AS m FROM c)
SELECT round(p, 9) AS p, round(least(1.0::DOUBLE, min(p*m/upto) OVER (ORDER BY p DESC)), 9) AS p_adj FROM r""")
def p_adjust(t):
    p = t.orders.select(((1 + F.col("o_orderkey") % 1000) * (1 + F.col("o_custkey") % 7) / F.lit(7200.0)).alias("p"))
    return A.p_adjust(p, "p").select(F.round("p", 9).alias("p"), F.round("p_adj", 9).alias("p_adj"))


@query("segment_latency", """SELECT l_returnflag AS segment, l_linestatus AS outcome, count(*) AS count, round(sum(l_quantity), 4) AS total, max(l_quantity) AS max,
 quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY ALL""")
def segment_latency(t):
    s = t.lineitem.select(F.col("l_returnflag").alias("segment"), F.col("l_linestatus").alias("outcome"), F.col("l_quantity").alias("wall"))
    return A.segment_latency(s, ["segment", "outcome"], "wall").withColumn("total", F.round("total", 4))


@query("throughput_stats", """SELECT l_shipmode AS section, count(*) AS batches, round(median(rate), 6) AS median_rate, round(max(rate)/min(rate), 6) AS spread
FROM (SELECT l_linenumber AS l_shipmode, l_extendedprice/l_quantity AS rate FROM lineitem) GROUP BY 1""")
def throughput_stats(t):
    r = t.lineitem.select(F.col("l_linenumber").alias("section"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))
    out = A.throughput(r, "section", "rate")
    return out.select("section", "batches", F.round("median_rate", 6).alias("median_rate"), F.round("spread", 6).alias("spread"))


@query("operation_index", """SELECT event_type AS op, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (event_id % 3 = 0) AS n_info, count(*) FILTER (event_id % 3 = 1) AS n_warn, count(*) FILTER (event_id % 3 = 2) AS n_error FROM events GROUP BY 1""")
def operation_index(t):
    level = F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("error")), (F.col("event_id") % 3 + 1).cast("int"))
    return A.operation_index(t.events.select(F.col("event_type").alias("op"), "ts", level.alias("level")), "op", "ts", "level", ["info", "warn", "error"])


_HEALTH = "CASE WHEN value < 2 THEN 'unavailable' WHEN value < 6 THEN 'degraded' ELSE 'ready' END"


def _health(t):
    return t.events.select("event_id", "ts", F.col("event_type").alias("plane"), F.expr(_HEALTH).alias("status"))


@query("health_summary", f"""WITH l AS (SELECT event_type AS plane, arg_max({_HEALTH}, event_id) AS status FROM events GROUP BY 1)
SELECT plane, status, CASE status WHEN 'unavailable' THEN 0 WHEN 'degraded' THEN 1 END AS held_back, (SELECT bool_and(status = 'ready') FROM l) AS ready FROM l""")
def health_summary(t):
    return A.health(_health(t), "plane", ["ts", "event_id"], "status")


@query("gap_state", f"""WITH s AS (SELECT event_id, ts, event_type AS plane, {_HEALTH} AS status FROM events),
l AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY plane ORDER BY event_id), 'ready') AS from_status FROM s) SELECT * FROM l WHERE from_status <> status""")
def gap_state(t):
    return A.transitions(_health(t), "plane", ["event_id"], int_block("event_id"), "status")


@query("budget_spend", """WITH r AS (SELECT o_orderpriority AS plane, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS projected, 1e7::DOUBLE * (1 + length(o_orderpriority)) AS "limit" FROM orders)
SELECT plane, min(o_orderkey) AS first_over, round(arg_min(projected, o_orderkey), 2) AS projected, arg_min("limit", o_orderkey) AS "limit" FROM r WHERE projected > "limit" GROUP BY 1""")
def budget_spend(t):
    o = t.orders.select(F.col("o_orderpriority").alias("plane"), "o_orderkey", "o_totalprice")
    out = A.budget(o, "plane", "o_orderkey", int_block("o_orderkey"), "o_totalprice", 1e7 * (1 + F.length("plane")))
    return out.withColumn("projected", F.round("projected", 2))


@query("lineage_groups", """SELECT sha256(array_to_string(list_sort(list_distinct(['p' || (l_partkey % 20), 's' || (l_suppkey % 10)])), ',') || '|v' || (l_linenumber % 2)) AS lineage, count(*) AS evidence, min(l_orderkey) AS first_id FROM lineitem GROUP BY 1""")
def lineage_groups(t):
    p, s = F.concat(F.lit("p"), F.col("l_partkey") % 20), F.concat(F.lit("s"), F.col("l_suppkey") % 10)
    refs = F.when(F.col("l_orderkey") % 2 == 0, F.array(p, s)).otherwise(F.array(s, p))
    return A.lineage_groups(t.lineitem, refs, F.concat(F.lit("v"), F.col("l_linenumber") % 2), "l_orderkey")


@query("feedback_rollup", """WITH l AS (SELECT user_id, arg_max(event_type = 'error', event_id) AS gone, arg_max(CASE WHEN value > 20 THEN 'up' ELSE 'down' END, event_id) AS rating, arg_max(event_type, event_id) AS category FROM events GROUP BY 1)
SELECT rating, category, count(*) AS n FROM l WHERE NOT gone GROUP BY ALL""")
def feedback_rollup(t):
    return A.feedback_rollup(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error",
                             F.when(F.col("value") > 20, "up").otherwise("down"), F.col("event_type"))

"""Association, regression, effect, forecast and allocation queries."""

from pyspark.sql import functions as F

from terralog.fixtures import hav_sql, with_sql
from terralog.operators import access as A
from terralog.operators import decision as D
from terralog.plans.permute import permute_sql
from terralog.queries.registry import query

SEED, PERMS = 20260924, 199
_ROWS = """r AS (SELECT c_custkey AS unit_id, c_acctbal AS y, CAST(n AS DOUBLE) AS x1, s AS x2, c_nationkey::DOUBLE AS x3 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
f AS (SELECT * FROM r WHERE x1 IS NOT NULL)"""


def _rows(t):
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("x1"), F.sum("o_totalprice").alias("x2"))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("unit_id"), F.col("c_acctbal").alias("y"), "x1", "x2", F.col("c_nationkey").cast("double").alias("x3"))


def _assoc(x: str) -> str:
    return f"""SELECT '{x}' AS factor, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM f) AS used, round((SELECT corr(y, {x}) FROM f), 9) AS pearson, round((SELECT corr(ry, r{x}) FROM k), 9) AS spearman,
 (1 + (SELECT count(*) FROM (SELECT d.draw, corr(b.y, d.{x}) AS c FROM dr d JOIN dr b ON b.draw = 0 AND b.pos = d.pos WHERE d.draw > 0 GROUP BY 1) WHERE abs(c) >= abs((SELECT corr(y, {x}) FROM f)) - 1e-12))/200.0::DOUBLE AS p, 'succeeded' AS status"""


@query("attribution_association", f"WITH RECURSIVE {_ROWS}, k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0::DOUBLE AS r{c}" for c in ("y", "x1", "x2", "x3")) + f""" FROM f),
{permute_sql(SEED, PERMS, 'f', 'unit_id, y, x1, x2, x3', 'unit_id')} """ + " UNION ALL ".join(_assoc(x) for x in ("x1", "x2", "x3")))
def attribution_association(t):
    a = D.association(_rows(t), "unit_id", "y", ["x1", "x2", "x3"], PERMS, SEED)
    return a.withColumn("pearson", F.round("pearson", 9)).withColumn("spearman", F.round("spearman", 9))


_OLS = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, regr_sxx(l_quantity, l_quantity) AS s11, regr_sxx(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_discount)*count(*) AS s12,
 covar_pop(l_extendedprice, l_quantity)*count(*) AS s1y, covar_pop(l_extendedprice, l_discount)*count(*) AS s2y, var_pop(l_extendedprice)*count(*) AS syy FROM lineitem),
b AS (SELECT *, s11*s22 - s12*s12 AS det FROM s), c AS (SELECT *, (s22*s1y - s12*s2y)/det AS b1, (s11*s2y - s12*s1y)/det AS b2 FROM b),
e AS (SELECT *, my - b1*m1 - b2*m2 AS b0, syy - b1*s1y - b2*s2y AS rss FROM c)"""


@query("ols", _OLS + """ SELECT term, round(coefficient, 4) AS coefficient, round(std_error, 4) AS std_error, round(sqrt(rss/(n - 3)), 4) AS sigma, round(1 - rss/syy, 8) AS r2, n - 3 AS df, 'succeeded' AS status FROM (
 SELECT 'intercept' AS term, b0 AS coefficient, sqrt(rss/(n - 3)*(1.0/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)) AS std_error, * FROM e UNION ALL SELECT 'l_quantity', b1, sqrt(rss/(n - 3)*s22/det), * FROM e UNION ALL SELECT 'l_discount', b2, sqrt(rss/(n - 3)*s11/det), * FROM e)""")
def ols(t):
    r = D.ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"])
    return r.select("term", *[F.round(c, 4).alias(c) for c in ("coefficient", "std_error", "sigma")], F.round("r2", 8).alias("r2"), "df", "status")


@query("attribution_explain", _OLS + """ SELECT 'l_quantity' AS factor, round(b1*sqrt(s11/syy), 8) AS beta, round(s11*s22/det, 8) AS vif, false AS collinear, 'succeeded' AS status FROM c UNION ALL SELECT 'l_discount', round(b2*sqrt(s22/syy), 8), round(s11*s22/det, 8), false, 'succeeded' FROM c""")
def attribution_explain(t):
    return D.explain(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]).withColumn("beta", F.round("beta", 8)).withColumn("vif", F.round("vif", 8))


@query("attribution_effect", with_sql("units") + f""", nt AS (SELECT DISTINCT c.unit_id FROM units c JOIN units h ON h.zone = 3 AND c.zone <> 3 AND {hav_sql('c', 'h')} <= 2000),
e AS (SELECT o_totalprice AS y, zone = 3 AS t, o_orderdate >= TIMESTAMP '1997-01-01' AS p, c_acctbal AS x, nt.unit_id IS NOT NULL AS near FROM orders JOIN customer ON c_custkey = o_custkey JOIN units u ON u.unit_id = o_custkey LEFT JOIN nt ON nt.unit_id = o_custkey),
g AS (SELECT (avg(y) FILTER (t AND p) - avg(y) FILTER (t AND NOT p)) - (avg(y) FILTER (NOT t AND p) - avg(y) FILTER (NOT t AND NOT p)) AS effect,
 sqrt(var_samp(y) FILTER (t AND p)/count(*) FILTER (t AND p) + var_samp(y) FILTER (t AND NOT p)/count(*) FILTER (t AND NOT p) + var_samp(y) FILTER (NOT t AND p)/count(*) FILTER (NOT t AND p) + var_samp(y) FILTER (NOT t AND NOT p)/count(*) FILTER (NOT t AND NOT p)) AS se,
 abs((avg(x) FILTER (t) - avg(x) FILTER (NOT t))/sqrt((var_samp(x) FILTER (t) + var_samp(x) FILTER (NOT t))/2)) AS smd, count(*) FILTER (NOT t AND near)/count(*) FILTER (NOT t)::DOUBLE AS interference FROM e),
st AS (SELECT least(4, floor((x - lo)/((hi - lo)/5))) AS s, count(*) FILTER (t) AS a, count(*) FILTER (NOT t) AS b, count(*) AS c FROM e, (SELECT min(x) AS lo, max(x) AS hi FROM e) GROUP BY 1),
ov AS (SELECT sum(c) FILTER (a > 0 AND b > 0)/sum(c)::DOUBLE AS overlap FROM st)
SELECT round(effect, 4) AS effect, round(se, 4) AS std_error, round(effect - 1.959963984540054::DOUBLE*se, 4) AS lower, round(effect + 1.959963984540054::DOUBLE*se, 4) AS upper, round(smd, 8) AS worst_smd, round(overlap, 8) AS overlap, round(interference, 8) AS interference,
 CASE WHEN smd > 0.1 OR overlap < 0.8 OR interference > 0.1 THEN 'association' ELSE 'quasi-causal' END AS claim, CASE WHEN smd > 0.1 THEN 'covariates-unbalanced' WHEN overlap < 0.8 THEN 'insufficient-overlap' WHEN interference > 0.1 THEN 'interference' END AS downgrade FROM g, ov""")
def attribution_effect(t):
    units = t.units.select("unit_id", "lon", "lat", "zone")
    near = D.near_treated(units, "unit_id", F.col("zone") == 3, 2000.0).withColumn("_hit", F.lit(True))
    rows = (t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(near, F.col("unit_id") == F.col("o_custkey"), "left")
            .select(F.col("o_totalprice").alias("y"), (F.col("c_nationkey") == 3).alias("treated"), (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).alias("post"), F.col("c_acctbal").alias("x"), "_hit"))
    e = D.effect(rows, "y", "treated", "post", ["x"], interference=F.col("_hit"))
    return e.select(*[F.round(c, 4).alias(c) for c in ("effect", "std_error", "lower", "upper")], *[F.round(c, 8).alias(c) for c in ("worst_smd", "overlap", "interference")], "claim", "downgrade")


def _newton(rounds: int) -> str:
    """CTEs n0..n<rounds>(a, b): Newton steps of a logistic regression of t on z over ez."""
    steps = ["n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(rounds):
        steps.append(f"""n{k + 1} AS (SELECT a + (g0*h11 - g1*h01)/(h00*h11 - h01*h01) AS a, b + (g1*h00 - g0*h01)/(h00*h11 - h01*h01) AS b FROM (SELECT any_value(a) AS a, any_value(b) AS b,
 sum(CAST(t AS INT) - p) AS g0, sum((CAST(t AS INT) - p)*z) AS g1, sum(p*(1 - p)) AS h00, sum(p*(1 - p)*z) AS h01, sum(p*(1 - p)*z*z) AS h11 FROM (SELECT *, 1/(1 + exp(-a - b*z)) AS p FROM ez, n{k})))""")
    return ", ".join(steps)


@query("attribution_propensity", f"""WITH e AS (SELECT c_custkey AS unit_id, c_nationkey % 5 = 3 AS t, c_acctbal + 300*(c_nationkey % 5) AS x FROM customer), ez AS (SELECT *, (x - avg(x) OVER ())/stddev_pop(x) OVER () AS z FROM e),
{_newton(8)}, p AS (SELECT unit_id, t, 1/(1 + exp(-a - b*z)) AS p FROM ez, n8), s AS (SELECT greatest(min(p) FILTER (t), min(p) FILTER (NOT t)) AS lo, least(max(p) FILTER (t), max(p) FILTER (NOT t)) AS hi FROM p)
SELECT unit_id, round(p, 5) AS propensity, round((SELECT count(*) FILTER (p BETWEEN lo AND hi)/count(*)::DOUBLE FROM p, s), 6) AS overlap FROM p""")
def attribution_propensity(t):
    rows = t.customer.select(F.col("c_custkey").alias("unit_id"), (F.col("c_nationkey") % 5 == 3).alias("t"), (F.col("c_acctbal") + 300 * (F.col("c_nationkey") % 5)).alias("x"))
    return D.propensity(rows, "t", ["x"]).select("unit_id", F.round("propensity", 5).alias("propensity"), F.round(D._common_support(rows, "t", ["x"]), 6).alias("overlap"))


_SERIES = """s AS (SELECT c_nationkey AS k, CAST((year(o_orderdate) - 1990)*12 + month(o_orderdate) AS DOUBLE) AS x, sum(o_totalprice) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _series(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("k"), ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("double").alias("x")).agg(F.sum("o_totalprice").alias("y"))


@query("forecast_fit", f"WITH {_SERIES} SELECT k, 'linear' AS family, count(*) AS n, round(avg(y), 3) AS b0, round(regr_slope(y, x), 4) AS b1, round(sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2)/regr_sxx(y, x))/(count(*) - 2)), 2) AS sigma, min(x) AS x_min, max(x) AS x_max, 'succeeded' AS status FROM s GROUP BY k")
def forecast_fit(t):
    m = D.forecast_fit(_series(t), "k", "x", "y")
    return m.select("k", "family", "n", F.round("b0", 3).alias("b0"), F.round("b1", 4).alias("b1"), F.round("sigma", 2).alias("sigma"), "x_min", "x_max", "status")


@query("forecast_predict", f"""WITH {_SERIES}, m AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(x) AS lo, max(x) AS hi, sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2)/regr_sxx(y, x))/(count(*) - 2)) AS sg FROM s WHERE x <= 130 GROUP BY k)
SELECT k, x, round(a + b*x, 2) AS predicted, round(a + b*x - 1.959963984540054::DOUBLE*sg, 2) AS lower, NOT (x BETWEEN lo AND hi) AS out_of_domain, abs(y - a - b*x) > 3*sg AS drift FROM s JOIN m USING (k)""")
def forecast_predict(t):
    s = _series(t)
    p = D.forecast_predict(D.forecast_fit(s.where("x <= 130"), "k", "x", "y"), s.withColumnRenamed("y", "observed"), "k", "x")
    return p.select("k", "x", F.round("predicted", 2).alias("predicted"), F.round("lower", 2).alias("lower"), "out_of_domain", "drift")


@query("forecast_validate", f"""WITH {_SERIES}, e AS (SELECT k, max(x) - 12 AS edge FROM s GROUP BY k), f AS (SELECT s.* FROM s JOIN e USING (k) WHERE x <= edge), l AS (SELECT s.* FROM s JOIN e USING (k) WHERE x > edge),
m AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, x) AS last, avg(y) AS mean, sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2)/regr_sxx(y, x))/(count(*) - 2)) AS sg FROM f GROUP BY k),
p AS (SELECT 'linear' AS model, y, a + b*x AS p, sg FROM l JOIN m USING (k) UNION ALL SELECT 'last-value', y, last, NULL FROM l JOIN m USING (k) UNION ALL SELECT 'mean', y, mean, NULL FROM l JOIN m USING (k))
SELECT model, count(p) AS n, round(avg(abs(y - p)), 2) AS mae, round(sqrt(avg((y - p)*(y - p))), 2) AS rmse, round(avg(CASE WHEN sg IS NOT NULL THEN CAST(abs(y - p) <= 1.959963984540054::DOUBLE*sg AS INT) END), 8) AS interval_coverage, round(avg(y - p), 2) AS bias FROM p GROUP BY 1""")
def forecast_validate(t):
    v = D.forecast_validate(_series(t), "k", "x", "y", 12)
    return v.select("model", "n", *[F.round(c, 2).alias(c) for c in ("mae", "rmse", "bias")], F.round("interval_coverage", 8).alias("interval_coverage"))


@query("forecast_block_validate", f"""WITH {_SERIES}, f AS (SELECT *, CAST('0x' || substring(md5(CAST(k AS VARCHAR)), 1, 15) AS BIGINT) % 5 AS fold FROM s),
l AS (SELECT g.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN (SELECT DISTINCT fold FROM f) g ON g.fold <> f.fold GROUP BY 1) SELECT fold, count(*) AS n, round(avg(abs(y - a - b*x)), 2) AS mae FROM f JOIN l USING (fold) GROUP BY 1""")
def forecast_block_validate(t):
    return D.block_validate(_series(t), "k", "k", "x", "y", 5).withColumn("mae", F.round("mae", 2))


_CAND = with_sql("population", "facilities") + f""", cv AS (SELECT fac_id, sum(population) AS pop, count(DISTINCT community) AS comm FROM facilities f JOIN population p ON {hav_sql('p', 'f')} <= 8000 GROUP BY 1),
cd AS (SELECT f.fac_id, coalesce(pop, 0)/(SELECT sum(population) FROM population)::DOUBLE AS coverage, coalesce(comm, 0)/25.0::DOUBLE AS equity, cost/25.0::DOUBLE AS cost, cost AS price FROM facilities f LEFT JOIN cv USING (fac_id))"""


def _cands(t):
    near = A.demand_within(t.facilities, t.population, 8000.0, by=("community",))
    cv = near.groupBy("fac_id").agg(F.sum("population").alias("pop"), F.count("community").alias("comm"))
    whole = t.population.agg(F.sum("population").alias("s")).scalar()
    return t.facilities.join(cv, "fac_id", "left").select(
        "fac_id", (F.coalesce("pop", F.lit(0)) / whole).alias("coverage"), (F.coalesce("comm", F.lit(0)) / F.lit(25.0)).alias("equity"),
        (F.col("cost") / F.lit(25.0)).alias("cost"), F.col("cost").alias("price"))


@query("scenario_compare", _CAND + """, sc AS (SELECT fac_id, m AS multiplier, round(coverage*m + equity*0.5::DOUBLE - cost*0.1::DOUBLE, 12) AS score, price FROM cd, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(m))
SELECT fac_id, multiplier, round(score, 9) AS score, CASE WHEN price <= 15 THEN rank() OVER (PARTITION BY multiplier, price <= 15 ORDER BY score DESC) END AS rank, CASE WHEN price > 15 THEN 'over-budget' END AS reason FROM sc""")
def scenario_compare(t):
    return D.scenario_compare(_cands(t), "fac_id", {"coverage": 1.0, "equity": 0.5, "cost": 0.1}, 15).withColumn("score", F.round("score", 9))


@query("rank_candidates", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN rank() OVER (PARTITION BY c_acctbal >= 0 ORDER BY c_acctbal DESC) END AS rank, CASE WHEN c_acctbal < 0 THEN 'negative-balance' END AS reason FROM customer""")
def rank_candidates(t):
    return D.rank_candidates(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", F.col("c_acctbal") >= 0, F.lit("negative-balance")).select("c_custkey", "rank", "reason")


def _allocate(t):
    return D.allocate_within(t.facilities, t.population, 8000.0, 5, 60.0)


def _allocation_sql(k: int, budget: float) -> str:
    """The greedy choice as ``k`` chained steps p1..pk of one row at most, over the pairs within reach."""
    steps, chosen = [], "SELECT NULL AS fac_id, 0 AS cost WHERE false"
    for r in range(1, k + 1):
        steps.append(f"""p{r} AS MATERIALIZED (SELECT fac_id, cost, sum(population) AS gain FROM rc WHERE cost <= {budget} - (SELECT coalesce(sum(cost), 0) FROM ({chosen}))
 AND unit_id NOT IN (SELECT unit_id FROM rc WHERE fac_id IN (SELECT fac_id FROM ({chosen}))) GROUP BY ALL ORDER BY gain DESC, fac_id LIMIT 1)""")
        chosen += f" UNION ALL SELECT fac_id, cost FROM p{r}"
    reach = f"rc AS MATERIALIZED (SELECT fac_id, unit_id, population, cost FROM facilities f JOIN population p ON {hav_sql('p', 'f')} <= 8000)"
    return with_sql("population", "facilities") + ", " + ", ".join([reach, *steps]) + ", ch AS (" + " UNION ALL ".join(f"SELECT {r} AS rank, * FROM p{r}" for r in range(1, k + 1)) + ")"


_ALLOC = _allocation_sql(5, 60.0)


@query("location_allocate", _ALLOC + " SELECT CAST(rank AS INT) AS rank, fac_id, CAST(cost AS DOUBLE) AS cost, CAST(gain AS BIGINT) AS gain FROM ch")
def location_allocate(t):
    return _allocate(t)[0]


@query("location_assignments", _ALLOC + " SELECT unit_id, arg_min(fac_id, rank) AS fac_id FROM rc JOIN ch USING (fac_id) GROUP BY 1")
def location_assignments(t):
    return _allocate(t)[1]


@query("location_exact", with_sql("population", "facilities") + f""", rc AS MATERIALIZED (SELECT fac_id, unit_id, population, cost FROM facilities f JOIN population p ON {hav_sql('p', 'f')} <= 8000),
one AS (SELECT fac_id, cost, sum(population) AS cov FROM rc GROUP BY ALL), ov AS (SELECT a.fac_id AS f, b.fac_id AS g, sum(a.population) AS both_cov FROM rc a JOIN rc b ON a.unit_id = b.unit_id AND a.fac_id < b.fac_id GROUP BY ALL),
cd AS (SELECT [fac_id] AS ids, cost, cov FROM one WHERE cost <= 24 UNION ALL SELECT [a.fac_id, b.fac_id], a.cost + b.cost, a.cov + b.cov - coalesce(both_cov, 0) FROM one a JOIN one b ON a.fac_id < b.fac_id AND a.cost + b.cost <= 24 LEFT JOIN ov ON f = a.fac_id AND g = b.fac_id),
be AS (SELECT * FROM cd ORDER BY cov DESC, cost, len(ids), ids LIMIT 1), m AS (SELECT unnest(ids) AS fac_id, cov, cost AS total FROM be)
SELECT m.fac_id, CAST(f.cost AS DOUBLE) AS cost, CAST(cov AS BIGINT) AS covered, CAST(total AS DOUBLE) AS total_cost FROM m JOIN facilities f USING (fac_id)""")
def location_exact(t):
    return D.allocate_exact_within(t.facilities, t.population, 8000.0, 2, 24, most=2_000_000)

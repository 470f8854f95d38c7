"""Exact answers known in advance."""

import math

import pytest
from pyspark.sql import functions as F

from terralog.functions import geo
from terralog.functions import text as X
from terralog.operators import access, decision, geometry, records, terrain, viz
from terralog.operators.rollups import average_ranks, p_adjust


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_gcj02_reference_point_and_pass_through(spark):
    pts = spark.createDataFrame([(116.404, 39.915), (0.0, 0.0), (-73.9857, 40.7484), (139.6917, 35.6895)], "lon double, lat double")
    x, y = geo.wgs84_to_gcj02(F.col("lon"), F.col("lat"))
    rows = pts.select("lon", "lat", x.alias("x"), y.alias("y")).collect()
    assert rows[0].x == pytest.approx(116.41024449916938, abs=1e-10)
    assert rows[0].y == pytest.approx(39.91640428150164, abs=1e-10)
    assert all((r.x, r.y) == (r.lon, r.lat) for r in rows[1:])
    bx, by = geo.gcj02_to_wgs84(F.lit(rows[0].x), F.lit(rows[0].y))
    back = one(spark, x=bx, y=by)
    assert back.x == pytest.approx(116.404, abs=2e-5) and back.y == pytest.approx(39.915, abs=2e-5)


@pytest.mark.parametrize("df,want", [(1, 12.706204736432095), (5, 2.5705818366147395), (10, 2.2281388519649385), (30, 2.0422724563012378), (100, 1.9839715184496334)])
def test_t_quantile(df, want):
    assert decision.t_quantile(0.975, df) == pytest.approx(want, abs=1e-9)


def test_ols_vector(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 9.0), (3.0, 11.0), (4.0, 13.0)], "x double, y double")
    got = {r.term: r for r in decision.ols(rows, "y", ["x"]).collect()}
    assert got["x"].coefficient == pytest.approx(2.6)
    assert got["x"].sigma == pytest.approx(math.sqrt(0.6))
    assert got["x"].std_error == pytest.approx(math.sqrt(0.6 / 5))
    flat = rows.withColumn("x2", F.col("x") * 2)
    assert {r.status for r in decision.ols(flat, "y", ["x", "x2"]).collect()} == {"refused"}


def test_average_ranks_and_adjustment(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    assert {r.v: r["rank"] for r in average_ranks(v, "v").collect()} == {1.0: 1.0, 2.0: 2.5, 4.0: 4.0}
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    adj = {r.p: r.p_adj for r in p_adjust(p, "p").collect()}
    assert adj[0.01] == pytest.approx(0.04) and adj[0.03] == pytest.approx(4 * 0.04 / 3) and adj[0.04] == pytest.approx(4 * 0.04 / 3)


def test_tertiles_and_classes(spark):
    v = spark.createDataFrame([(50.0,), (100.0,), (200.0,)], "v double")
    assert sorted(r.brk for r in viz.quantile_breaks(v, "v", 3).collect()) == [75.0, 150.0]
    same = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert viz.quantile_breaks(same, "v", 4).count() == 0 and viz.equal_interval_breaks(same, "v", 4).count() == 0
    style = viz.literal_style((75, 150), 50, 200)
    c = one(spark, **{f"c{i}": viz.classify(F.lit(x), style) for i, x in enumerate((49.0, 50.0, 75.0, 200.0, 201.0, math.nan))})
    assert list(c) == ["underflow", "0", "1", "2", "overflow", "missing"]


def test_field_profile_counts(spark):
    rows = [('{"value":2,"population":10,"time":"2026-01-01T00:00:00Z"}',), ('{"value":"3","population":0,"time":"bad"}',),
            ('{"value":null,"population":-2}',), ('{"constructor":4,"__proto__":2}',)]
    got = {r.field: r for r in viz.field_profile(spark.createDataFrame(rows, "p string"), "p", ["value", "population", "time", "missing", "constructor"]).collect()}
    v = got["value"]
    assert (v.present, v.numeric, v.positive, v.nonnegative, v.identities, v.distinct, v.numeric_distinct) == (2, 1, 1, 1, 1, 2, 1)
    assert got["population"].positive == 1 and got["time"].timestamps == 1 and got["missing"].present == 0 and got["constructor"].numeric == 1


def test_semantic_keywords_match_whole_words(spark):
    r = one(spark, a=records.infer_semantic(F.lit("business")), b=records.infer_semantic(F.lit("bus stop")), c=records.infer_semantic(F.lit("Rivers")),
            d=records.infer_semantic(F.lit("三甲医院")), e=records.infer_semantic(F.lit("city boundary")))
    assert list(r) == [None, "transit", "water", "facility", "boundary"]


def test_sanitize_json_nested(spark):
    raw = '{"a":{"Api-Key":"x","deep":{"p":"/home/u/file.txt"}},"geometry":{"type":"Point"},"list":[' + ",".join("1" * 1 for _ in range(40)) + "]}"
    r = records.sanitize_json(spark.createDataFrame([(raw,)], "j string"), "j").first()
    assert '"[redacted:Api-Key]"' in r.j and '"<path>"' in r.j and '"obsRedacted"' in r.j and r.j.count("1") == 32
    assert len(r.redactions) == 4


def test_ring_validity(spark):
    def ring(pts):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    r = one(spark, ok=geometry.ring_valid(ring(square)), bow=geometry.ring_valid(ring([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)])),
            open=geometry.ring_valid(ring(square[:-1] + [(5, 5)])), short=geometry.ring_valid(ring(square[:2] + [(0, 0)])))
    assert list(r) == [True, False, False, False]


def test_facility_coverage_vector(spark):
    pop = spark.createDataFrame([(1, 100), (2, 50), (3, 200)], "unit_id long, population long")
    costs = spark.createDataFrame([(1, 10, 4.0), (2, 10, 9.0), (3, 20, 5.0), (1, 20, 30.0)], "unit_id long, fac_id long, minutes double")
    west = access.coverage(pop, costs.where("fac_id = 10"), 10.0).first()
    east = access.coverage(pop, costs.where("fac_id = 20"), 10.0).first()
    assert (west.covered, west.denominator, east.covered) == (150, 350, 200)
    cands = spark.createDataFrame([("west", 150 / 350, 0.0, 0.0, 5), ("east", 200 / 350, 0.0, 0.0, 5), ("over", 1.0, 0.0, 0.0, 20)], "id string, coverage double, equity double, cost double, price long")
    got = {r.id: r for r in decision.scenario_compare(cands, "id", {"coverage": 1, "equity": 0, "cost": 0}, 10, [1.0]).collect()}
    assert got["east"]["rank"] == 1 and got["west"]["rank"] == 2 and got["over"]["rank"] is None and got["over"].reason == "over-budget"


def test_wall_viewshed(spark):
    """A 50 m wall over 600 < x < 900 hides what lies behind it."""
    pts = [(x, y, 50.0 if 600 < x * 100 < 900 else 0.0) for x in range(0, 22) for y in range(-3, 4)]
    surface = spark.createDataFrame(pts, "gx int, gy int, elev double")
    obs = spark.createDataFrame([(1, 0.0, 0.0)], "obs_id long, x double, y double")
    view = terrain.viewshed(surface, obs, 15, 100.0, 0.5, observer_m=2.0)
    t = terrain.tallies(view).first()
    assert t.outside > 0 and t.visible > 0 and t.blocked > 0
    assert t.visible + t.blocked + t.indeterminate + t.outside == t.targets
    east = {r.t: r.status for r in view.collect()}
    row = {x: east[15 * 31 + 15 + x] for x in range(1, 16)}
    assert all(row[x] == "visible" for x in range(1, 7)) and all(row[x] == "blocked" for x in range(9, 16))


def test_obstacle_blocks_a_flat_line(spark):
    surface = spark.createDataFrame([(x, y, 0.0) for x in range(12) for y in range(3)], "gx int, gy int, elev double")
    line = spark.createDataFrame([(1, 0.0, 1.0, 10.0, 1.0)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    post = spark.createDataFrame([(5, 1, 30.0)], "gx int, gy int, height double")
    free = terrain.line_of_sight(surface, line, 100.0, 1.0).first()
    hit = terrain.line_of_sight(surface, line, 100.0, 1.0, obstacles=post).first()
    assert free.status == "visible" and hit.status == "blocked" and hit.source == "obstacle" and hit.first_obstruction_m == pytest.approx(500.0)
    graze = terrain.line_of_sight(surface, line, 100.0, 1.0, accuracy_m=5.0).first()
    assert graze.status == "indeterminate"


def test_titles_and_truncation(spark):
    r = one(spark, a=X.clean_title(F.lit("\x1b]0;t\x07\x1b[31mred\x1b[0m  ​x\ny")), b=X.utf8_truncate(F.lit("aéé"), 4), c=X.utf8_tail(F.lit("aéé"), 3),
            d=X.preview(F.lit("one  two\nthree"), 8), e=X.utf8_truncate(F.lit("a😀b"), 4), f=X.fallback_title(F.lit("un deux trois"), 2, 6))
    assert list(r) == ["redx y".replace("redx", "red x"), "aé", "é", "one two…", "a", "un deu"]


def test_gauss_kruger_round_trip(spark):
    lon, lat = geo.gauss_kruger_to_wgs84(F.lit(500000.0), F.lit(4427757.218739), F.lit(4548))
    r = one(spark, lon=lon, lat=lat)
    assert r.lon == pytest.approx(117.0) and r.lat == pytest.approx(39.98, abs=0.03)


def test_spec_defaults_and_issues():
    from terralog.spec import StatSpec
    assert StatSpec().permutations == 199 and StatSpec().seed == 20260924
    assert StatSpec(band_m=-1, permutations=3, correction="x").issues() == ["band-bound", "permutations-bound", "correction"]
    assert StatSpec().digest() == StatSpec().digest() != StatSpec(seed=1).digest()

"""Split keys, dense places and repartitioning never change a result; brute force on small inputs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from terralog.fixtures import Tables
from terralog.operators import access, autocorrelation, decision, lineage, patterns, rollups, sessions, weights
from terralog.plans.grid import grid_pairs
from terralog.plans.iterate import components
from terralog.plans.ranking import group_order_stats, value_ranks
from terralog.plans.running import Run, int_block, last_seen, next_seen, running
from terralog.spec import StatSpec
from tests.conftest import SMALL


def hav(a, b):
    rad = math.pi / 180
    h = math.sin((b[1] - a[1]) * rad / 2) ** 2 + math.cos(a[1] * rad) * math.cos(b[1] * rad) * math.sin((b[0] - a[0]) * rad / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_equals_plain_windows(spark, block):
    rng = random.Random(7)
    rows = [(k, s, rng.randint(-5, 5), rng.choice([None, s])) for k in (1, 2) for s in rng.sample(range(100), 40 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k long, s long, v long, w long")
    got = running(df, ["k"], ["s"], int_block("s", block), [
        Run("cum", "sum", F.col("v")), Run("before", "sum", F.col("v"), inclusive=False), Run("left", "sum", F.col("v"), backward=True),
        last_seen("last", ["s"], F.col("w"), F.col("w").isNotNull()), next_seen("nxt", ["s"], F.col("v"))])
    w = Window.partitionBy("k").orderBy("s")
    want = df.select("k", "s", F.sum("v").over(w).alias("cum"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                     F.sum("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("left"), F.last("w", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"), F.lead("v").over(w).alias("nxt"))
    flat = got.select("k", "s", "cum", "before", "left", F.col("last.v").alias("last"), F.col("nxt.v").alias("nxt"))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, want.collect()))


def test_folds_do_not_depend_on_block_size(spark):
    log = Tables(spark, SMALL).log
    for fold in (sessions.session_stats, sessions.turn_outline, sessions.surface_tokens, sessions.pairing_balance):
        assert sorted(map(str, fold(log).collect())) == sorted(map(str, fold(log, 5).collect())), fold.__name__


def _points(n, seed=3, hot=0):
    rng = random.Random(seed)
    pts = [(i, 116 + rng.random() * 0.2, 39.9 + rng.random() * 0.2) for i in range(n)]
    return [(i, 116.05, 39.95) if i < hot else (i, x, y) for i, x, y in pts]


@pytest.mark.parametrize("lat_shift,lon_shift", [(0, 0), (0, 63.9), (49.9, 0), (-39.95, -116.1)])
def test_grid_pairs_equal_brute_force_and_ignore_chunks(spark, lat_shift, lon_shift):
    pts = [(i, ((x + lon_shift + 180) % 360) - 180, max(-90.0, min(90.0, y + lat_shift))) for i, x, y in _points(120, hot=40)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    want = {(a[0], b[0]) for a, b in itertools.permutations(pts, 2) if hav(a[1:], b[1:]) <= 3000}
    for chunk in (5, 4096):
        got = {(r.id, r.r_id) for r in grid_pairs(df, df, 3000.0, "id", "id", chunk=chunk).where("id <> r_id").select("id", "r_id").collect()}
        assert got == want


def test_weights_with_a_third_of_units_in_one_place(spark):
    pts = _points(90, hot=30)
    df = spark.createDataFrame(pts, "unit_id long, lon double, lat double")
    k = {r.unit_id: r.k for r in weights.unit_weights(df, 2500.0).collect()}
    want = {a[0]: sum(hav(a[1:], b[1:]) <= 2500 for b in pts if b[0] != a[0]) for a in pts}
    assert k == want
    s = weights.weight_sums(weights.unit_weights(df, 2500.0)).first()
    assert s.s0 == pytest.approx(s.n - s.islands)


def test_moran_equals_dense_matrix_also_when_crowded(spark):
    pts = _points(60, hot=20)
    vals = [math.sin(i) * 10 for i in range(60)]
    df = spark.createDataFrame([(i, x, y, vals[i]) for i, x, y in pts], "unit_id long, lon double, lat double, value double")
    m = autocorrelation.moran(df, StatSpec(band_m=4000.0, permutations=19)).first()
    mean = sum(vals) / 60
    z = [v - mean for v in vals]
    near = [[j for j in range(60) if j != i and hav(pts[i][1:], pts[j][1:]) <= 4000] for i in range(60)]
    num = sum(z[i] * z[j] / len(near[i]) for i in range(60) for j in near[i])
    s0 = sum(1 for n in near if n)
    assert m.i == pytest.approx(60 / s0 * num / sum(v * v for v in z), abs=1e-12)
    assert 0.05 <= m.p <= 1 and m.status == "succeeded"
    again = autocorrelation.moran(df.repartition(7, "lat"), StatSpec(band_m=4000.0, permutations=19)).first()
    assert again.p == m.p and again.i == pytest.approx(m.i, abs=1e-12)


def test_refusals_are_statuses(spark):
    few = spark.createDataFrame([(i, 116.0, 39.0, float(i)) for i in range(4)], "unit_id long, lon double, lat double, value double")
    assert autocorrelation.moran(few, StatSpec(permutations=9)).first().reason == "too-few-valid-units"
    flat = spark.createDataFrame([(i, 116.0, 39.0, 1.0) for i in range(12)], "unit_id long, lon double, lat double, value double")
    assert autocorrelation.moran(flat, StatSpec(permutations=9)).first().reason == "constant-field"
    far = spark.createDataFrame([(i, 100.0 + i, 10.0, float(i)) for i in range(12)], "unit_id long, lon double, lat double, value double")
    assert autocorrelation.moran(far, StatSpec(permutations=9)).first().reason == "no-weight-neighbors"
    assert {r.status for r in autocorrelation.hotspot(far, StatSpec(permutations=9)).collect()} == {"not_applicable"}


def test_draws_are_permutations(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(50)], "unit_id long, value double")
    for r in autocorrelation.permutation_draws(df, "value", 9, 1).groupBy("draw").agg(F.sort_array(F.collect_list("permuted")).alias("v")).collect():
        assert r.v == [float(i * i) for i in range(50)]


def test_ranks_with_a_hot_value(spark):
    vals = [1.0] * 40 + [float(i) for i in range(2, 50)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for r in value_ranks(df, "v", ranges=4).collect():
        assert r.below == sum(v < r.v for v in vals) and r.n == vals.count(r.v)
    med = group_order_stats(df.withColumn("g", F.lit(1)), ["g"], "v", {"m": lambda n: F.ceil(n * 0.5)}).first().m
    assert med == sorted(vals)[43]


def test_components_on_chain_ring_and_star(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 140)]
    ring = [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    edges = chain + star + ring
    rng.shuffle(edges)
    nodes = sorted({n for e in edges for n in e} | {999})
    got = {r.id: r.label for r in components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and all(got[200 + i] == 200 for i in range(30)) and got[999] == 999


def test_cluster_matches_brute_force_dbscan(spark):
    pts = [(i, x, y, i % 4) for i, x, y in _points(80, seed=11, hot=25)]
    obs = spark.createDataFrame(pts, "obs_id long, lon double, lat double, bin long")
    near = {a[0]: [b[0] for b in pts if abs(a[3] - b[3]) <= 1 and hav(a[1:3], b[1:3]) <= 1500] for a in pts}
    core = {i for i, n in near.items() if len(n) >= 4}
    label = {i: i for i in core}
    for _ in core:
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    want = {i: ("core", label[i]) if i in core else (("border", min(label[j] for j in near[i] if j in core)) if any(j in core for j in near[i]) else ("noise", None)) for i in near}
    got = {r.obs_id: (r.role, r.label) for r in patterns.cluster(obs, 1500.0, 1, 4).collect()}
    assert got == want


def test_nearest_equals_brute_force(spark):
    units, facs = _points(40), [(i, x + 0.3 * (i % 3), y) for i, x, y in _points(9, seed=5)]
    got = {(r.unit_id, r["rank"]): r.fac_id for r in access.nearest(spark.createDataFrame(units, "unit_id long, lon double, lat double"), spark.createDataFrame(facs, "fac_id long, lon double, lat double"), 2, start_m=500.0).collect()}
    for u in units:
        best = sorted((hav(u[1:], f[1:]), f[0]) for f in facs)[:2]
        assert [got[(u[0], 1)], got[(u[0], 2)]] == [b[1] for b in best]


def test_pending_calls_evict_oldest_first(spark):
    rows = [(1, 0, s, "tool/call", f"c{s}", False) for s in range(70)] + [(1, 0, 100 + s, "tool/result", f"c{s}", False) for s in range(70)]
    rows += [(2, 0, 2 * s, "tool/call", f"d{s}", False) for s in range(80)] + [(2, 0, 2 * s + 1, "tool/result", f"d{s}", False) for s in range(80)]
    df = spark.createDataFrame(rows, "session_id long, turn long, seq long, type string, call_id string, is_error boolean")
    got = sessions.pair_calls(df).groupBy("session_id", "outcome").count().collect()
    assert {(r.session_id, r.outcome): r["count"] for r in got} == {(1, "evicted"): 6, (1, "paired"): 64, (2, "paired"): 80}


def test_cycles_and_orphans(spark):
    t = spark.createDataFrame([(1, [2], "pending", "a"), (2, [3], "pending", "a"), (3, [1], "pending", "a"), (4, [1, 1], "pending", "a/b"), (5, [5, 9], "pending", "ab")], "id long, blocked_by array<long>, status string, write_scope string")
    got = {(r.id, r.blocker, r.violation) for r in lineage.dependency_check(t).collect()}
    assert got == {(1, 2, "cycle"), (2, 3, "cycle"), (3, 1, "cycle"), (4, 1, "duplicate"), (5, 5, "self"), (5, 9, "missing")}
    s = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 9, 2), (4, 5, 3), (5, 4, 4), (6, 4, 5), (7, 2, 6)], "session_id long, parent_id long, pos long")
    flat = {r.session_id: (r.depth, r.path) for r in lineage.flatten_lineage(s).collect()}
    assert {k: v[0] for k, v in flat.items()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 2}
    assert sorted(flat, key=lambda k: flat[k][1]) == [1, 2, 7, 3, 4, 6, 5]


def test_merge_ordered_inserts_before_known(spark):
    cur = spark.createDataFrame([("c", 0), ("a", 1), ("gone", 2)], "id string, pos long")
    base = spark.createDataFrame([("n1", 0, "x"), ("a", 1, "A"), ("n2", 2, "y"), ("c", 3, "C"), ("n3", 4, "z")], "id string, pos long, value string")
    got = [r.id for r in lineage.merge_ordered(cur, base).orderBy("position").collect()]
    assert got == ["n2", "c", "n1", "a", "n3"]


def test_allocation_is_greedy_and_within_budget(spark):
    sites = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 50.0)], "fac_id long, cost double")
    reach = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (1, 3), (2, 3), (3, 3)], "unit_id long, fac_id long")
    demand = spark.createDataFrame([(1, 10), (2, 20), (3, 5), (4, 100)], "unit_id long, population long")
    picks, assigned = decision.allocate(sites, reach, demand, 3, 12.0)
    assert [(r.fac_id, r.gain) for r in picks.orderBy("rank").collect()] == [(1, 30), (2, 5)]
    assert {r.unit_id: r.fac_id for r in assigned.collect()} == {1: 1, 2: 1, 3: 2}


def test_zonal_totals_and_missing(spark):
    u = Tables(spark, SMALL).units
    z = rollups.zonal(u, "zone", "value", "denominator").agg(F.sum("count").alias("c"), F.sum("missing").alias("m")).first()
    assert z.c + z.m == u.count()


def test_forecast_families(spark):
    rows = [(k, float(x), 3.0 + 2.0 * x + (10.0 if x >= 6 else 0.0) * (k == 2)) for k in (1, 2) for x in range(12)]
    s = spark.createDataFrame(rows, "k long, x double, y double")
    lin = {r.k: r for r in decision.forecast_fit(s, "k", "x", "y").collect()}
    assert lin[1].b1 == pytest.approx(2.0) and lin[1].sigma == pytest.approx(0.0, abs=1e-6)
    step = {r.k: r for r in decision.forecast_fit(s, "k", "x", "y", "threshold").collect()}
    assert step[2].b2 == pytest.approx(10.0) and step[2].b1 == pytest.approx(2.0)
    quad = decision.forecast_fit(spark.createDataFrame([(1, float(x), float(x * x)) for x in range(10)], "k long, x double, y double"), "k", "x", "y", "ridge-quadratic", ridge=0.0).first()
    assert quad.b2 == pytest.approx(1.0)
    p = decision.forecast_predict(decision.forecast_fit(s, "k", "x", "y"), spark.createDataFrame([(1, 5.0), (1, 50.0)], "k long, x double"), "k", "x").orderBy("x").collect()
    assert [r.out_of_domain for r in p] == [False, True] and p[0].predicted == pytest.approx(13.0)

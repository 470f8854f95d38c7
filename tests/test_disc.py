"""Totals within a distance against brute force: crowded places, the antimeridian, poles, cut tiles, odd values."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.operators import access, decision, weights
from terralog.plans.disc import disc_products, disc_totals, metres
from terralog.session import shared_dir


def _frame(spark, lon, lat, v):
    return spark.createDataFrame([(i, float(x), float(y), float(a), i % 3, i % 5) for i, (x, y, a) in enumerate(zip(lon, lat, v))], "id long, lon double, lat double, v double, n int, kind int")


def _points(kind, n=260, seed=5):
    rng = np.random.default_rng(seed)
    lon, lat = 116 + rng.random(n) * 0.2, 39.9 + rng.random(n) * 0.2
    if kind == "crowded":      # a third in one small cell, some at one position
        lon[:90], lat[:90] = 116.05 + rng.random(90) * 1e-3, 39.95 + rng.random(90) * 1e-3
        lon[90:120], lat[90:120] = 116.06, 39.95
    if kind == "antimeridian":
        lon = (lon - 116.1 + 360) % 360 - 180
    if kind == "pole":
        lon, lat = rng.random(n) * 360 - 180, 90 - rng.random(n) * 0.2
    if kind == "spread":
        lon, lat = rng.random(n) * 360 - 180, rng.random(n) * 180 - 90
    return lon, lat, rng.integers(-500, 500, n) / 4


@pytest.mark.parametrize("kind,radius", [("plain", 3000.0), ("crowded", 3000.0), ("antimeridian", 3000.0), ("pole", 6000.0), ("spread", 3_000_000.0), ("crowded", 40.0)])
def test_totals_equal_brute_force_also_with_cut_tiles(spark, kind, radius):
    lon, lat, v = _points(kind)
    df = _frame(spark, lon, lat, v)
    near = metres(lon[:, None], lat[:, None], lon[None], lat[None]) <= radius
    want = {i: (float(v[near[i]].sum()), int(sum(j % 3 for j in np.flatnonzero(near[i])))) for i in range(len(v))}
    for chunk in (1 << 16, 60):
        got = {r.id: (r.v, r.n) for r in disc_totals(df, df, radius, "id", ["v", "n"], chunk=chunk).collect()}
        assert got == want
    by = {(r.id, r.kind): r.v for r in disc_totals(df, df, radius, "id", ["v"], by=("kind",)).collect()}
    assert by == {(i, k): float(v[near[i] & (np.arange(len(v)) % 5 == k)].sum()) for i in range(len(v)) for k in range(5) if (near[i] & (np.arange(len(v)) % 5 == k)).any()}


def test_products_equal_brute_force(spark):
    for kind, chunk in (("plain", 1 << 14), ("crowded", 40), ("antimeridian", 1 << 14)):
        lon, lat, v = _points(kind)
        first = {(x, y): i for i, (x, y) in reversed(list(enumerate(zip(lon, lat))))}
        keep = np.array(sorted(first.values()))
        lon, lat, v = lon[keep], lat[keep], v[keep]
        df = _frame(spark, lon, lat, v).select("id", "lon", "lat", (1.0 / (F.col("id") + 1)).alias("w"), F.array("v", F.col("v") * F.col("id"), F.lit(1.0)).alias("zs"))
        z, w = np.stack([v, v * np.arange(len(v)), np.ones(len(v))], axis=1), 1.0 / (np.arange(len(v)) + 1)
        near = (metres(lon[:, None], lat[:, None], lon[None], lat[None]) <= 3000.0).astype(float)
        got = np.sum([r.sums for r in disc_products(df, 3000.0, "id", "w", "zs", chunk=chunk).collect()], axis=0)
        assert got == pytest.approx((w[:, None] * z * (near @ z)).sum(axis=0), rel=1e-9)


def test_values_that_are_not_finite_spoil_only_their_neighbours(spark):
    lon, lat, v = _points("plain", 60)
    v[3], v[7] = math.nan, math.inf
    df = _frame(spark, lon, lat, v)
    near = metres(lon[:, None], lat[:, None], lon[None], lat[None]) <= 3000.0
    for r in disc_totals(df, df, 3000.0, "id", ["v"]).collect():
        assert r.v == pytest.approx(float(v[near[r.id]].sum()), nan_ok=True)


def test_weights_write_no_row_per_pair(spark):
    """1,500 units within one band are 1.1 million pairs; what is written stays that of the units."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, 116 + rng.random() * 0.02, 39.9 + rng.random() * 0.02) for i in range(1500)], "unit_id long, lon double, lat double")
    folder = Path(shared_dir(spark))
    before = set(folder.glob("terralog-*"))
    got = {r.unit_id: r.k for r in weights.unit_weights(df, 1500.0).collect()}
    rows = sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("terralog-*")) - before)
    u = np.array([(r.lon, r.lat) for r in df.orderBy("unit_id").collect()])
    near = metres(u[:, None, 0], u[:, None, 1], u[None, :, 0], u[None, :, 1]) <= 1500.0
    assert got == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    assert rows <= 4 * 1500


def test_exact_sums_and_demand_equal_the_pairs(spark):
    lon, lat, v = _points("crowded")
    units = _frame(spark, lon, lat, v).withColumnRenamed("id", "unit_id")
    for standardization in ("row", "binary"):
        want = weights.exact_weight_sums(weights.edges(units, 2000.0, standardization)).first()
        got = weights.exact_band_sums(units, 2000.0, standardization).first()
        assert [got.s0, got.s1, got.s2] == pytest.approx([want.s0, want.s1, want.s2])
    assert tuple(weights.exact_band_sums(units, 1e-3).where("false").collect()) == () and weights.exact_band_sums(units.limit(1), 10.0).first().s0 is None
    facs = units.where("unit_id % 9 = 0").select(F.col("unit_id").alias("fac_id"), "lon", "lat", (5 + F.col("unit_id") % 7).alias("cost"))
    pop = units.select("unit_id", "lon", "lat", (1 + F.col("unit_id") % 5).alias("population"), F.when(F.col("kind") > 0, F.col("kind")).alias("community"))
    pairs = access.straight_line(pop, facs, 4000.0)
    want = {tuple(r) for r in pairs.join(pop, "unit_id").groupBy("fac_id", "community").agg(F.sum("population")).collect()}
    assert {tuple(r) for r in access.demand_within(facs, pop, 4000.0, by=("community",)).collect()} == want
    for look in (1, 16):
        old, new = decision.allocate(facs, pairs, pop, 4, 25.0), decision.allocate_within(facs, pop, 4000.0, 4, 25.0, look)
        for a, b in zip(old, new):
            assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))

"""Cores and reach of later observations as totals, against brute force; no table of pairs is written."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.operators import access, patterns
from terralog.plans.disc import disc_totals, metres
from terralog.session import shared_dir


def _obs(spark, n=400, bins=9, seed=4):
    rng = np.random.default_rng(seed)
    lon, lat, day = 116 + rng.random(n) * 0.12, 39.9 + rng.random(n) * 0.12, rng.integers(0, bins, n)
    lon[:60], lat[:60] = 116.05, 39.95                      # one position
    return lon, lat, day, spark.createDataFrame([(i, float(x), float(y), int(b)) for i, (x, y, b) in enumerate(zip(lon, lat, day))], "obs_id long, lon double, lat double, bin long")


@pytest.mark.parametrize("seed", [4, 5])
def test_cluster_reach_without_pairs(spark, seed):
    lon, lat, day, obs = _obs(spark, seed=seed)
    near = (metres(lon[:, None], lat[:, None], lon[None], lat[None]) <= 1200.0) & (np.abs(day[:, None] - day[None]) <= 1)
    fit = day <= day.max() - 3
    core = fit & ((near & fit[None]).sum(axis=1) >= 5)
    late = ~fit
    want = (int(late.sum()), int((late & (near & core[None]).any(axis=1)).sum()))
    before = {p.name for p in Path(shared_dir(spark)).glob("terralog-pairs-*")}
    got = patterns.cluster_reach(obs, 1200.0, 1, 5, 3).first()
    assert (got.later, got.reached) == want and got.share == pytest.approx(want[1] / want[0])
    assert {p.name for p in Path(shared_dir(spark)).glob("terralog-pairs-*")} == before


def test_totals_of_equal_columns(spark):
    lon, lat, day, obs = _obs(spark)
    near = (metres(lon[:, None], lat[:, None], lon[None], lat[None]) <= 3000.0) & (day[:, None] == day[None])
    for chunk in (1 << 16, 50):
        got = {r.obs_id: r.n for r in disc_totals(obs, obs.withColumn("n", F.lit(1)), 3000.0, "obs_id", ["n"], match=("bin",), chunk=chunk).collect()}
        assert got == {i: int(k) for i, k in enumerate(near.sum(axis=1))}


def test_nearest_in_a_dense_town(spark):
    """2000 facilities in 3 km around one place and few elsewhere: rings start where they hold few, results are those of brute force."""
    rng = np.random.default_rng(8)
    fx, fy = np.concatenate([116 + rng.random(2000) * 0.03, 116 + rng.random(12) * 3]), np.concatenate([40 + rng.random(2000) * 0.03, 39 + rng.random(12) * 3])
    fx[:30], fy[:30] = 116.01, 40.01                        # one spot
    ux, uy = np.concatenate([116 + rng.random(60) * 0.04, 116 + rng.random(20) * 3, fx[:3]]), np.concatenate([40 + rng.random(60) * 0.04, 39 + rng.random(20) * 3, fy[:3]])
    units = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ux, uy))], "unit_id long, lon double, lat double")
    facs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(fx, fy))], "fac_id long, lon double, lat double")
    far = metres(ux[:, None], uy[:, None], fx[None], fy[None])
    want = {(i, r + 1): int(f) for i in range(len(ux)) for r, f in enumerate(np.lexsort((np.arange(len(fx)), far[i]))[:3])}
    assert {(r.unit_id, r["rank"]): r.fac_id for r in access.nearest(units, facs, 3).collect()} == want
    assert access._first_radius(facs, 3, 5000.0) < 1000.0

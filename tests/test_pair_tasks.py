"""Pairs within a distance are tested by as many tasks as their number asks for, whatever the size of the input."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from terralog.functions.geo import micro
from terralog.plans import grid
from tests.test_scale import hav


def crowd(n):
    rng = random.Random(4)
    return [(i, 116 + rng.random() * 0.05, 39.9 + rng.random() * 0.05) for i in range(n)]


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(grid, "TASK_PAIRS", 2000, raising=False)
    df = spark.createDataFrame(crowd(200), "id long, lon double, lat double")
    pairs = grid.grid_pairs(df, df, 3000.0, "id", "id", chunk=16)
    assert pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() > 8


@pytest.mark.parametrize("probes", [1 << 16, 7])
def test_parts_of_probes_change_nothing(spark, monkeypatch, probes):
    monkeypatch.setattr(grid, "PROBES", probes, raising=False)
    monkeypatch.setattr(grid, "TASK_PAIRS", 500, raising=False)
    pts = crowd(80)
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = grid.grid_pairs(df, df, 2000.0, "id", "id", chunk=10).where("id <> r_id").collect()
    want = {(a[0], b[0]): hav(a[1:], b[1:]) for a, b in itertools.permutations(pts, 2) if hav(a[1:], b[1:]) <= 2000}
    assert len(got) == len(want) and all(r.dist_m == pytest.approx(want[r.id, r.r_id], abs=1e-6) for r in got)


@pytest.mark.parametrize("radius", [0.0, 1e-7, 1.0, 19_000_000.0, 20_015_115.0])
def test_small_and_wide_reaches(spark, radius):
    pts = [(0, 10.0, 20.0), (1, 10.0, 20.0), (2, 10.000001, 20.0), (3, -170.0, -20.0), (4, -169.9, -20.0), (5, 10.0, 90.0), (6, float("nan"), 1.0)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {(r.id, r.r_id) for r in grid.grid_pairs(df, df, radius or 1e-9, "id", "id", cells_per_radius=1.0 if radius > 1e6 else max(radius, 1e-9) / 1000).collect()}
    far = df.alias("a").crossJoin(df.select(F.col("id").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat")))
    want = far.where(grid.haversine(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat")) <= (radius or 1e-9))
    assert got == {(r.id, r.r_id) for r in want.collect()}


def test_places_of_metres(spark):
    values = [0.0, 0.0000004, 0.0000006, 2999.9999994, 2999.9999996, 1234567.1234567]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "m double").select(micro(F.col("m"))).collect()]
    assert got == [round(v, 6) for v in values]

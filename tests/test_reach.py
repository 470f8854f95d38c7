"""Viewsheds by tiles against sampled lines; lattice costs against a plain shortest-path search."""

import heapq

import numpy as np
import pytest

from terralog.operators import access, terrain


def land(spark, rng, width, height, holes=0):
    nodes = [(x, y, float(rng.integers(0, 40))) for x in range(-3, width) for y in range(-2, height) if not holes or rng.random() > holes]
    return spark.createDataFrame(nodes, "gx int, gy int, elev double")


@pytest.mark.parametrize("options", [{}, {"accuracy_m": 2.5, "interval": 0.7, "target_m": 3.0}, {"curvature": True, "observer_m": 30.0}])
def test_viewshed_equals_sampled_lines(spark, options):
    rng = np.random.default_rng(3)
    surface = land(spark, rng, 40, 30, holes=0.01)
    seats = [(k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (-3, -2), (10.25, 7.5), (10.25, 7.5), (38.9, 28.9), (20, 12), (90, 90), (39, 29)])]
    obs = spark.createDataFrame(seats, "obs_id long, x double, y double")
    posts = spark.createDataFrame([(12, 8, 25.0), (12, 8, 5.0), (21, 12, 9.0)], "gx int, gy int, height double")

    def told(df):
        cols = ["obs_id", "t", "status", "first_obstruction_m", "source", "min_clearance"]
        return sorted(tuple(round(v, 6) if isinstance(v, float) else -1 if v is None else v for v in r) for r in df.select(cols).collect())
    for obstacles in (None, posts):
        got = told(terrain.viewshed(surface, obs, 6, 90.0, obstacles=obstacles, view_rows=300, **options))
        assert got == told(terrain.sampled_viewshed(surface, obs, 6, 90.0, obstacles=obstacles, **options))
    assert {r[2] for r in got} >= {"visible", "blocked", "outside", "refused"}


def test_viewshed_edges(spark):
    surface = land(spark, np.random.default_rng(1), 12, 12)
    obs = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 1.0), (3, 5.0, 5.0)], "obs_id long, x double, y double")
    view = terrain.viewshed(surface, obs, 3, 50.0)
    assert sorted(r.obs_id for r in view.where("status = 'refused'").collect()) == [1, 2]
    assert terrain.viewshed(surface, obs.limit(0), 3, 50.0).count() == 0
    with pytest.raises(ValueError):
        terrain.viewshed(surface, obs, 513, 50.0)


def test_viewshed_rows_grow_with_targets(spark):
    """A sight line is one row of the result; no node is in more than four tiles."""
    surface = land(spark, np.random.default_rng(2), 160, 160)
    obs = spark.createDataFrame([(1, 80.0, 80.0)], "obs_id long, x double, y double")
    view = terrain.viewshed(surface, obs, 60, 30.0)
    assert view.where("t IS NOT NULL").count() == sum(0 < x * x + y * y <= 3600 for x in range(-60, 61) for y in range(-60, 61))
    assert "steps" not in view._jdf.queryExecution().optimizedPlan().toString()


def plain_costs(home, closed, slow, limit):
    factor = lambda v: slow.get(v, 1)
    if home in closed:
        return {}
    best, queue = {home: 0}, [(0, home)]
    while queue:
        c, v = heapq.heappop(queue)
        if c > best[v]:
            continue
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            u = v[0] + dx, v[1] + dy
            d = c + factor(v) + factor(u)
            if u not in closed and d <= limit and d < best.get(u, limit + 1):
                best[u] = d
                heapq.heappush(queue, (d, u))
    return best


def facs(spark, nodes):
    per = 111195.0802335329
    rows = [(k, (x + 0.5) * 100 / per, (y + 0.5) * 100 / per) for k, (x, y) in enumerate(nodes)]
    return spark.createDataFrame(rows, "fac_id long, lon double, lat double")


@pytest.mark.parametrize("weighted", [False, True])
def test_lattice_costs(spark, weighted):
    rng = np.random.default_rng(8)
    homes = [(0, 0), (0, 0), (5, 3), (2, 2)]
    closed = {(int(x), int(y)) for x, y in rng.integers(-6, 10, (40, 2))} - {(0, 0), (5, 3)} | {(2, 2)}
    slow = {(int(x), int(y)): int(f) for (x, y), f in zip(rng.integers(-6, 10, (80, 2)), rng.integers(1, 6, 80))} if weighted else {}
    bar = spark.createDataFrame([(*c,) for c in closed] + [(2, 2)], "ix long, iy long")
    table = spark.createDataFrame([(*k, f) for k, f in slow.items()] + [(0, 0, 1)], "ix long, iy long, factor int") if weighted else None
    half = 100 / 80.0 / 2
    got = {(r.fac_id, r.ix, r.iy): round(r.minutes / half) for r in access.reach_nodes(facs(spark, homes), bar, 100.0, 0.0, 9 * 1.25, "walk", slowness=table).collect()}
    want = {(k, *v): c for k, h in enumerate(homes) for v, c in plain_costs(h, closed, slow, 18).items()}
    assert got == want and len(want) > 100


def test_walk_ends_with_its_front(spark):
    """A walled-in facility: the limit of ten thousand minutes needs no more rounds than there are buckets of reached nodes."""
    wall = {(x, y) for x in range(-2, 3) for y in range(-2, 3)} - {(x, y) for x in range(-1, 2) for y in range(-1, 2)}
    bar = spark.createDataFrame(sorted(wall), "ix long, iy long")
    assert access.reach_nodes(facs(spark, [(0, 0)]), bar, 100.0, 0.0, 10_000.0, "walk").count() == 9
    assert access.reach_nodes(facs(spark, [(0, 0)]).limit(0), bar, 100.0, 0.0, 5.0, "walk").count() == 0
    with pytest.raises(ValueError):
        access.reach_nodes(facs(spark, [(0, 0)]), bar, 100.0, 0.0, 5.0, "walk", slowness=spark.createDataFrame([(0, 0, 0)], "ix long, iy long, factor int"))

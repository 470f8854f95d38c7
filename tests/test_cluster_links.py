"""Space-time clusters are linked by tiles without a row per pair, and every observation keeps its row."""

import random

import numpy as np
import pytest

from terralog.operators import patterns
from terralog.plans import disc
from tests.test_scale import hav

EPS = 1500.0


def plain(rows, bins, min_pts):
    """Role and label by the definition, over all pairs."""
    near = {a[0]: [b[0] for b in rows if abs(a[3] - b[3]) <= bins and hav(a[1:3], b[1:3]) <= EPS] for a in rows}
    core = {i for i in near if len(near[i]) >= min_pts}
    label = {i: i for i in core}
    moved = True
    while moved:
        low = {i: min(label[j] for j in near[i] if j in core) for i in core}
        moved, label = low != label, low
    edge = {i: min(label[j] for j in near[i] if j in core) for i in near if i not in core and any(j in core for j in near[i])}
    return {i: ("core", label[i]) if i in core else ("border", edge[i]) if i in edge else ("noise", None) for i in near}


def places(seed, n, lat):
    """Crowds about as far from each other as they reach, with scattered places and repeated ones between."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (rng.gauss(rng.randrange(4) * 0.021, 0.002), rng.gauss(rng.randrange(3) * 0.017, 0.002)) if i % 4 else (rng.uniform(-0.1, 0.2), rng.uniform(-0.1, 0.1))
        rows.append((i, 116.0 + x, lat + y, rng.randrange(4)))
    return rows + [(n + i, *rows[i][1:3], rows[i][3] + i % 2) for i in range(0, n, 9)]


@pytest.mark.parametrize("seed, lat, chunk", [(1, 40.0, 1 << 16), (2, 40.0, 40), (3, -89.8, 1 << 16)])
def test_clusters_by_definition(spark, monkeypatch, seed, lat, chunk):
    for name, defaults in (("disc_links", ((), chunk)), ("disc_least", ((), chunk)), ("disc_totals", ((), chunk, ()))):
        monkeypatch.setattr(getattr(disc, name), "__defaults__", defaults)
    rows = places(seed, 160, lat)
    obs = spark.createDataFrame(rows, "obs_id long, lon double, lat double, bin long")
    got = {r.obs_id: (r.role, r.label) for r in patterns.cluster(obs, EPS, 1, 4).collect()}
    assert got == plain(rows, 1, 4)


def test_observations_without_a_place_are_noise(spark):
    rows = [(1, 116.0, 40.0, 5), (2, 116.0, 40.0, 5), (None, 116.0, 40.0, 5), (4, None, 40.0, 5), (5, 116.0, None, 5), (6, 116.0, 40.0, None), (7, float("nan"), 40.0, 5), (8, 116.0, float("nan"), 5)]
    got = patterns.cluster(spark.createDataFrame(rows, "obs_id long, lon double, lat double, bin long"), EPS, 1, 3).collect()
    noise = ("noise", None)
    assert sorted(((r.obs_id or 0, (r.role, r.label)) for r in got)) == [(0, noise), (1, ("core", 1)), (2, ("core", 1)), *((i, noise) for i in range(4, 9))]


def test_links_do_not_grow_with_the_pairs(spark):
    rows = [r for r in places(4, 600, 40.0)]
    core = spark.createDataFrame([(*r[:3], 0, r[0]) for r in rows], "site long, lon double, lat double, bin long, head long")
    links = disc.disc_links(core, core, EPS, "site", "head", match=("bin",)).collect()
    pairs = sum(hav(a[1:3], b[1:3]) <= EPS for a in rows for b in rows if a[0] < b[0])
    assert pairs > 20 * len(rows) > 4 * len(links) > 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_and_least_of_a_tile(seed):
    rng = np.random.default_rng(seed)
    lon, lat = 116 + rng.choice([0.0, 0.02, 0.04], 400) + rng.normal(0, 0.002, 400), 40 + rng.choice([0.0, 0.016], 400) + rng.normal(0, 0.0015, 400)
    near = disc.metres(lon[:150, None], lat[:150, None], lon[None, 150:], lat[None, 150:]) <= EPS
    node = np.arange(400) // 3

    def groups(a, b):
        root = list(range(node.max() + 1))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in zip(a, b):
            x, y = sorted((top(x), top(y)))
            root[y] = x
        return [top(x) for x in range(len(root))]
    q, p = np.nonzero(near)
    one, two = disc.links_within(lon[:150], lat[:150], node[:150], lon[150:], lat[150:], node[150:], EPS)
    assert len(one) <= node.max() and groups(one, two) == groups(node[:150][q], node[150:][p])
    value = rng.integers(0, 1000, 250)
    some, low = disc.least_within(lon[:150], lat[:150], lon[150:], lat[150:], value, EPS)
    assert some.tolist() == np.flatnonzero(near.any(axis=1)).tolist() and low.tolist() == [value[near[i]].min() for i in some]

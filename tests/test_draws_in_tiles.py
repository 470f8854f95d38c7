"""The draws of the permutation tests are made where they are used, and units that share a place are added up first."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from terralog.operators import autocorrelation as M
from terralog.plans import permute as permutes
from terralog.plans.permute import PRIME, _shift, permute, round_keys
from terralog.spec import StatSpec
from tests.test_scale import hav

SPEC = StatSpec(band_m=1500.0, permutations=19)


def crowded(n):
    rng = random.Random(8)
    spots = [(116 + rng.random() * 0.05, 39.9 + rng.random() * 0.05) for _ in range(n // 2)] + [(116.02, 39.92)] * (n // 4)
    return [(i, *rng.choice(spots), rng.gauss(0, 100)) for i in range(n)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_moran_by_definition(spark, monkeypatch, most):
    monkeypatch.setattr(permutes, "LOOKUP_ROWS", most)
    rows = crowded(120)
    units = spark.createDataFrame(rows, "unit_id long, lon double, lat double, value double")
    got = M.moran(units, SPEC).first()
    rank = {r.unit_id: r["rank"] for r in M._ranked(units, SPEC.seed, "unit_id").collect()}
    z = np.array([r[3] for r in rows]) - np.mean([r[3] for r in rows])
    w = np.array([[float(a[0] != b[0] and hav(a[1:3], b[1:3]) <= SPEC.band_m) for b in rows] for a in rows])
    w /= np.maximum(w.sum(axis=1), 1)[:, None]
    order = np.array([rank[r[0]] for r in rows])
    by_rank = np.empty(len(rows))
    by_rank[order] = z
    draws = by_rank[permute(order, round_keys(SPEC.seed, SPEC.permutations), len(rows))]
    index = lambda v: len(rows) / w.sum() * (v @ w @ v) / (z @ z)
    each, e = np.array([index(d) for d in draws.T]), -1 / (len(rows) - 1)
    assert got.i == pytest.approx(index(z)) and got.sd_permutation == pytest.approx(each.std())
    assert got.p == (np.sum(np.abs(each - e) >= abs(index(z) - e) - 1e-12) + 1) / (SPEC.permutations + 1)


def test_no_draw_of_a_lone_unit_is_written(spark, monkeypatch):
    written = []
    keep = M.cut
    monkeypatch.setattr(M, "cut", lambda df, label="cut": written.append((label, df)) or keep(df, label))
    rows = [(i, 116 + i * 0.001, 39.9, float(i % 7)) for i in range(90)]
    M.scale_ladder(spark.createDataFrame(rows, "unit_id long, lon double, lat double, value double"), SPEC, [300.0, 900.0]).collect()
    assert {label for label, _ in written} >= {"ranked", "rows", "draws"}
    for _, df in written:
        lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        assert not lists or df.where(" OR ".join(f"{c} IS NOT NULL" for c in lists)).count() == 0


def test_shift_without_division():
    half = np.array([0, 1, 46_340, 46_341, PRIME - 1, PRIME, PRIME + 1, 2 ** 31 + 5], dtype=np.int64)
    keys = np.array([0, 1, 7, 2 ** 28 - 1, 0, 0, 0, 2 ** 28 - 1], dtype=np.int64)
    v = [(int(h) + int(k)) % PRIME for h, k in zip(half, keys)]
    assert _shift(half, keys).tolist() == [x * x % PRIME * 48_271 % PRIME for x in v]

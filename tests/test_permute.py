"""Computed permutations: bijections, inverses, spread, both ways of looking values up, and the SQL twin."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.operators import autocorrelation as M
from terralog.plans.permute import heads, permute, permute_sql, round_keys, with_draws
from terralog.spec import StatSpec


@pytest.mark.parametrize("n", [1, 2, 3, 7, 36, 37, 50, 1000, 4099])
def test_bijections_and_inverses(n):
    keys = round_keys(7, 20)
    there = permute(np.arange(n), keys, n)
    assert all(sorted(col) == list(range(n)) for col in there.T.tolist())
    for d in range(20):
        assert (permute(there[:, d], keys[d:d + 1], n, inverse=True)[:, 0] == np.arange(n)).all()


def test_draws_are_spread():
    """Where a rank goes, and where two neighbours go together, is near uniform over many draws."""
    n, keys = 40, round_keys(3, 4000)
    there = permute(np.arange(n), keys, n)
    expected = 4000 / n
    for i in (0, 1, 17, 39):
        chi = ((np.bincount(there[i], minlength=n) - expected) ** 2 / expected).sum()
        assert chi < n - 1 + 5 * np.sqrt(2 * (n - 1))
    # n (n - 1) ordered pairs
    pairs = np.bincount(there[4] * n + there[5], minlength=n * n)
    expected = 4000 / (n * (n - 1))
    assert ((pairs - expected) ** 2 / expected).sum() < n * n + 5 * np.sqrt(2 * n * n)
    # neither fixed points nor successions stand out
    assert abs((there == np.arange(n)[:, None]).sum() / 4000 - 1) < 0.1
    assert abs((np.diff(there, axis=0) == 1).sum() / 4000 - (n - 1) / n) < 0.1


def test_values_by_lookup_and_by_shuffle(spark):
    keys, n = round_keys(5, 11), 300
    ranked = spark.range(n).select(F.col("id").alias("rank"), (F.col("id") * 3.5).alias("v"), F.lit("x").alias("other"))
    got = [{r["rank"]: (r["zs"], r["other"]) for r in with_draws(ranked, "v", n, keys, lookup_rows=limit).collect()} for limit in (1000, 10)]
    want = permute(np.arange(n), keys, n) * 3.5
    assert got[0] == got[1] and all(got[0][i][0] == want[i].tolist() for i in range(n))
    back = {(r["draw"], r["pos"]): r["rank"] for r in heads(spark, n, 25, keys).collect()}
    there = permute(np.arange(n), keys, n)
    assert len(back) == 25 * 11 and all(there[rank, d - 1] == pos - 1 for (d, pos), rank in back.items())


def test_sql_twin(spark):
    units = [(i * 7 % 501, float(i)) for i in range(500)]
    df = spark.createDataFrame(units, "unit_id long, value double")
    got = sorted((r["draw"], r["unit_id"], r["pos"], r["permuted"]) for r in M.permutation_draws(df, "value", 9, 42).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE u AS SELECT i * 7 % 501 AS unit_id, CAST(i AS DOUBLE) AS value FROM range(500) t(i)")
    sql = f"WITH RECURSIVE {permute_sql(42, 9, 'u', 'unit_id, value', 'unit_id')} SELECT d.draw, d.unit_id, d.pos, b.value FROM dr d JOIN dr b ON b.draw = 0 AND b.pos = d.pos WHERE d.draw > 0"
    assert got == sorted(con.execute(sql).fetchall())


def test_moran_against_plain_python(spark):
    """Shared sites, whole cells and islands, against a double loop over units."""
    rng = np.random.default_rng(4)
    spots = [(116.0 + x, 39.0 + y) for x, y in rng.uniform(0, 0.05, (40, 2))] + [(116.0, 39.0)] * 8 + [(117.0, 39.5)]
    units = [(k, float(lon), float(lat), float(v)) for k, ((lon, lat), v) in enumerate(zip(spots, rng.normal(0, 3, len(spots))))]
    df = spark.createDataFrame(units, "unit_id long, lon double, lat double, value double")
    spec = StatSpec(band_m=1500.0, permutations=19)
    got = M.moran(df, spec).first()
    draws = {}
    for r in M.permutation_draws(df, "value", 19, spec.seed).collect():
        draws.setdefault(r["draw"], {})[r["unit_id"]] = r["permuted"]
    rad = np.radians([[u[1], u[2]] for u in units])
    h = np.sin((rad[:, None, 1] - rad[None, :, 1]) / 2) ** 2 + np.cos(rad[:, None, 1]) * np.cos(rad[None, :, 1]) * np.sin((rad[:, None, 0] - rad[None, :, 0]) / 2) ** 2
    near = (2 * 6371008.8 * np.arcsin(np.sqrt(h)) <= 1500) & ~np.eye(len(units), dtype=bool)
    k = near.sum(axis=1)
    w = near / np.maximum(k, 1)[:, None]

    def stat(v):
        z = np.array(v) - np.mean(v)
        return len(z) / w.sum() * (w * np.outer(z, z)).sum() / (z * z).sum()
    i, e = stat([u[3] for u in units]), -1 / (len(units) - 1)
    drawn = [stat([d[u[0]] for u in units]) for d in draws.values()]
    assert got.i == pytest.approx(i, abs=1e-9) and got.islands == (k == 0).sum() and got.sd_permutation == pytest.approx(np.std(drawn), abs=1e-9)
    assert got.p == pytest.approx((1 + sum(abs(x - e) >= abs(i - e) - 1e-12 for x in drawn)) / 20)
    ladder = {r["band_m"]: r for r in M.scale_ladder(df, spec, [800.0, 1500.0]).collect()}
    assert ladder[1500.0]["i"] == pytest.approx(i, abs=1e-9) and ladder[1500.0]["p"] == got.p

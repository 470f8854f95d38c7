"""Moran's I, local Moran and Gi* with reproducible permutation tests.

Units have one base order, by md5(seed | 0 | unit). Draw r sends base rank i to a rank that a keyed bijection computes (``plans.permute``), and the unit at i takes the
value of the unit there; so every draw is a permutation, no draw is sorted, and both engines can recompute it. The draws of a unit
travel as one array.

Values differ from a sequential shuffle by design; they are reproducible and order-free.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.operators.rollups import p_adjust
from terralog.operators.weights import Near, near, neighbour_totals
from terralog.plans import permute as permutes
from terralog.plans.disc import disc_products
from terralog.plans.permute import SLICE_ROWS, drawn_values, heads, in_slices, lists_of, permute, round_keys, with_draws, with_lists
from terralog.plans.ranking import hash60, hash_positions
from terralog.plans.running import Run, int_block, running
from terralog.session import cut
from terralog.spec import CONSTANT, MIN_UNITS, NO_NEIGHBOURS, TOO_FEW, StatSpec

Drawn = Callable[[np.ndarray], np.ndarray]         # ranks -> their values in every draw, a row per rank


def _digest(seed: int, draw: Column, unit: Column) -> Column:
    return hash60(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), unit.cast("string")))


def _ranked(units: DataFrame, seed: int, unit: str) -> DataFrame:
    """Add ``rank``, 0-based in the base order."""
    placed = hash_positions(units.withColumn("_h", _digest(seed, F.lit(0), F.col(unit))), [], "_h", unit, "rank")
    return placed.drop("_h").withColumn("rank", F.col("rank") - 1)


def permutation_draws(units: DataFrame, field: str, permutations: int, seed: int, unit: str = "unit_id",
                      carry: tuple[str, ...] = ()) -> DataFrame:
    """``draw, unit, pos, permuted``: every draw is a permutation of the field over the units; ``pos`` is the 1-based base position of the value.

    ``carry`` columns of the unit ride along.
    """
    rows = cut(_ranked(units.select(unit, field, *[c for c in carry if c not in (unit, field)]), seed, unit), "ranked")
    n, keys = rows.count(), round_keys(seed, permutations)

    drawn = with_lists(with_draws(rows, field, n, keys), _pos=(T.LongType(), lambda rank: permute(rank, keys, n) + 1))
    return drawn.select(unit, *carry, F.posexplode(F.arrays_zip(F.col("zs").alias("zs"), F.col("_pos").alias("_pos"))).alias("draw", "_d")).select(
        (F.col("draw") + 1).alias("draw"), unit, F.col("_d._pos").alias("pos"), F.col("_d.zs").alias("permuted"), *carry)


def admitted(units: DataFrame, spec: StatSpec) -> DataFrame:
    """Units with a finite value, centred: columns unit, lon, lat, x, z and the global n, m2."""
    v = F.col(spec.field)
    ok = units.where(v.isNotNull() & ~F.isnan(v)).select(spec.unit, "lon", "lat", v.alias("x"))
    g = ok.agg(F.struct(F.count("x").alias("n"), F.avg("x").alias("mean")).alias("g")).scalar()
    centred = ok.withColumn("_g", g).select(spec.unit, "lon", "lat", "x", (F.col("x") - F.col("_g.mean")).alias("z"))
    return cut(centred, "units")


def _edge_weight(k: Column, spec: StatSpec) -> Column:
    return F.when(k > 0, F.lit(1.0) if spec.standardization == "binary" else 1.0 / k).otherwise(0.0)


def _by_draw(rows: DataFrame, nb: Near, drawn: Drawn | None) -> DataFrame:
    """``draw, num`` = sum_ij w_ij z_i z_j of each permuted field; ``rows`` have the draws of a unit as ``zs``, or ``drawn`` gives them from its ``rank``.

    A tile of sites gives one array of sums, so no row is one draw of one unit. Units that share a site are added up first, many at a time; several rows of a site are
    as good as one, since the sum is linear in each of its two values.
    """
    shared = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    place, made = ["site", "lon", "lat", "w"], ["rank"] if drawn else ["zs"]
    tagged = rows.join(shared.hint("merge"), "site")
    crowds = tagged.where("n > 1").select(*place, "rank", *[c for c in made if c != "rank"]).repartitionByRange("site", "rank").sortWithinPartitions("site")
    many = crowds.mapInArrow(lambda batches: map(_site_sums(drawn), batches), T.StructType([*rows.select(*place).schema, T.StructField("zs", T.ArrayType(T.DoubleType()))]))
    alone = tagged.where("n = 1").select(*place, *made)
    sites = cut(alone.unionByName(many, allowMissingColumns=True), "draws")
    # every site is its own neighbour in these products; the pairs of a unit with itself go again
    tiles = disc_products(sites, nb.band_m, "site", "w", "zs", drawn=("rank", drawn) if drawn else None)
    parts = tiles.unionByName(rows.select("w", *made).mapInArrow(lambda batches: in_slices(batches, _unit_parts(drawn)), "sums array<double>"))
    return parts.select(F.posexplode("sums").alias("i", "x")).groupBy((F.col("i") + 1).alias("draw")).agg(F.sum("x").alias("num"))


def _draws_of(batch: pa.RecordBatch, drawn: Drawn | None) -> np.ndarray:
    if drawn:
        return drawn(batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)).astype(float, copy=False)
    return batch.column("zs").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)


def _site_sums(drawn: Drawn | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A batch of units in order of site as one row per site, with the sums of their draws."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        site = b.column("site").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, site[1:] != site[:-1])) if len(b) else np.zeros(0, np.int64)
        of, out = np.cumsum(np.isin(np.arange(len(b)), first)) - 1, None
        for at in range(0, len(b), SLICE_ROWS):
            zs, mine = _draws_of(b.slice(at, SLICE_ROWS), drawn), of[at:at + SLICE_ROWS]
            out = np.zeros((len(first), zs.shape[1])) if out is None else out
            starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            out[mine[starts]] += np.add.reduceat(zs, starts, axis=0)
        place = b.select(["site", "lon", "lat", "w"]).take(pa.array(first))
        return pa.RecordBatch.from_arrays([*place.columns, lists_of(out if out is not None else np.zeros((0, 0)))], names=[*place.schema.names, "zs"])
    return run


def _unit_parts(drawn: Drawn | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Per slice of units: minus the draws' sums of w z z, for the pairs of a unit with itself."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        zs = _draws_of(b, drawn)
        return pa.RecordBatch.from_arrays([lists_of(-np.einsum("q,qd,qd->d", b.column("w").to_numpy(zero_copy_only=False).astype(float), zs, zs)[None, :])], names=["sums"])
    return run


def with_field_draws(units: DataFrame, spec: StatSpec, field: str = "z") -> tuple[DataFrame, Drawn | None]:
    """Admitted units with their ``rank``, and a function of ranks that gives the field's value in every draw, so that no draw is written.

    Beyond ``LOOKUP_ROWS`` units there is no such function, and the units have the values as arrays ``zs``.
    """
    ranked = cut(_ranked(units, spec.seed, spec.unit), "ranked")
    n, keys = ranked.count(), round_keys(spec.seed, spec.permutations)
    if n <= permutes.LOOKUP_ROWS:
        return ranked, drawn_values(ranked, field, n, keys)
    return cut(with_draws(ranked, field, n, keys, lookup_rows=0), "drawn"), None


def moran(units: DataFrame, spec: StatSpec) -> DataFrame:
    """One row: I, its expectation, closed-form sd, permutation p, with status and reason."""
    spec = spec.checked()
    return _moran(*with_field_draws(admitted(units, spec), spec), spec)


def _moran(u: DataFrame, drawn: Drawn | None, spec: StatSpec) -> DataFrame:
    nb = near(u, spec.band_m, spec.unit)
    tot = neighbour_totals(nb, {"_k": F.lit(1), "_t": F.col("z")})
    k = F.col("_k") - 1
    rows = cut(nb.units.join(tot.hint("merge"), "site").withColumn("k", k).withColumn("w", _edge_weight(k, spec))
               .withColumn("num", F.col("w") * F.col("z") * (F.col("_t") - F.col("z"))), "rows")
    base = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 0).alias("islands"), F.sum("num").alias("num"),
        F.sum(F.col("k") * F.col("w")).alias("s0"), F.sum(2 * F.col("k") * F.col("w") * F.col("w")).alias("s1"),
        F.sum(F.pow(2 * F.col("k") * F.col("w"), 2)).alias("s2"),
        F.sum(F.pow("z", 2)).alias("m2"), F.sum(F.pow("z", 4)).alias("m4"))
    draws = _by_draw(rows, nb, drawn)
    scale = base.select(F.struct("n", "s0", "m2", "num").alias("b")).scalar()
    ref = draws.withColumn("_b", scale).select(
        F.try_divide(F.col("_b.n") * F.col("num"), F.col("_b.s0") * F.col("_b.m2")).alias("i_r"),
        F.try_divide(F.col("_b.n") * F.col("_b.num"), F.col("_b.s0") * F.col("_b.m2")).alias("i"), F.try_divide(F.lit(-1.0), F.col("_b.n") - 1).alias("e"))
    hits = ref.agg(F.count_if(F.abs(F.col("i_r") - F.col("e")) >= F.abs(F.col("i") - F.col("e")) - 1e-12).alias("h"),
                   F.stddev_pop("i_r").alias("sd"))
    return finish_moran(base.withColumn("_h", hits.select(F.struct("h", "sd").alias("s")).scalar()), spec)


def finish_moran(base: DataFrame, spec: StatSpec) -> DataFrame:
    n, s0, s1, s2 = (F.col(c).cast("double") for c in ("n", "s0", "s1", "s2"))
    e = F.try_divide(F.lit(-1.0), n - 1)
    b2 = F.try_divide(n * F.col("m4"), F.pow("m2", 2))
    var = F.try_divide(n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0),
                       (n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    reason = (F.when(F.col("n") < MIN_UNITS, TOO_FEW).when(F.coalesce(F.col("m2"), F.lit(0.0)) == 0, CONSTANT)
              .when(F.coalesce(F.col("s0"), F.lit(0.0)) == 0, NO_NEIGHBOURS))
    ok = reason.isNull()
    return base.select(
        "n", "islands", F.when(ok, F.try_divide(n * F.col("num"), s0 * F.col("m2"))).alias("i"), F.when(ok, e).alias("expected"),
        F.when(ok & (var > 0), F.sqrt(var)).alias("sd_closed"), F.when(ok, F.col("_h.sd")).alias("sd_permutation"),
        F.when(ok, (F.col("_h.h") + 1) / (spec.permutations + 1)).alias("p"),
        F.when(ok, "succeeded").otherwise("not_applicable").alias("status"), reason.alias("reason"))


def _conditional(units: DataFrame, spec: StatSpec, value: str) -> DataFrame:
    """Per unit the observed neighbour total ``others`` and how it stands against the draws.

    Draw r supplies the first k values of its order that are not the unit itself: the running sum
    at k, or the sum at k+1 minus the own value when the unit stands among the first k. Only the
    head of each draw up to the largest k is made, and only the neighbour counts that occur are
    kept, so nothing is units x neighbours x draws.

    Adds ``mean`` and ``sd`` of the permuted totals, ``far`` (draws at least as far from the mean)
    and ``large`` (draws at least as large in size).
    """
    nb = near(units, spec.band_m, spec.unit)
    tot = neighbour_totals(nb, {"_k": F.lit(1), "_t": F.col(value)})
    rows = cut(nb.units.join(tot.hint("merge"), "site").withColumn("k", F.col("_k") - 1)
               .withColumn("others", F.col("_t") - F.col(value)).drop("_k", "_t"), "rows")
    n, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0))).first()
    drawn = cut(_heads(rows, spec, value, n, min(most + 1, n)), "heads")
    sizes = rows.where("k > 0").select("k").distinct()
    wanted = sizes.select(F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("pos")).distinct()
    prefix = cut(drawn.join(wanted, "pos", "left_semi").groupBy("pos").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("draw", "prefix"))), lambda s: s["prefix"]).alias("sums")), "prefix")
    among = (drawn.select(spec.unit, "draw", "pos").join(rows.where("k > 0").select(spec.unit, "k"), spec.unit)
             .where("pos <= k").groupBy(spec.unit).agg(F.collect_set("draw").alias("inside")))
    at_k = prefix.select(F.col("pos").alias("k"), F.col("sums").alias("at_k"))
    after = prefix.select((F.col("pos") - 1).alias("k"), F.col("sums").alias("after_k"))
    joined = rows.join(at_k, "k", "left").join(after, "k", "left").join(among, spec.unit, "left")
    stats = _against_draws("at_k", "after_k", "inside", value, "others")
    return joined.withColumn("_s", stats).select(*rows.columns, "_s.*")


def _heads(units: DataFrame, spec: StatSpec, value: str, n: int, most: int) -> DataFrame:
    """``unit, draw, pos, prefix`` of the first ``most`` positions of every draw; the bijection tells who stands there."""
    ranked = cut(_ranked(units.select(spec.unit, value), spec.seed, spec.unit), "ranked")
    placed = heads(units.sparkSession, n, most, round_keys(spec.seed, spec.permutations)).join(ranked, "rank").drop("rank")
    return running(placed, ["draw"], ["pos"], int_block("pos"), [Run("prefix", "sum", F.col(value))])


_DRAW_STATS = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType()),
                            T.StructField("far", T.IntegerType()), T.StructField("large", T.IntegerType())])


@F.pandas_udf(_DRAW_STATS)
def _against_draws(at_k: pd.Series, after_k: pd.Series, inside: pd.Series, own: pd.Series, observed: pd.Series) -> pd.DataFrame:
    out = np.full((len(own), 4), np.nan)
    has = np.flatnonzero(at_k.notna().to_numpy())
    for at in range(0, len(has), 4096):
        idx = has[at:at + 4096]
        sums = np.stack(at_k.iloc[idx].to_list())
        # where the unit stands among the first k itself: one value more, without its own
        met = [(row, i) for row, i in enumerate(idx) if inside.iloc[i] is not None]
        if met:
            at_row = np.repeat([row for row, _ in met], [len(inside.iloc[i]) for _, i in met])
            of_met = np.repeat(np.arange(len(met)), [len(inside.iloc[i]) for _, i in met])
            draw = np.concatenate([inside.iloc[i] for _, i in met]).astype(int) - 1
            more = np.stack([after_k.iloc[i] for _, i in met]) - own.iloc[[i for _, i in met]].to_numpy()[:, None]
            sums[at_row, draw] = more[of_met, draw]
        seen = observed.iloc[idx].to_numpy()[:, None]
        mean = sums.mean(axis=1)
        out[idx, 0], out[idx, 1] = mean, sums.std(axis=1)
        out[idx, 2] = (np.abs(sums - mean[:, None]) >= np.abs(seen - mean[:, None]) - 1e-9).sum(axis=1)
        out[idx, 3] = (np.abs(sums) >= np.abs(seen) - 1e-9).sum(axis=1)
    frame = pd.DataFrame(out, columns=["mean", "sd", "far", "large"])
    return frame.astype({"far": "Int32", "large": "Int32"})


def _applicable(df: DataFrame) -> DataFrame:
    """Attach the refusal reason of the whole field."""
    g = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("m2"), F.sum("k").alias("k")).alias("g")).scalar()
    d = df.withColumn("_g", g)
    reason = (F.when(F.col("_g.n") < MIN_UNITS, TOO_FEW).when(F.col("_g.m2") == 0, CONSTANT).when(F.col("_g.k") == 0, NO_NEIGHBOURS))
    return d.withColumn("m2", F.try_divide(F.col("_g.m2"), F.col("_g.n"))).withColumn("reason", F.coalesce(reason, F.when(F.col("k") == 0, "island"))).drop("_g")


def _significance(df: DataFrame, spec: StatSpec) -> DataFrame:
    done = cut(df, "tested")
    adj = p_adjust(cut(done.where("p IS NOT NULL").select("p"), "p"), "p", spec.correction)
    return done.join(adj, "p", "left").withColumn("significant", F.coalesce(F.col("p_adj") <= spec.alpha, F.lit(False)))


def lisa(units: DataFrame, spec: StatSpec) -> DataFrame:
    """Local I per unit with conditional permutation p, corrected significance and quadrant."""
    spec = spec.checked()
    d = _applicable(_conditional(admitted(units, spec), spec, "z"))
    d = d.withColumn("lag", _edge_weight(F.col("k"), spec) * F.col("others"))
    d = d.withColumn("local_i", F.try_divide(F.col("z") * F.col("lag"), F.col("m2")))
    # |I_r| >= |I| is |permuted total| >= |observed total|: z, w and m2 are held fixed.
    ok = F.col("reason").isNull()
    far = F.when(F.col("z") == 0, F.lit(spec.permutations)).otherwise(F.col("large"))
    d = _significance(d.withColumn("p", F.when(ok, (far + 1) / F.lit(spec.permutations + 1))), spec)
    side = F.concat(F.when(F.col("z") >= 0, "H").otherwise("L"), F.when(F.col("lag") >= 0, "H").otherwise("L"))
    return d.select(spec.unit, "k", F.when(ok, F.col("local_i")).alias("local_i"), "p", "p_adj", F.when(ok, side).alias("quadrant"),
                    "significant", F.when(ok, "succeeded").otherwise("not_applicable").alias("status"), "reason")


def hotspot(units: DataFrame, spec: StatSpec) -> DataFrame:
    """Gi* per unit: own value included, z against the draws, hot/cold label after correction."""
    spec = spec.checked()
    d = _applicable(_conditional(admitted(units, spec), spec, "x"))
    ok = F.col("reason").isNull() & (F.col("sd") > 0)
    d = _significance(d.withColumn("gi_star", F.when(ok, F.col("others") + F.col("x"))).withColumn(
        "z_score", F.when(ok, (F.col("others") - F.col("mean")) / F.col("sd"))).withColumn(
        "p", F.when(ok, (F.col("far") + 1) / F.lit(spec.permutations + 1))), spec)
    label = F.when(~F.col("significant"), "none").when(F.col("z_score") > 0, "hot").otherwise("cold")
    return d.select(spec.unit, "k", "gi_star", "z_score", "p", "p_adj", label.alias("label"),
                    F.when(F.col("gi_star").isNotNull(), "succeeded").otherwise("not_applicable").alias("status"), "reason")


def scale_ladder(units: DataFrame, spec: StatSpec, bands: list[float]) -> DataFrame:
    """Moran's I at each declared band, all with the same draws; ``sign_agreement`` is false when signs differ."""
    from dataclasses import replace
    ranked, drawn = with_field_draws(admitted(units, spec.checked()), spec)
    rungs = [_moran(ranked, drawn, replace(spec, band_m=b).checked()).withColumn("band_m", F.lit(float(b))) for b in bands]
    all_ = cut(reduce(DataFrame.unionByName, rungs), "rungs")
    signs = all_.agg(F.count_distinct(F.signum("i")).alias("c")).scalar()
    return all_.select("band_m", "n", "islands", "i", "p", "status").withColumn("sign_agreement", signs <= 1)

"""Distance joins by latitude-aware grid cells instead of all pairs.

Cells have height ``h`` and, per latitude row, the longitude step that keeps them at least
``h`` wide at the row's most poleward edge, wrapping at the antimeridian. The probing side
looks into the neighbouring cells; the equi-join is on (row, column, chunk).

A dense cell is cut into chunks of at most ``CHUNK`` points: its points are dealt to chunks by
hash and every probe visits each chunk. Probes of a cell beyond ``PROBES`` are dealt to parts, which
each have their own copy of the chunk, so no cell becomes one task. A probe is there for every neighbouring
cell, so parts come first: a copy of the points is smaller than one of the probes. Only ids and places are shuffled. Counts per cell are written first;
they also tell how many pairs are to be tested, and the join has a task for ``TASK_PAIRS`` of them
whatever the size of its input, which adaptive execution would put into few tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, haversine
from terralog.session import cut

CHUNK = 1 << 14
PROBES = 1 << 14
TASK_PAIRS = 1 << 22               # pairs tested by one task, on average
MAX_TASKS = 1 << 14
CHORD_SLACK = 1e-13                # well over the rounding of a chord on the unit sphere
_MAX_LAT = 89.9


def row_of(lat: Column, h_deg: float) -> Column:
    return F.floor((lat + 90.0) / h_deg).cast("long")


def cols_in_row(row: Column, h_deg: float) -> Column:
    """Number of cells around the globe in a latitude row."""
    south = row * h_deg - 90.0
    edge = F.least(F.greatest(F.abs(south), F.abs(south + h_deg)), F.lit(_MAX_LAT))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / h_deg)).cast("long")


def col_of(lon: Column, row: Column, h_deg: float) -> Column:
    n = cols_in_row(row, h_deg)
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n).cast("long")


def with_cell(df: DataFrame, lon: str, lat: str, h_deg: float) -> DataFrame:
    d = df.withColumn("_row", row_of(F.col(lat), h_deg))
    return d.withColumn("_col", col_of(F.col(lon), F.col("_row"), h_deg))


def neighbour_cells(lon: Column, lat: Column, radius_m: float, h_deg: float) -> Column:
    """Array of ``struct<_row,_col>`` covering the cap of ``radius_m`` around the point."""
    r_deg = radius_m / METRES_PER_DEGREE * 1.000001
    ang = math.radians(r_deg)
    rows = F.sequence(row_of(F.greatest(lat - r_deg, F.lit(-90.0)), h_deg),
                      row_of(F.least(lat + r_deg, F.lit(90.0)), h_deg))
    ratio = F.lit(math.sin(min(ang, math.pi / 2))) / F.cos(F.radians(lat))
    reach = F.when(F.abs(lat) + r_deg >= _MAX_LAT, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))

    def row_cells(r: Column) -> Column:
        n = cols_in_row(r, h_deg)
        lo = F.floor((lon - reach + 180.0) / 360.0 * n).cast("long")
        hi = F.least(F.floor((lon + reach + 180.0) / 360.0 * n).cast("long"), lo + n - 1)
        return F.transform(F.sequence(lo, hi), lambda c: F.struct(r.alias("_row"), F.pmod(c, n).cast("long").alias("_col")))
    return F.flatten(F.transform(rows, row_cells))


def whole_cell_near(row: Column, radius_m: float, h_deg: float) -> Column:
    """True when any two points of one cell in this row are surely within ``radius_m``.

    The bound takes the widest longitude step at the row's most equatorward latitude.
    """
    south = row * h_deg - 90.0
    crosses = (south <= 0) & (south + h_deg >= 0)
    flat = F.when(crosses, F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(south + h_deg)))
    dlon = F.radians(360.0 / cols_in_row(row, h_deg)) / 2
    h = math.sin(math.radians(h_deg) / 2) ** 2 + F.pow(F.cos(F.radians(flat)) * F.sin(F.least(dlon, F.lit(math.pi / 2))), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))) <= radius_m


def _with_unit_vector(df: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """Add the place on the unit sphere as columns ``name`` x, y and z."""
    lam, phi = F.radians(lon), F.radians(lat)
    return df.withColumns({f"{name}x": F.cos(phi) * F.cos(lam), f"{name}y": F.cos(phi) * F.sin(lam), f"{name}z": F.sin(phi)})


def grid_pairs(left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str,
               cells_per_radius: float = 1.0, chunk: int = CHUNK, skip_own: bool = False,
               bins: tuple[str, int] | None = None, once: bool = False) -> DataFrame:
    """Pairs within ``radius_m``: all left columns, right columns prefixed ``r_``, and ``dist_m``.

    Both sides carry ``lon`` and ``lat``. With ``skip_own`` the pairs inside one cell are left
    out wherever ``whole_cell_near`` holds, for callers that add those from cell totals.
    ``bins = (column, reach)`` also asks that an integer bin differs by at most ``reach``.
    ``once`` is for a table joined with itself, in which two points meet once, in either order, and none itself: a point looks only into its own and later cells.
    """
    h = radius_m / cells_per_radius / METRES_PER_DEGREE
    keys = ["_row", "_col"] + (["_bin"] if bins else [])
    target = with_cell(right, "lon", "lat", h)
    if bins:
        target = target.withColumn("_bin", F.col(bins[0]))
    cells = neighbour_cells(F.col("lon"), F.col("lat"), radius_m, h)
    if skip_own:
        own_row = row_of(F.col("lat"), h)
        own_col = col_of(F.col("lon"), own_row, h)
        near = whole_cell_near(own_row, radius_m, h)
        cells = F.filter(cells, lambda c: ~(near & (c["_row"] == own_row) & (c["_col"] == own_col)))
    if once:
        here = F.struct(row_of(F.col("lat"), h).alias("_row"), col_of(F.col("lon"), row_of(F.col("lat"), h), h).alias("_col"))
        cells = F.filter(cells, lambda c: c >= here)
    probe = (left.withColumn("_cell", F.explode(cells))
             .select(*left.columns, "_cell._row", "_cell._col"))
    if bins:
        probe = probe.withColumn("_bin", F.explode(F.sequence(F.col(bins[0]) - bins[1], F.col(bins[0]) + bins[1])))
    counts = cut(target.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(
        probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("_probes")), keys, "left").withColumn("_probes", F.coalesce("_probes", F.lit(0).cast("long"))), "cells")
    tested = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_probes"))).first()[0] or 0.0
    tasks = min(max(math.ceil(tested / TASK_PAIRS), 1), MAX_TASKS)
    dense = counts.where((F.col("_n") > chunk) | (F.col("_probes") > PROBES)).select(
        *keys, F.ceil(F.col("_n") / F.lit(chunk)).cast("int").alias("_chunks"), F.greatest(F.ceil(F.col("_probes") / F.lit(PROBES)), F.lit(1)).cast("int").alias("_parts"))

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1))
    target = (target.join(dense, keys, "left")
              .withColumn("_chunk", F.pmod(F.xxhash64(F.col(right_id)), F.coalesce(F.col("_chunks"), F.lit(1))).cast("int")).withColumn("_part", numbers("_parts"))
              .select(*keys, "_chunk", "_part", *[F.col(c).alias(f"r_{c}") for c in right.columns]))
    probe = (probe.join(dense, keys, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(left_id), F.lit(1)), F.coalesce(F.col("_parts"), F.lit(1))).cast("int"))
             .withColumn("_chunk", numbers("_chunks")).select(*keys, "_chunk", "_part", *left.columns))
    keys += ["_chunk", "_part"]
    probe = _with_unit_vector(probe.repartition(tasks, *keys), "lon", "lat", "_p")
    if once:
        row = row_of(F.col("lat"), h)
        probe = probe.withColumn("_own", (F.col("_row") == row) & (F.col("_col") == col_of(F.col("lon"), row, h)))
    pairs = probe.join(_with_unit_vector(target.repartition(tasks, *keys), "r_lon", "r_lat", "_t"), keys)
    if once:
        one, other = F.col(left_id), F.col(f"r_{right_id}")
        pairs = pairs.where(F.when(F.col("_own"), one < other).otherwise(one != other))
    dist = haversine(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    # the chord decides but for a thin rim, so only pairs that are kept pay for the distance
    chord = sum(((F.col(f"_p{a}") - F.col(f"_t{a}")) * (F.col(f"_p{a}") - F.col(f"_t{a}")) for a in "yz"), (F.col("_px") - F.col("_tx")) * (F.col("_px") - F.col("_tx")))
    reach = 2 * math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2)
    surely = F.lit((reach - CHORD_SLACK) ** 2 if reach > CHORD_SLACK else -1.0)
    near = (chord <= surely) | (((chord <= F.lit((reach + CHORD_SLACK) ** 2)) | F.isnan(chord)) & (dist <= radius_m))
    return pairs.where(near).withColumn("dist_m", dist).select(*left.columns, *[f"r_{c}" for c in right.columns], "dist_m")

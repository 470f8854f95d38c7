"""Elevation lattices: slope, contours, sampling, sight lines and viewsheds.

A surface is ``gx, gy, elev``. Neighbourhoods are built by sending each node to the cells it
belongs to and grouping once, instead of joining the surface with itself per neighbour.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.geo import EARTH_RADIUS_M
from terralog.session import cut

MAX_RADIUS_CELLS = 512
REFRACTION = 0.13


def slope(surface: DataFrame, spacing_m: float) -> DataFrame:
    """Horn 3x3 slope in degrees for nodes with all eight neighbours."""
    horn = {(-1, -1): (-1, -1), (0, -1): (0, -2), (1, -1): (1, -1), (-1, 0): (-2, 0), (0, 0): (0, 0), (1, 0): (2, 0),
            (-1, 1): (-1, 1), (0, 1): (0, 2), (1, 1): (1, 1)}
    parts = F.array(*[F.struct((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), (F.col("elev") * wx).alias("wx"), (F.col("elev") * wy).alias("wy"))
                      for (dx, dy), (wx, wy) in horn.items()])
    g = surface.select(F.inline(parts)).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.sum("wx").alias("x"), F.sum("wy").alias("y")).where("n = 9")
    rise = F.sqrt(F.pow(F.col("x") / (8 * spacing_m), 2) + F.pow(F.col("y") / (8 * spacing_m), 2))
    return g.select("gx", "gy", F.degrees(F.atan(rise)).alias("slope_deg"))


def corners(surface: DataFrame) -> DataFrame:
    """Per complete cell its four corner elevations: a (0,0), b (1,0), c (1,1), d (0,1)."""
    at = {"a": (0, 0), "b": (1, 0), "c": (1, 1), "d": (0, 1)}
    parts = F.array(*[F.struct((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.lit(k).alias("k"), F.col("elev").alias("elev")) for k, (dx, dy) in at.items()])
    g = surface.select(F.inline(parts)).groupBy("gx", "gy").agg(*[F.max(F.when(F.col("k") == k, F.col("elev"))).alias(k) for k in at])
    return g.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")


def contours(surface: DataFrame, levels: list[float]) -> DataFrame:
    """Segments per cell and level with interpolated ends; a saddle is split by its centre value."""
    c = corners(surface).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    L = F.col("level")
    a, b, cc, d = (F.col(k) for k in "abcd")

    def cross(p: Column, q: Column, x: Column, y: Column) -> Column:
        return F.when((p >= L) != (q >= L), F.struct(x.alias("x"), y.alias("y")))

    def part(p: Column, q: Column) -> Column:
        return (L - p) / (q - p)
    gx, gy = F.col("gx"), F.col("gy")
    e = {"s": cross(a, b, gx + part(a, b), gy + F.lit(0.0)), "e": cross(b, cc, gx + F.lit(1.0), gy + part(b, cc)),
         "n": cross(d, cc, gx + part(d, cc), gy + F.lit(1.0)), "w": cross(a, d, gx + F.lit(0.0), gy + part(a, d))}
    c = c.select("gx", "gy", "level", ((a >= L) == ((a + b + cc + d) / 4 >= L)).alias("joined"), *[v.alias(k) for k, v in e.items()])
    hits = F.filter(F.array("s", "e", "n", "w"), lambda v: v.isNotNull())

    def seg(p, q):
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    one = F.array(seg(F.element_at(hits, 1), F.element_at(hits, 2)))
    # saddle: corner a on the side of the centre keeps a and c connected, so the lines cut off b and d
    two = F.when(F.col("joined"), F.array(seg(F.col("s"), F.col("e")), seg(F.col("n"), F.col("w")))).otherwise(
        F.array(seg(F.col("s"), F.col("w")), seg(F.col("e"), F.col("n"))))
    segs = F.when(F.size(hits) == 2, one).when(F.size(hits) == 4, two)
    return c.select("gx", "gy", "level", F.inline(segs))


def _bilinear(fx: Column, fy: Column) -> Column:
    return (F.col("a") * (1 - fx) * (1 - fy) + F.col("b") * fx * (1 - fy) + F.col("c") * fx * fy + F.col("d") * (1 - fx) * fy)


def sample(surface: DataFrame, points: DataFrame) -> DataFrame:
    """Bilinear elevation at ``x, y`` (lattice units); off-grid points are named."""
    p = points.withColumn("gx", F.floor("x").cast("int")).withColumn("gy", F.floor("y").cast("int"))
    j = p.join(corners(surface), ["gx", "gy"], "left")
    h = _bilinear(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))
    return j.withColumn("elev", h).withColumn("issue", F.when(F.col("a").isNull(), "off-surface")).drop("gx", "gy", "a", "b", "c", "d")


def line_of_sight(surface: DataFrame, lines: DataFrame, spacing_m: float, interval: float, accuracy_m: float = 0.0, curvature: bool = False,
                  observer_m: float = 2.0, target_m: float = 0.0, key: list[str] | None = None, obstacles: DataFrame | None = None) -> DataFrame:
    """Verdict per line ``x1, y1, x2, y2`` (lattice units).

    Samples every ``interval`` lattice units, ends excluded; an obstacle (``gx, gy, height``) raises
    its cell. blocked: a sample rises above the sight line by more than the accuracy; indeterminate:
    a sample grazes within it; outside: an end or sample leaves the surface.
    """
    key = key or ["line_id"]
    cells = corners(surface)
    if obstacles is not None:
        tall = obstacles.groupBy("gx", "gy").agg(F.max("height").alias("_o"))
        cells = cells.join(tall, ["gx", "gy"], "left")
    else:
        cells = cells.withColumn("_o", F.lit(None).cast("double"))
    span = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    steps = F.greatest(F.ceil(F.col("span") / interval), F.lit(1)).cast("int")
    d = lines.withColumn("span", span).withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    f = F.col("i") / F.col("steps")
    d = d.withColumn("f", f).withColumn("sx", F.col("x1") + (F.col("x2") - F.col("x1")) * f).withColumn("sy", F.col("y1") + (F.col("y2") - F.col("y1")) * f)
    d = d.withColumn("gx", F.floor("sx").cast("int")).withColumn("gy", F.floor("sy").cast("int"))
    j = d.join(cells, ["gx", "gy"], "left")
    ground = _bilinear(F.col("sx") - F.col("gx"), F.col("sy") - F.col("gy"))
    j = j.withColumn("ground", ground).withColumn("dist", F.col("f") * F.col("span") * spacing_m)
    ends = j.groupBy(*key).agg(
        F.max(F.when(F.col("i") == 0, F.col("ground"))).alias("z1"), F.max(F.when(F.col("i") == F.col("steps"), F.col("ground"))).alias("z2"),
        F.bool_or(F.col("ground").isNull()).alias("outside"))
    total = F.col("span") * spacing_m
    bulge = (F.col("dist") * (total - F.col("dist")) / (2 * EARTH_RADIUS_M) * (1 - REFRACTION)) if curvature else F.lit(0.0)
    sight = F.col("z1") + observer_m + (F.col("z2") + target_m - F.col("z1") - observer_m) * F.col("f")
    top = F.col("ground") + F.coalesce("_o", F.lit(0.0)) + bulge
    m = j.where("i > 0 AND i < steps").join(ends.select(*key, "z1", "z2"), key).withColumn("clear", sight - top)
    blocked = F.col("clear") < -accuracy_m
    per = m.groupBy(*key).agg(
        F.coalesce(F.bool_or(blocked), F.lit(False)).alias("blocked"), F.coalesce(F.bool_or(F.abs(F.col("clear")) <= accuracy_m), F.lit(False)).alias("grazes"),
        F.min(F.when(blocked, F.struct(F.col("dist").alias("d"), F.when(F.coalesce("_o", F.lit(0.0)) > 0, "obstacle").otherwise("terrain").alias("source")))).alias("first"),
        F.min("clear").alias("min_clearance"))
    out = ends.join(per, key, "left")
    verdict = (F.when(F.col("outside"), "outside").when(F.col("blocked"), "blocked").when(F.col("grazes"), "indeterminate").otherwise("visible"))
    ok = ~F.col("outside")
    return out.select(*key, verdict.alias("status"), F.when(ok, F.col("first.d")).alias("first_obstruction_m"),
                      F.when(ok, F.col("first.source")).alias("source"), F.when(ok, F.col("min_clearance")).alias("min_clearance"))


VIEW = "t int, status string, first_obstruction_m double, source string, min_clearance double"
VIEW_ROWS = 1 << 17                # targets of the observers that share a tile in one group
MAX_TASKS = 1 << 12


def _heights(cells: pd.DataFrame, low_x: int, low_y: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Node elevations and obstacle heights of a tile as arrays; NaN where there is no node."""
    grid, tall = np.full((width, height), -np.inf), np.zeros((width, height))
    at = cells["gx"].to_numpy(np.int64) - low_x, cells["gy"].to_numpy(np.int64) - low_y
    np.maximum.at(grid, at, cells["elev"].to_numpy(float))
    np.maximum.at(tall, at, cells["height"].to_numpy(float))
    return np.where(np.isneginf(grid), np.nan, grid), tall


def _ground(grid: np.ndarray, low: tuple[int, int], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bilinear elevation (NaN off the surface) and the cell of each place in a tile that begins at ``low``."""
    ix, iy = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - ix, y - iy
    ix, iy = ix - low[0], iy - low[1]
    a, b, c, d = grid[ix, iy], grid[ix + 1, iy], grid[ix + 1, iy + 1], grid[ix, iy + 1]
    return a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + c * fx * fy + d * (1 - fx) * fy, ix, iy


def _sweep(grid: np.ndarray, tall: np.ndarray, x: float, y: float, low: tuple[int, int], radius: int, spacing_m: float, interval: float, accuracy_m: float, curvature: bool,
           observer_m: float, target_m: float) -> pd.DataFrame:
    """All targets of one observer at once: the sight lines grow outward together, one sample a round, the longest first, so that finished ones are cut off the end."""
    side = 2 * radius + 1
    t = np.arange(side * side)
    dx, dy = t % side - radius, t // side - radius
    r2 = dx * dx + dy * dy
    t = t[(r2 > 0) & (r2 <= radius * radius)]
    x2, y2 = x + (t % side - radius), y + (t // side - radius)
    span = np.sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))
    steps = np.maximum(np.ceil(span / interval), 1).astype(np.int64)
    order = np.argsort(-steps, kind="stable")
    t, x2, y2, span, steps = t[order], x2[order], y2[order], span[order], steps[order]
    z1 = _ground(grid, low, np.array([x]), np.array([y]))[0][0]
    z2 = _ground(grid, low, x2, y2)[0]
    outside, blocked, grazes = np.isnan(z2), np.zeros(len(t), bool), np.zeros(len(t), bool)
    first, by_obstacle, least = np.full(len(t), np.nan), np.zeros(len(t), bool), np.full(len(t), np.inf)
    for i in range(1, int(steps[0])):
        n = int(np.searchsorted(-steps, -i))          # lines of more than i steps
        f = i / steps[:n]
        ground, ix, iy = _ground(grid, low, x + (x2[:n] - x) * f, y + (y2[:n] - y) * f)
        height = tall[ix, iy]
        dist = f * span[:n] * spacing_m
        total = span[:n] * spacing_m
        bulge = dist * (total - dist) / (2 * EARTH_RADIUS_M) * (1 - REFRACTION) if curvature else 0.0
        clear = z1 + observer_m + (z2[:n] + target_m - z1 - observer_m) * f - (ground + height + bulge)
        hides = clear < -accuracy_m
        new = hides & ~blocked[:n]
        first[:n][new], by_obstacle[:n][new] = dist[new], height[new] > 0
        blocked[:n] |= hides
        grazes[:n] |= np.abs(clear) <= accuracy_m
        outside[:n] |= np.isnan(ground)
        least[:n] = np.fmin(least[:n], clear)
    status = np.select([outside, blocked, grazes], ["outside", "blocked", "indeterminate"], "visible")
    source = np.where(outside | ~blocked, None, np.where(by_obstacle, "obstacle", "terrain"))
    return pd.DataFrame({"t": t, "status": status, "first_obstruction_m": np.where(outside, np.nan, first), "source": source, "min_clearance": np.where(outside | np.isinf(least), np.nan, least)})


def viewshed(surface: DataFrame, observers: DataFrame, radius: int, spacing_m: float, interval: float = 1.0, accuracy_m: float = 0.0, curvature: bool = False, observer_m: float = 2.0,
             target_m: float = 0.0, obstacles: DataFrame | None = None, view_rows: int = VIEW_ROWS) -> DataFrame:
    """Verdict per target of the row-major lattice around each observer (``obs_id, x, y``), as ``line_of_sight`` gives it for the line to the target.

    The surface goes to tiles twice as wide as the reach, with a halo of the reach, so a node is in four tiles at most, and only tiles with observers
    are kept; observers of a crowded tile are dealt to several copies of it. Rows grow with nodes and targets: samples of a sight line never become rows. An observer off the
    surface, or without a place, has one row, status ``refused`` without a target.
    """
    if not 0 < radius <= MAX_RADIUS_CELLS:
        raise ValueError("radius-bound")
    halo = radius + 2
    side = 2 * halo
    per = max(1, view_rows // (4 * radius * radius))
    kind = observers.schema["obs_id"].dataType.simpleString()
    place = observers.select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    tiled = place.where(known).select("*", F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty"))
    copies = cut(tiled.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("copies")), "copies")
    # rows are small and views are not, so a task for each group rather than for so many bytes
    tasks = min(max(copies.agg(F.sum("copies")).first()[0] or 1, 1), MAX_TASKS)
    seats = tiled.join(copies, ["tx", "ty"]).withColumn("copy", F.pmod(F.xxhash64("obs_id", "x", "y"), F.col("copies")).cast("int")).drop("copies")
    nodes = surface.select("gx", "gy", F.col("elev").cast("double").alias("elev"))
    if obstacles is None:
        nodes = nodes.withColumn("height", F.lit(0.0))
    else:
        nodes = nodes.join(obstacles.groupBy("gx", "gy").agg(F.max("height").cast("double").alias("height")), ["gx", "gy"], "left").withColumn("height", F.coalesce("height", F.lit(0.0)))

    def reach(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    spread = nodes.where("elev IS NOT NULL").withColumn("tx", reach("gx")).withColumn("ty", reach("gy"))
    spread = spread.join(copies, ["tx", "ty"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    options = (radius, spacing_m, interval, accuracy_m, curvature, observer_m, target_m)

    def look(key: tuple, seats: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * side - halo, int(key[1]) * side - halo
        grid, tall = _heights(cells, *low, side + 2 * halo + 2, side + 2 * halo + 2)
        views = []
        for obs, x, y in seats[["obs_id", "x", "y"]].itertuples(index=False):
            off = np.isnan(_ground(grid, low, np.array([x]), np.array([y]))[0][0])
            view = pd.DataFrame({"t": pd.array([None], dtype="Int32"), "status": ["refused"]}) if off else _sweep(grid, tall, x, y, low, *options)
            views.append(view.assign(obs_id=obs))
        columns = ["obs_id", *(c.split()[0] for c in VIEW.split(", "))]
        return pd.concat([v.reindex(columns=columns) for v in views]).astype({"t": "Int32", "source": object}) if views else pd.DataFrame(columns=columns)
    keys = ("tx", "ty", "copy")
    seen = seats.repartition(tasks, *keys).groupBy(*keys).cogroup(spread.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(look, f"obs_id {kind}, {VIEW}")
    lost = place.where(~known).select("obs_id", F.lit(None).cast("int").alias("t"), F.lit("refused").alias("status"))
    return seen.unionByName(lost, allowMissingColumns=True)


def sampled_viewshed(surface: DataFrame, observers: DataFrame, radius: int, spacing_m: float, interval: float = 1.0, **sight) -> DataFrame:
    """The same verdicts by one row per sample, for small reaches: what ``viewshed`` is held against."""
    side = 2 * radius + 1
    stands = sample(surface, observers).select(*observers.columns, F.col("issue").isNotNull().alias("_off"))
    refused = stands.where("_off").select("obs_id", F.lit(None).cast("int").alias("t"), F.lit("refused").alias("status"))
    t = stands.where("NOT _off").drop("_off").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    dx, dy = (F.col("t") % side - radius), (F.floor(F.col("t") / side) - radius)
    lines = t.select("obs_id", "t", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + dx).alias("x2"), (F.col("y") + dy).alias("y2"),
                     (dx * dx + dy * dy).alias("r2")).where((F.col("r2") <= radius * radius) & (F.col("r2") > 0)).drop("r2")
    return line_of_sight(surface, lines, spacing_m, interval, key=["obs_id", "t"], **sight).unionByName(refused, allowMissingColumns=True)


def tallies(view: DataFrame) -> DataFrame:
    """Counts of targets per observer; one off the surface has none and is counted as refused."""
    named = ("visible", "blocked", "indeterminate", "outside", "refused")
    return view.groupBy("obs_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in named], F.count("t").alias("targets"))


def spacing_degrees(metres: float) -> float:
    return math.degrees(metres / EARTH_RADIUS_M)

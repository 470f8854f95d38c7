"""Totals over all points within a distance, without a row per pair.

Points lie in tiles; each tile is one group of its own points and the queries that reach it. Inside a group the points are sorted by narrow strips of latitude
and by longitude. For one query and one strip the points surely inside form one run, whose total is a difference of running sums; only those near the rim are tested
one by one. So a query costs strips and rim points, the square root of its neighbours each, and memory is that of a tile. A tile over ``CHUNK`` points or queries is cut,
and the partial totals add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE
from terralog.plans.grid import neighbour_cells, with_cell
from terralog.session import cut

CHUNK = 1 << 16                    # points or queries of one group
PER_TILE = 1 << 13                 # points wanted in a tile, on average
TESTED = 1 << 21                   # pairs tested at once
_MAX_TILE_DEG = 45.0


def metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """``functions.geo.haversine`` on arrays."""
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def spans(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = TESTED):
    """``query, place`` of all places of the half-open runs, at most about ``most`` at a time."""
    some = hi > lo
    q, lo, n = q[some], lo[some], (hi - lo)[some]
    ends = np.cumsum(n)
    at = 0
    while at < len(q):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        c = n[at:to]
        first = np.repeat(lo[at:to] - (np.cumsum(c) - c), c)
        yield np.repeat(q[at:to], c), first + np.arange(len(first))
        at = to


class Disc:
    """Points in order of strip and longitude (``order``), asked for runs within the radius."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, radius_m: float):
        self.radius, self.reach = radius_m, math.degrees(radius_m / EARTH_RADIUS_M)
        wide, high = (np.ptp(lon), np.ptp(lat)) if len(lon) else (0.0, 0.0)
        area = max(wide * math.cos(math.radians(float(np.mean(lat)) if len(lat) else 0.0)), self.reach) * max(high, self.reach)
        near = len(lon) * math.pi * self.reach ** 2 / area
        self.step = 2 * self.reach / min(max(math.sqrt(0.64 * near), 4.0), 512.0)
        self.south = float(lat.min()) if len(lat) else 0.0
        strip = np.floor((lat - self.south) / self.step).astype(np.int64)
        turned = (lon + 180.0) % 360.0 - 180.0
        self.order = np.lexsort((turned, strip))
        self.lon, self.lat = lon[self.order], lat[self.order]
        self.lons, rank = np.unique(turned[self.order], return_inverse=True)
        self.width = len(self.lons) + 1
        self.keys = strip[self.order] * self.width + rank
        self.top = int(strip.max()) if len(strip) else -1

    def _place(self, strip: np.ndarray, bound: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.keys, strip * self.width + np.searchsorted(self.lons, bound, side), "left")

    def runs(self, lon: np.ndarray, lat: np.ndarray):
        """``query, from, to, inner from, inner to`` by strip; places of the inner run are surely inside, others of the run are to be tested. A query comes at most once in a step."""
        if not len(self.lon):
            return
        turned, own = (lon + 180.0) % 360.0 - 180.0, np.floor((lat - self.south) / self.step).astype(np.int64)
        rim = math.sin(min(self.radius / EARTH_RADIUS_M, math.pi) / 2) ** 2
        slack = 1e-9 * rim + 1e-14 * math.sqrt(rim)
        around, cos_q = math.ceil(self.reach / self.step) + 1, np.cos(np.radians(lat))
        for offset in range(max(-around, -int(own.max(initial=0))), min(around, self.top - int(own.min(initial=0))) + 1):
            strip = own + offset
            q = np.flatnonzero((strip >= 0) & (strip <= self.top))
            if not len(q):
                continue
            s, y, c = strip[q], lat[q], cos_q[q]
            south, north = self.south + s * self.step - 1e-12, self.south + (s + 1) * self.step + 1e-12
            close = np.maximum(0.0, np.maximum(south - y, y - north))
            flat = np.where((south <= 0) & (north >= 0), 0.0, np.minimum(np.abs(south), np.abs(north)))
            steep = np.minimum(np.maximum(np.abs(south), np.abs(north)), 90.0)
            left = rim + slack - np.sin(np.radians(close) / 2) ** 2
            sure = rim - slack - np.sin(np.radians(np.maximum(y - south, north - y)) / 2) ** 2
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(left >= 0, left, np.nan) / np.maximum(np.cos(np.radians(steep)) * c, 1e-300)
                outer = np.where(ratio >= 1 - 1e-9, 180.0, np.degrees(2 * np.arcsin(np.sqrt(np.minimum(ratio, 1.0)))) * (1 + 1e-9) + 1e-11)
                inner = np.where(sure > 0, np.degrees(2 * np.arcsin(np.sqrt(np.clip(sure / (np.cos(np.radians(flat)) * c), 0.0, 1.0)))) * (1 - 1e-9) - 1e-11, -1.0)
            around_pole = outer >= 180.0
            for turn in (0.0, 360.0, -360.0):
                x = turned[q] + turn
                met = np.flatnonzero((left >= 0) & np.where(around_pole, turn == 0.0, (x - outer <= self.lons[-1]) & (x + outer >= self.lons[0])))
                if not len(met):
                    continue
                x, r, i, at = x[met], np.where(around_pole, 400.0, outer)[met], np.where(around_pole, -1.0, inner)[met], s[met]
                a, d = self._place(at, x - r, "left"), self._place(at, x + r, "right")
                b, e = self._place(at, x - i, "left"), self._place(at, x + i, "right")
                none = i < 0
                yield q[met], a, d, np.where(none, a, b), np.where(none, a, e)

    def tested(self, lon: np.ndarray, lat: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """``query, place`` of the places of the runs that are within the radius."""
        for who, place in spans(q, lo, hi):
            ok = metres(lon[who], lat[who], self.lon[place], self.lat[place]) <= self.radius
            yield who[ok], place[ok]


def totals_within(lon: np.ndarray, lat: np.ndarray, points_lon: np.ndarray, points_lat: np.ndarray, values: np.ndarray, radius_m: float) -> np.ndarray:
    """Queries x measures: totals of ``values`` (points x measures) within the radius, in extended precision."""
    disc = Disc(points_lon, points_lat, radius_m)
    v = values[disc.order].astype(np.longdouble)
    upto = np.concatenate([np.zeros((1, v.shape[1]), v.dtype), np.cumsum(v, axis=0)])
    out = np.zeros((len(lon), v.shape[1]), v.dtype)
    for q, lo, hi, a, b in disc.runs(lon, lat):
        out[q] += upto[b] - upto[a]
        for part in ((q, lo, a), (q, b, hi)):
            for who, place in disc.tested(lon, lat, *part):
                for m in range(v.shape[1]):
                    out[:, m] += np.bincount(who, v[place, m].astype(float), minlength=len(lon))
    return out


def tile_degrees(points: DataFrame, radius_m: float, apart: tuple[str, ...] = ()) -> float:
    """Height of a tile: the radius, or as many of it as bring about ``PER_TILE`` points (of one value of ``apart``) into one."""
    h = radius_m / METRES_PER_DEGREE
    n, cells = with_cell(points.select("lon", "lat", *apart), "lon", "lat", h).agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("_row", "_col", *apart))).first()
    return max(h, min(h * math.ceil(math.sqrt(PER_TILE * max(cells, 1) / max(n, 1))), _MAX_TILE_DEG))


def in_tiles(queries: DataFrame, points: DataFrame, radius_m: float, query_id: str, by: tuple[str, ...] = (), chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Queries and points by tile and chunk, so that each query meets each point in its reach in exactly one group; and the keys of a group. Places without coordinates fall out.

    Points of different ``by`` are in different groups; where queries have such a column too, they meet only points of their own value.
    """
    here = ~F.isnan("lon") & ~F.isnan("lat")
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])     # points may be the same table
    points = points.where(here)
    shared = tuple(c for c in by if c in queries.columns)
    h = tile_degrees(points, radius_m, shared)
    points = with_cell(points, "lon", "lat", h)
    tile = ["_row", "_col", *by]
    tiles = points.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_parts"))
    reached = queries.where(here).withColumn("_cell", F.explode(neighbour_cells(F.col("lon"), F.col("lat"), radius_m, h))).select(*queries.columns, "_cell._row", "_cell._col")
    own = [c for c in queries.columns if c not in shared]
    reached = reached.join(tiles, ["_row", "_col", *shared]).select(*own, *tile, "_parts")
    crowd = cut(reached.groupBy(*tile).agg(F.first("_parts").alias("_parts"), F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_asks")), "tiles")
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    same = [F.col(c).alias(c) for c in tile]
    asks = reached.drop("_parts").join(crowd, tile).withColumn("_ask", dealt("_asks", query_id)).withColumn("_part", part("_parts"))
    held = points.join(crowd, tile).withColumn("_part", dealt("_parts", "lon", "lat")).withColumn("_ask", part("_asks"))
    keys = [*tile, "_part", "_ask"]
    return asks.select(*own, *keys[-2:], *same), held.drop("_parts", "_asks"), keys


def array_of(table: pa.Table, name: str, kind=float) -> np.ndarray:
    return table[name].to_numpy().astype(kind)


def disc_totals(queries: DataFrame, points: DataFrame, radius_m: float, query_id: str, measures: list[str], by: tuple[str, ...] = (), chunk: int = CHUNK,
                match: tuple[str, ...] = ()) -> DataFrame:
    """Per query the totals of ``measures`` over all points within the radius (missing values add nothing); with ``by``, per query and value of those columns. Queries without a point fall out.

    ``match`` columns are in both tables, and only points with a query's own values count (a missing value equals no other).

    Whole numbers are added exactly, others in extended precision; values that are not finite spoil only the queries they are near to.
    """
    kinds = {m: T.LongType() if isinstance(points.schema[m].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else T.DoubleType() for m in measures}
    q = queries.select(query_id, "lon", "lat", *match)
    # values to keep apart travel as one struct, in which a missing value equals another
    group = ("_by",) if by else ()
    p = points.withColumn("_by", F.struct(*by)) if by else points
    p = p.groupBy("lon", "lat", *group, *match).agg(*[F.sum(F.col(m).cast(kinds[m])).alias(m) for m in measures])
    asks, held, keys = in_tiles(q, p, radius_m, query_id, (*group, *match), chunk)
    whole = [isinstance(k, T.LongType) for k in kinds.values()]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        values = np.stack([np.ones(len(right)).astype(np.longdouble)] + [right[m].fill_null(0).to_numpy().astype(np.longdouble) for m in measures], axis=1)
        finite = np.isfinite(values)
        odd = [] if finite.all() else [np.isnan(values), np.isposinf(values), np.isneginf(values)]
        clean = np.concatenate([np.where(finite, values, 0), *odd], axis=1)
        total = totals_within(array_of(left, "lon"), array_of(left, "lat"), array_of(right, "lon"), array_of(right, "lat"), clean, radius_m)
        w = values.shape[1]
        sums = total[:, :w]
        if odd:
            nan, up, down = (total[:, w * k:w * (k + 1)] > 0 for k in (1, 2, 3))
            sums = np.where(nan | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, sums)))
        some = np.flatnonzero(sums[:, 0] > 0)
        data = {query_id: left[query_id].take(pa.array(some))}
        for b in group:
            data[b] = pa.array([right[b][0].as_py()] * len(some), right[b].type)
        for k, m in enumerate(measures):
            s = sums[some, k + 1]
            data[m] = pa.array(np.rint(s).astype(np.int64) if whole[k] else s.astype(float))
        return pa.table(data)
    schema = T.StructType([q.schema[query_id], *[p.schema[b] for b in group], *[T.StructField(m, kinds[m]) for m in measures]])
    parts = asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(add, schema)
    summed = parts.groupBy(query_id, *group).agg(*[F.sum(m).alias(m) for m in measures])
    return summed.select(query_id, *[f"_by.{b}" for b in by], *measures)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least node of each node's group) after the groups of every ``a`` and ``b`` became one."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def links_within(lon: np.ndarray, lat: np.ndarray, node: np.ndarray, points_lon: np.ndarray, points_lat: np.ndarray, points_node: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that connect the same nodes as all pairs of a query and a point within the radius do, less than one pair for a node.

    The points of an inner run are all linked to the query, so each to the next; only rim points of another group than the query's are tested.
    """
    disc = Disc(points_lon, points_lat, radius_m)
    names, at = np.unique(np.concatenate([node, points_node]), return_inverse=True)
    mine, there = at[:len(node)], at[len(node):][disc.order]
    root = np.arange(len(names))
    chained = np.zeros(len(there) + 1, np.int64)
    for q, _, _, a, b in disc.runs(lon, lat):
        some = b > a
        root = _joined(root, mine[q[some]], there[a[some]])
        chained += np.bincount(a[some], minlength=len(chained)) - np.bincount(b[some] - 1, minlength=len(chained))
    together = np.flatnonzero(np.cumsum(chained)[:-1] > 0)
    root = _joined(root, there[together], there[together + 1])
    for q, lo, hi, a, b in disc.runs(lon, lat):
        for start, end in ((lo, a), (b, hi)):
            group = root[there]
            turns = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
            start_at = np.minimum(start, len(group) - 1)
            other = (end > start) & ((group[start_at] != root[mine[q]]) | (turns[np.searchsorted(turns, start_at, "right")] < end))
            for who, place in spans(q[other], start[other], end[other]):
                apart = root[mine[who]] != root[there[place]]
                who, place = who[apart], place[apart]
                ok = metres(lon[who], lat[who], disc.lon[place], disc.lat[place]) <= disc.radius
                root = _joined(root, mine[who[ok]], there[place[ok]])
    linked = np.flatnonzero(root != np.arange(len(names)))
    return names[linked], names[root[linked]]


def disc_links(queries: DataFrame, points: DataFrame, radius_m: float, query_id: str, node: str, match: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """``a, b``: pairs of values of ``node`` (a whole number in both tables) that connect what the pairs of a query and a point within the radius connect.

    A group gives less than one row for a node, so rows do not grow with the pairs. Only points with a query's own ``match`` values count.
    """
    asks, held, keys = in_tiles(queries.select(query_id, "lon", "lat", node, *match), points.select("lon", "lat", node, *match), radius_m, query_id, match, chunk)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = links_within(array_of(left, "lon"), array_of(left, "lat"), array_of(left, node, np.int64),
                                array_of(right, "lon"), array_of(right, "lat"), array_of(right, node, np.int64), radius_m)
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})
    return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(add, "a long, b long")


def least_within(lon: np.ndarray, lat: np.ndarray, points_lon: np.ndarray, points_lat: np.ndarray, values: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries with a point within the radius, and the least of the points' whole ``values``."""
    disc = Disc(points_lon, points_lat, radius_m)
    none = np.iinfo(np.int64).max
    levels = [values[disc.order]]                     # the least of 1, 2, 4, .. values from a place on
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out, met = np.full(len(lon), none), np.zeros(len(lon), bool)
    for q, lo, hi, a, b in disc.runs(lon, lat):
        wide = np.frexp(np.maximum(b - a, 1).astype(float))[1] - 1
        for k in np.unique(wide[b > a]):
            some = (b > a) & (wide == k)
            out[q[some]] = np.minimum(out[q[some]], np.minimum(levels[k][a[some]], levels[k][b[some] - 2 ** int(k)]))
            met[q[some]] = True
        for part in ((q, lo, a), (q, b, hi)):
            for who, place in disc.tested(lon, lat, *part):
                np.minimum.at(out, who, levels[0][place])
                met[who] = True
    some = np.flatnonzero(met)
    return some, out[some]


def disc_least(queries: DataFrame, points: DataFrame, radius_m: float, query_id: str, measure: str, match: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Per query the least ``measure`` (a whole number) of all points within the radius that have its own ``match`` values; queries without a point fall out."""
    asks, held, keys = in_tiles(queries.select(query_id, "lon", "lat", *match), points.select("lon", "lat", measure, *match), radius_m, query_id, match, chunk)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        some, low = least_within(array_of(left, "lon"), array_of(left, "lat"), array_of(right, "lon"), array_of(right, "lat"), array_of(right, measure, np.int64), radius_m)
        return pa.table({query_id: left[query_id].take(pa.array(some)), measure: pa.array(low, pa.int64())})
    schema = T.StructType([queries.schema[query_id], T.StructField(measure, T.LongType())])
    parts = asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(add, schema)
    return parts.groupBy(query_id).agg(F.min(measure).alias(measure))


DRAWN = 1 << 14                    # points or queries of one group that carry arrays


def products_within(lon: np.ndarray, lat: np.ndarray, w: np.ndarray, z: np.ndarray, points_lon: np.ndarray, points_lat: np.ndarray, points_z: np.ndarray, radius_m: float) -> np.ndarray:
    """Per column of the arrays, the sum of w z z' over all pairs of a query and a point within the radius."""
    disc = Disc(points_lon, points_lat, radius_m)
    there, mine = points_z[disc.order], w[:, None] * z
    upto = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(there, axis=0)])
    out, most = np.zeros(z.shape[1]), max(1, TESTED // max(z.shape[1], 1))

    def add(who: np.ndarray, sums) -> None:
        for at in range(0, len(who), most):
            out[:] += np.einsum("qd,qd->d", mine[who[at:at + most]], sums(slice(at, at + most)))
    for q, lo, hi, a, b in disc.runs(lon, lat):
        some = b > a
        add(q[some], lambda s, a=a[some], b=b[some]: upto[b[s]] - upto[a[s]])
        for part in ((q, lo, a), (q, b, hi)):
            for who, place in disc.tested(lon, lat, *part):
                add(who, lambda s, place=place: there[place[s]])
    return out


def disc_products(sites: DataFrame, radius_m: float, site: str, weight: str, values: str, chunk: int = DRAWN,
                  drawn: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """Rows with ``sums``, an array that adds up over all rows to sum w_i z_i z_j over ordered pairs of sites within the radius, each with itself included; ``values`` are arrays of one length.

    ``drawn`` is a column of numbers and a function of them with a row of values for each: rows without an array get theirs from it inside the group, so only the number travels.
    """
    own = [drawn[0]] if drawn else []
    asks, held, keys = in_tiles(sites.select(site, "lon", "lat", weight, values, *own), sites.select("lon", "lat", values, *own), radius_m, site, chunk=chunk)

    def arrays(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.Array) else pa.chunked_array(flat).combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

    def matrix(table: pa.Table) -> np.ndarray:
        if not drawn:
            return arrays(table[values])
        given = table[values].is_valid().to_numpy()
        if given.all():
            return arrays(table[values])
        made = drawn[1](table[drawn[0]].filter(pa.array(~given)).to_numpy().astype(np.int64)).astype(float, copy=False)
        if not given.any():
            return made
        out = np.empty((len(table), made.shape[1]))
        out[~given], out[given] = made, arrays(table[values].filter(pa.array(given)))
        return out

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("sums", pa.list_(pa.float64()))])
        if not len(left) or not len(right):
            return pa.table({"sums": []}, kind)
        sums = products_within(array_of(left, "lon"), array_of(left, "lat"), array_of(left, weight), matrix(left), array_of(right, "lon"), array_of(right, "lat"), matrix(right), radius_m)
        return pa.table({"sums": [sums.tolist()]}, kind)
    return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(add, "sums array<double>")

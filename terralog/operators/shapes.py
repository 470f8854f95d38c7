"""Overlap areas of polygon pairs: partitions that follow the data, and clipping in arrays.

The plane is split by the medians of a bounded sample of envelopes, so crowded places get small partitions and a large polygon goes only to those it
reaches, once each, not to every cell of a fixed grid. A partition that still holds too many shapes of a side is dealt to several tasks. Inside a task pairs of
envelopes that meet are found and clipped together, one array step per edge of the clip ring.

A shape has one closed ``ring`` or several ``rings``: an outer one per part and holes, in any order and direction. Rings of a shape do not cross; one inside an odd number of
others is a hole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.geo import EARTH_RADIUS_M
from terralog.session import cut

SAMPLE_ROWS = 1 << 14              # envelopes on the driver
LEAF_ROWS = 1024                   # shapes of a side in one task
PAIR_BLOCK = 1 << 20               # envelope comparisons, and corners clipped, at once
BOX = ("w", "s", "e", "n")


# ---- partitions -----------------------------------------------------------------------------

def split_plane(boxes: np.ndarray, leaf: int, most: int = 4096) -> np.ndarray:
    """Leaves ``w, s, e, n`` (the outer ones reach to infinity) of a k-d split of the sampled envelopes at the medians of their corners."""
    leaves, done = [(np.array([-np.inf, -np.inf, np.inf, np.inf]), boxes)], []
    while leaves:
        box, inside = leaves.pop()
        axis, best = None, None
        if len(inside) > leaf and len(leaves) + len(done) + 2 <= most:
            # the split that sends the fewest envelopes to both sides
            for k in (0, 1):
                at = float(np.median(inside[:, k]))
                sides = int((inside[:, k] < at).sum() + (inside[:, k + 2] >= at).sum())
                if (inside[:, k] < at).any() and (inside[:, k + 2] < at).any() and (best is None or sides < best):
                    axis, best, where = k, sides, at
        if axis is None or best > 1.7 * len(inside):
            done.append(box)
            continue
        low, high = box.copy(), box.copy()
        low[axis + 2], high[axis] = where, where
        leaves += [(low, inside[inside[:, axis] < where]), (high, inside[inside[:, axis + 2] >= where])]
    return np.array(done)


def _leaves_of(leaves: np.ndarray):
    """Numbers of the leaves that an envelope reaches."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reach(w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
        out, step = [], max(1, PAIR_BLOCK // len(leaves))
        for k in range(0, len(w), step):
            box = [x.to_numpy(float)[k:k + step, None] for x in (w, s, e, n)]
            hit = (box[0] < leaves[:, 2]) & (box[2] >= leaves[:, 0]) & (box[1] < leaves[:, 3]) & (box[3] >= leaves[:, 1])
            out += [np.flatnonzero(r).astype(np.int32) for r in hit]
        return pd.Series(out)
    return reach


def _boxed(shapes: DataFrame, key: str) -> DataFrame:
    """``id, rings`` and the envelope; shapes without a point are left out."""
    rings = F.col("rings") if "rings" in shapes.columns else F.array("ring")
    d = shapes.select(F.col(key).alias("id"), rings.alias("rings"))
    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return d.select("id", "rings", F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n")).where("w IS NOT NULL AND s IS NOT NULL")


def _sampled(shapes: DataFrame) -> np.ndarray:
    """Envelopes of at most about ``SAMPLE_ROWS`` shapes; only placement depends on them, not results."""
    n = shapes.count()
    some = shapes.select(*BOX) if n <= SAMPLE_ROWS else shapes.select(*BOX).sample(SAMPLE_ROWS / n, seed=7)
    return some.toPandas().to_numpy(float).reshape(-1, 4)


# ---- clipping -------------------------------------------------------------------------------

def _next(n: np.ndarray, width: int) -> np.ndarray:
    """Index of the next corner in rows of ``n`` corners."""
    k = np.arange(width)[None, :] + 1
    return np.where(k < n[:, None], k, 0)


def clip(subject: np.ndarray, n: np.ndarray, ring: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of open rings (``subject`` with ``n`` corners each) inside convex counter-clockwise rings (``ring`` with ``m`` corners), one half-plane a step."""
    after = np.take_along_axis(ring, _next(m, ring.shape[1])[:, :, None], axis=1)
    for k in range(ring.shape[1]):
        used = k < m
        p, q = ring[:, k][:, None, :], after[:, k][:, None, :]
        width = subject.shape[1]
        side = (q[..., 0] - p[..., 0]) * (subject[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (subject[..., 0] - p[..., 0])
        side = np.where(used[:, None], side, 1.0)
        live = np.arange(width)[None, :] < n[:, None]
        to = _next(n, width)
        beyond, onward = np.take_along_axis(side, to, axis=1), np.take_along_axis(subject, to[:, :, None], axis=1)
        cuts = live & (side * beyond < 0)
        share = np.where(cuts, side, 0.0) / np.where(cuts, side - beyond, 1.0)
        both = np.stack([subject, subject + (onward - subject) * share[..., None]], axis=2).reshape(len(subject), -1, 2)
        kept = np.stack([live & (side >= 0), cuts], axis=2).reshape(len(subject), -1)
        n = kept.sum(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :max(int(n.max(initial=0)), 1)]
        subject = np.take_along_axis(both, order[:, :, None], axis=1)
    return subject, n


def areas(corners: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Spherical area of open rings, positive when counter-clockwise."""
    r = np.radians(corners)
    onward = np.take_along_axis(r, _next(n, r.shape[1])[:, :, None], axis=1)
    part = (onward[..., 0] - r[..., 0]) * (2 + np.sin(r[..., 1]) + np.sin(onward[..., 1]))
    live = np.arange(r.shape[1])[None, :] < n[:, None]
    return np.where(n >= 3, -np.where(live, part, 0.0).sum(axis=1) * EARTH_RADIUS_M ** 2 / 2, 0.0)


def _turn(ring: np.ndarray) -> float:
    """Plane area of an open ring, positive when counter-clockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)).sum() % 2)


class Shape:
    """Rings of one shape, counter-clockwise, each with a sign; pieces of them that are convex, for clipping with."""

    def __init__(self, rings):
        opened = []
        for r in rings:
            points = np.array([(p["x"], p["y"]) for p in r], dtype=float).reshape(-1, 2)
            points = points[:-1] if len(points) > 1 and (points[0] == points[-1]).all() else points
            turn = _turn(points) if len(points) >= 3 else 0.0
            if turn:
                opened.append(points if turn > 0 else points[::-1])
        self.rings = opened
        self.signs = [1.0] if len(opened) == 1 else [1.0 - 2.0 * (sum(_holds(o, *self._inner(r)) for o in opened if o is not r) % 2) for r in opened]
        self._pieces: list[tuple[float, np.ndarray]] | None = None

    @staticmethod
    def _inner(ring: np.ndarray) -> tuple[float, float]:
        """A point just inside the ring's first corner that turns left: rings of a shape may touch."""
        a, b, c = np.roll(ring, 1, axis=0), ring, np.roll(ring, -1, axis=0)
        left = (b[:, 0] - a[:, 0]) * (c[:, 1] - b[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - b[:, 0]) > 0
        k = int(np.argmax(left))
        x, y = b[k] + ((a[k] - b[k]) / max(np.hypot(*(a[k] - b[k])), 1e-300) + (c[k] - b[k]) / max(np.hypot(*(c[k] - b[k])), 1e-300)) * 1e-9
        return float(x), float(y)

    @property
    def pieces(self) -> list[tuple[float, np.ndarray]]:
        """Signed convex rings that add up to the shape: the ring itself if it is convex, else the triangles from its first corner with the sign of their turn."""
        if self._pieces is None:
            self._pieces = []
            for sign, ring in zip(self.signs, self.rings):
                step, onward = np.roll(ring, -1, axis=0) - ring, np.roll(ring, -2, axis=0) - np.roll(ring, -1, axis=0)
                cross = step[:, 0] * onward[:, 1] - step[:, 1] * onward[:, 0]
                bend = np.arctan2(cross, (step * onward).sum(axis=1)).sum()
                if (cross >= 0).all() and abs(bend - 2 * np.pi) < 1e-6:
                    self._pieces.append((sign, ring))
                    continue
                for p, q in zip(ring[1:-1], ring[2:]):
                    tri = np.array([ring[0], p, q])
                    if turn := _turn(tri):
                        self._pieces.append((sign * np.sign(turn), tri if turn > 0 else tri[::-1]))
        return self._pieces


def _stacked(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, rings), np.int64, len(rings))
    out = np.zeros((len(rings), int(n.max()), 2))
    for row, r in zip(out, rings):
        row[:len(r)] = r
        row[len(r):] = r[-1]
    return out, n


def pair_areas(a: list[Shape], b: list[Shape], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Overlap area of the pairs ``a[i], b[j]``; jobs of like sizes are clipped together."""
    out = np.zeros(len(i))
    by: dict[tuple[int, int], list[tuple[int, float, np.ndarray, np.ndarray]]] = {}

    def flush(jobs):
        step = max(1, PAIR_BLOCK // (4 * len(jobs[0][2])))
        for k in range(0, len(jobs), step):
            part = jobs[k:k + step]
            found = areas(*clip(*_stacked([r for _, _, r, _ in part]), *_stacked([c for _, _, _, c in part])))
            np.add.at(out, [p for p, _, _, _ in part], [s * v for (_, s, _, _), v in zip(part, found.tolist())])
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
        for sign, ring in zip(a[p].signs, a[p].rings):
            for other, piece in b[q].pieces:
                by.setdefault((len(ring).bit_length(), len(piece).bit_length()), []).append((k, sign * other, ring, piece))
        if k % 65536 == 65535:
            for jobs in by.values():
                flush(jobs)
            by.clear()
    for jobs in by.values():
        flush(jobs)
    return np.abs(out)


def meeting(a: np.ndarray, b: np.ndarray, leaf: np.ndarray):
    """Blocks of index pairs of envelopes that meet with their common lower corner in the leaf."""
    order = np.argsort(b[:, 0], kind="stable")
    b = b[order]
    step = max(1, PAIR_BLOCK // max(len(b), 1))
    for k in range(0, len(a), step):
        part = a[k:k + step]
        # only those that begin before the block's last end
        upto = int(np.searchsorted(b[:, 0], part[:, 2].max(), "right"))
        w, s = np.maximum(part[:, None, 0], b[None, :upto, 0]), np.maximum(part[:, None, 1], b[None, :upto, 1])
        hit = (w <= np.minimum(part[:, None, 2], b[None, :upto, 2])) & (s <= np.minimum(part[:, None, 3], b[None, :upto, 3]))
        i, j = np.nonzero(hit & (w >= leaf[0]) & (w < leaf[2]) & (s >= leaf[1]) & (s < leaf[3]))
        if len(i):
            yield i + k, order[j]


def intersects(a: DataFrame, b: DataFrame, a_id: str, b_id: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``a_id, b_id, area_m2`` of pairs of shapes with a common area. Null ids are kept; shapes without rings meet nothing."""
    sides = [cut(_boxed(d, k), "boxed") for d, k in ((a, a_id), (b, b_id))]
    sizes = [d.count() for d in sides]
    sample = np.concatenate([_sampled(d) for d in sides])
    leaves = split_plane(sample, max(1, int(leaf_rows * len(sample) / max(sum(sizes), 1)))) if len(sample) else np.array([[-np.inf, -np.inf, np.inf, np.inf]])
    reach = _leaves_of(leaves)
    placed = [cut(d.withColumn("leaf", F.explode(reach(*BOX))), "placed") for d in sides]
    # one row per leaf over the limit, and there are at most 4096 leaves
    share = [F.broadcast(d.groupBy("leaf").agg(F.ceil(F.count("*") / leaf_rows).cast("int").alias(f"n{k}"))) for k, d in enumerate(placed)]
    dealt = []
    for k, d in enumerate(placed):
        d = d.join(share[0], "leaf").join(share[1], "leaf")
        own = F.pmod(F.xxhash64("id", "w", "s"), F.col(f"n{k}")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"n{1 - k}") - 1))
        dealt.append(d.withColumn(f"p{k}", own).withColumn(f"p{1 - k}", every).select("leaf", "p0", "p1", "id", "rings", *BOX))

    def overlap(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        shapes = [[None] * len(x), [None] * len(y)]
        ids, out = (x["id"].to_numpy(object), y["id"].to_numpy(object)), []
        for i, j in meeting(x[list(BOX)].to_numpy(float), y[list(BOX)].to_numpy(float), leaves[int(key[0])]):
            for side, at, d in ((0, i, x), (1, j, y)):
                for k in np.unique(at).tolist():
                    if shapes[side][k] is None:
                        shapes[side][k] = Shape(d["rings"].iat[k])
            area = pair_areas(shapes[0], shapes[1], i, j)
            out.append(pd.DataFrame({a_id: ids[0][i], b_id: ids[1][j], "area_m2": area})[area > 0])
        return pd.concat(out) if out else pd.DataFrame({a_id: [], b_id: [], "area_m2": []})
    types = [d.schema["id"].dataType.simpleString() for d in sides]
    keys = ("leaf", "p0", "p1")
    return dealt[0].groupBy(*keys).cogroup(dealt[1].groupBy(*keys)).applyInPandas(overlap, f"{a_id} {types[0]}, {b_id} {types[1]}, area_m2 double")

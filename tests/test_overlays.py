"""Overlay runs, overlap areas of shapes with holes and parts, and the partitions they use."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.functions.geo import EARTH_RADIUS_M
from terralog.operators import overlay as O
from terralog.operators import shapes as P

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def box(w, s, e, n):
    return ring([(w, s), (e, s), (e, n), (w, n)])


def layer(spark, *shapes):
    return spark.createDataFrame([(k, list(s)) for k, s in enumerate(shapes)], f"id long, rings array<{RING}>")


def star(rng, x, y, corners=9):
    turn = np.sort(rng.random(corners)) * 2 * math.pi
    far = rng.uniform(0.01, 0.05, corners)
    return ring([(x + r * math.cos(t), y + r * math.sin(t)) for r, t in zip(far, turn)])


def plane(rings):
    """Cells of a fine raster inside an odd number of rings."""
    n = 1200
    xs, ys = np.meshgrid(10 + (np.arange(n) + 0.5) / n * 0.4, 50 + (np.arange(n) + 0.5) / n * 0.4)
    hits = np.zeros(xs.shape, dtype=int)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if y1 != y2:
                hits += ((y1 > ys) != (y2 > ys)) & (xs < (x2 - x1) * (ys - y1) / (y2 - y1) + x1)
    return hits % 2 == 1


def cell_m2():
    south = np.radians(50 + np.arange(1200) / 1200 * 0.4)
    return EARTH_RADIUS_M ** 2 * math.radians(0.4 / 1200) * (np.sin(south + math.radians(0.4 / 1200)) - np.sin(south))[:, None]


DONUT = [box(10.05, 50.05, 10.25, 50.25), box(10.1, 50.1, 10.2, 50.2), box(10.13, 50.13, 10.17, 50.17)]
PARTS = [box(10.02, 50.02, 10.12, 50.12), box(10.2, 50.16, 10.3, 50.3)[::-1]]


def test_overlaps_with_holes_and_parts(spark):
    rng = np.random.default_rng(5)
    a = [DONUT, PARTS, *[[star(rng, 10.15, 50.15)] for _ in range(6)], [ring([(10.1, 50.1), (10.3, 50.1), (10.3, 50.12), (10.12, 50.12), (10.12, 50.3), (10.1, 50.3)])]]
    b = [PARTS, DONUT, *[[star(rng, 10.16, 50.14)] for _ in range(6)], [box(10, 50, 10.4, 50.4)], [ring([(11, 51), (12, 52), (11, 52)])]]
    got = {(r.a, r.b): r.area_m2 for r in P.intersects(layer(spark, *a).withColumnRenamed("id", "a"), layer(spark, *b).withColumnRenamed("id", "b"), "a", "b", leaf_rows=3).collect()}
    fields, size = [[plane(s) for s in side] for side in (a, b)], cell_m2()
    for i, x in enumerate(fields[0]):
        for j, y in enumerate(fields[1]):
            want = float(((x & y) * size).sum())
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=6e6, rel=0.02), (i, j)
    assert not any(j == 9 for _, j in got)


def test_overlap_edges(spark):
    """Equal shapes, shared borders, points and lines, null and empty rings, repeated rows."""
    square = box(0, 0, 1, 1)
    whole = P.areas(np.array([square[:-1]]), np.array([4]))[0]
    a = spark.createDataFrame([(1, square), (1, square), (2, box(1, 0, 2, 1)), (3, ring([(5, 5)])), (4, None), (5, [])], f"a long, ring {RING}")
    b = spark.createDataFrame([(9, square), (8, ring([(0, 0), (1, 1)])), (7, box(0.25, 0.25, 0.75, 0.75))], f"b long, ring {RING}")
    got = sorted((r.a, r.b, round(r.area_m2 / whole, 4)) for r in P.intersects(a, b, "a", "b").collect())
    assert got == [(1, 7, 0.25), (1, 7, 0.25), (1, 9, 1.0), (1, 9, 1.0)]
    assert P.intersects(a.limit(0), b, "a", "b").count() == 0


def test_partitions_follow_the_data():
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.normal(0, 0.01, (5000, 2)), rng.uniform(-90, 90, (500, 2))])
    boxes = np.column_stack([at, at + 0.001])
    leaves = P.split_plane(boxes, 200)
    held = [int(((boxes[:, 0] < e) & (boxes[:, 2] >= w) & (boxes[:, 1] < n) & (boxes[:, 3] >= s)).sum()) for w, s, e, n in leaves]
    assert max(held) <= 220 and sum(held) < 1.5 * len(boxes)
    # every lower corner lies in one leaf
    assert all(sum((w <= x < e) and (s <= y < n) for w, s, e, n in leaves) == 1 for x, y in at[::50])
    # nothing to gain where all lie on one spot
    assert len(P.split_plane(np.tile([[0.0, 0.0, 1.0, 1.0]], (1000, 1)), 10)) == 1


def test_crowded_partition_is_dealt(spark):
    """Everything on one spot, and every pair is still found once."""
    n = 60
    a, b = (spark.range(n).select(F.col("id").alias(k), F.expr(f"from_json('[{{\"x\":0,\"y\":0}},{{\"x\":1,\"y\":0}},{{\"x\":1,\"y\":1}},{{\"x\":0,\"y\":1}},{{\"x\":0,\"y\":0}}]', '{RING}')").alias("ring")) for k in "ab")
    got = P.intersects(a, b, "a", "b", leaf_rows=20)
    assert got.count() == n * n and got.distinct().count() == n * n


@pytest.mark.parametrize("op", ["union", "difference", "intersect"])
def test_overlay_bound_holds(spark, op):
    rng = np.random.default_rng(9)
    a, b = [DONUT, [star(rng, 10.3, 50.3)], [star(rng, 10.1, 50.3)]], [PARTS, [star(rng, 10.28, 50.3)]]
    fields = [np.any([plane(s) for s in side], axis=0) for side in (a, b)]
    want = {"union": fields[0] | fields[1], "difference": fields[0] & ~fields[1], "intersect": fields[0] & fields[1]}[op]
    exact, last = float((want * cell_m2()).sum()), None
    for cell in (0.01, 0.001):
        r = O.overlay_area(layer(spark, *a), layer(spark, *b), op, cell).first()
        assert abs(r.area_m2 - exact) <= r.error_bound_m2 and r.resolution_deg == cell
        assert last is None or r.error_bound_m2 < last / 5
        last = r.error_bound_m2
    assert abs(r.area_m2 / exact - 1) < 0.01


def test_overlay_rows_grow_with_the_boundary(spark):
    big = layer(spark, [box(10, 50, 10.4, 50.4)])
    nothing = layer(spark, [ring([(0, 0), (0, 0)])])
    sizes = []
    for cell in (0.004, 0.001):
        found, borders = O.overlay(big, nothing, "union", cell)
        cells = found.agg(F.sum(F.col("high") - F.col("low"))).first()[0]
        sizes.append((found.count() + borders.count(), cells))
    assert sizes[1][0] < 5 * sizes[0][0] and sizes[1][1] > 14 * sizes[0][1]
    with pytest.raises(ValueError):
        O.overlay(big, nothing, "xor", 0.01)

"""Union, difference and intersection of polygon layers on a cell lattice, as runs of cells along its rows.

An edge is cut at the middle of every row it crosses, two cuts of a shape make a run, and a layer is the sum of its runs: all rows of these tables
grow with the boundaries, never with the area inside. A shape may have several rings; a cell belongs to it if its centre lies inside an odd
number of them, so holes and parts need no case of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.operators.geometry import cell_area_m2
from terralog.plans.running import BLOCK_ROWS, Run, running
from terralog.session import cut

INSIDE = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "difference": lambda a, b: (a > 0) & (b <= 0),
    "intersect": lambda a, b: (a > 0) & (b > 0),
}


def edges(shapes: DataFrame, key: str = "shape") -> DataFrame:
    """``x1, y1, x2, y2`` of every ring of ``ring`` (one closed ring) or ``rings`` (several)."""
    rings = shapes.select(key, F.explode("rings").alias("ring")) if "rings" in shapes.columns else shapes.select(key, "ring")
    n = F.size("ring")
    pairs = F.zip_with(F.slice("ring", 1, n - 1), F.slice("ring", 2, n - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return rings.where(n > 1).select(key, F.inline(pairs))


def _rows(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def _first_centre(x: Column, cell: float) -> Column:
    """The first cell of a row whose centre is not left of ``x``."""
    k = F.ceil(x / cell - 0.5).cast("long")
    return F.when((k - 0.5) * cell >= x, k - 1).when((k + 0.5) * cell < x, k + 1).otherwise(k)


def runs(segments: DataFrame, cell: float, key: str = "shape") -> DataFrame:
    """``cy, low, high`` of every shape: cells low..high-1 of row cy have their centre inside."""
    y = (F.col("cy") + 0.5) * cell
    cuts = segments.where("y1 <> y2").withColumn("cy", F.explode(_rows(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)))
    cuts = cuts.where((F.col("y1") > y) != (F.col("y2") > y)).select(key, "cy", ((F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1"))) + F.col("x1")).alias("x"))
    # a row of one shape has as many cuts as the shape has edges across it
    lined = cuts.groupBy(key, "cy").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(
        _first_centre(F.get("xs", i), cell).alias("low"), _first_centre(F.get("xs", i + 1), cell).alias("high")))
    return lined.select("cy", F.inline(pairs)).where("low < high")


def boundary(segments: DataFrame, cell: float) -> DataFrame:
    """``cy, cells``: how many cells of a row an edge touches, for every edge and row (cells of two edges count twice)."""
    south, north = F.col("cy") * cell, (F.col("cy") + 1) * cell
    rows = segments.withColumn("cy", F.explode(_rows(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)))
    slope = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))

    def at(y: Column) -> Column:
        inside = F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
        return F.when(slope.isNull(), F.when(y == south, F.col("x1")).otherwise(F.col("x2"))).otherwise(F.col("x1") + (inside - F.col("y1")) * slope)
    a, b = F.floor(at(south) / cell), F.floor(at(north) / cell)
    return rows.select("cy", (F.abs(a - b) + 1).cast("long").alias("cells"))


def overlay(a: DataFrame, b: DataFrame, op: str, cell_deg: float, block_cells: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The runs ``cy, low, high`` of the result, and ``cy, cells`` of both layers' boundaries.

    Layers have ``ring`` or ``rings``. Runs of several shapes of a layer may overlap; a cell is in the layer if any of them holds it.
    """
    if op not in INSIDE:
        raise ValueError(f"unknown overlay {op}")
    events, borders = [], []
    for layer, own in ((a, "da"), (b, "db")):
        ring = "rings" if "rings" in layer.columns else "ring"
        # shapes are told apart by a number that is frozen in a table
        segments = edges(cut(layer.select(F.monotonically_increasing_id().alias("shape"), ring), "shapes"))
        found = runs(segments, cell_deg)
        step = F.array(F.struct(F.col("low").alias("cx"), F.lit(1).alias("d")), F.struct(F.col("high").alias("cx"), F.lit(-1).alias("d")))
        events.append(found.select("cy", F.inline(step)).select("cy", "cx", *[(F.col("d") if c == own else F.lit(0)).cast("long").alias(c) for c in ("da", "db")]))
        borders.append(boundary(segments, cell_deg))
    steps = events[0].unionByName(events[1]).groupBy("cy", "cx").agg(F.sum("da").alias("da"), F.sum("db").alias("db")).where("da <> 0 OR db <> 0")
    block = F.floor(F.col("cx") / block_cells).cast("long")
    line = running(steps, ["cy"], ["cx"], block, [Run("na", "sum", F.col("da")), Run("nb", "sum", F.col("db")), Run("high", "min", F.col("cx"), inclusive=False, backward=True)])
    return line.where(INSIDE[op](F.col("na"), F.col("nb"))).select("cy", F.col("cx").alias("low"), "high"), borders[0].unionByName(borders[1])


def overlay_area(a: DataFrame, b: DataFrame, op: str, cell_deg: float) -> DataFrame:
    """One row: ``cells``, ``area_m2`` (null without cells), ``resolution_deg`` and ``error_bound_m2``.

    A cell that no edge touches lies wholly inside or outside, so the true area is within the area of the touched cells of the estimate.
    """
    found, borders = overlay(a, b, op, cell_deg)
    n, area = F.col("high") - F.col("low"), cell_area_m2(F.col("cy"), cell_deg)
    sums = found.agg(F.coalesce(F.sum(n), F.lit(0)).alias("cells"), F.sum(n * area).alias("area_m2"))
    bound = borders.groupBy("cy").agg(F.sum("cells").alias("k")).agg(F.coalesce(F.sum(F.col("k") * area), F.lit(0.0)).alias("bound")).scalar()
    return sums.select("cells", "area_m2", F.lit(cell_deg).alias("resolution_deg"), bound.alias("error_bound_m2"))

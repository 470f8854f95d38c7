"""Classification, legends, profiles, grids and density surfaces."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.geo import METRES_PER_DEGREE, haversine
from terralog.operators.records import canonical_digest
from terralog.plans.ranking import value_ranks


def quantile_breaks(df: DataFrame, col: str, classes: int) -> DataFrame:
    """Midpoints between neighbouring distinct values at rank ceil(i*n/classes); at most classes-1 rows."""
    ranks = value_ranks(df, col)
    n = ranks.agg(F.max("dense").alias("n")).scalar()
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(classes - 1)),
                                          lambda i: F.ceil(i * F.col("_n") / F.lit(classes)).cast("long")))
    near = F.filter(wanted, lambda r: (r >= F.col("dense") - 1) & (r <= F.col("dense")))
    return (ranks.withColumn("_n", F.coalesce(n, F.lit(0))).select(F.col(col).alias("v"), F.explode(near).alias("rank"))
            .groupBy("rank").agg(((F.min("v") + F.max("v")) / 2).alias("brk"), F.count(F.lit(1)).alias("_c"))
            .where("_c = 2").select("brk"))


def equal_interval_breaks(df: DataFrame, col: str, classes: int) -> DataFrame:
    """Even split of the value range; constant data has no break."""
    rng = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).where("lo < hi")
    return rng.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(classes - 1)),
        lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(classes))).alias("brk"))


def style_of(df: DataFrame, col: str, breaks: DataFrame) -> Column:
    """``struct<breaks, lo, hi>`` of a column as one scalar subquery (a dozen numbers at most)."""
    brk = breaks.agg(F.array_sort(F.collect_list("brk")).alias("b")).scalar()
    rng = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("r")).scalar()
    return F.struct(brk.alias("breaks"), rng["lo"].alias("lo"), rng["hi"].alias("hi"))


def literal_style(breaks: Sequence[float], lo: float, hi: float) -> Column:
    return F.struct(F.array(*[F.lit(float(b)) for b in breaks]).alias("breaks"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))


def classify(value: Column, style: Column) -> Column:
    """Class index as text, or missing/underflow/overflow."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    at = F.size(F.filter(style["breaks"], lambda b: b <= value))
    return (F.when(bad, "missing").when(value < style["lo"], "underflow").when(value > style["hi"], "overflow")
            .otherwise(at.cast("string")))


def measure(kind: str, numerator: Column, denominator: Column | None = None) -> Column:
    """total is the field; rate and density divide, and are null without a positive denominator."""
    if kind == "total":
        return numerator
    ok = denominator.isNotNull() & ~F.isnan(denominator) & (F.abs(denominator) != float("inf")) & (denominator > 0)
    return F.when(ok, numerator / denominator)


def legend(style: Column, one_row: DataFrame) -> DataFrame:
    """Legend rows of a style: kind, from, to, to_inclusive. ``one_row`` supplies a single row."""
    edges = F.concat(F.array(style["lo"]), style["breaks"], F.array(style["hi"]))
    n = F.size("_e")
    rows = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        (i - 1).alias("class"), F.element_at("_e", i).alias("from"), F.element_at("_e", i + 1).alias("to"),
        (i == n - 1).alias("to_inclusive")))
    return one_row.select(edges.alias("_e")).select(F.inline(rows)).withColumn("kind", F.lit("class"))


def style_version(fields: dict[str, Column]) -> Column:
    """Version derived from every other style field."""
    return F.concat(F.lit("sty-"), F.substring(canonical_digest(fields), 1, 12), F.lit("@v1"))


def class_counts(df: DataFrame, value: Column, style: Column) -> DataFrame:
    return df.withColumn("_style", style).select(classify(value, F.col("_style")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, style: Column, one_row: DataFrame) -> DataFrame:
    """Counts in the legend's own bins; empty bins stay."""
    bins = legend(style, one_row).select(F.col("class").cast("string").alias("class"), "from", "to")
    return bins.join(class_counts(df, value, style), "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def unify(a: DataFrame, b: DataFrame, field: str, classes: int) -> DataFrame:
    """Class counts of two layers under one break set from the union of their values."""
    both = a.select(F.lit("a").alias("layer"), field).unionByName(b.select(F.lit("b").alias("layer"), field))
    style = style_of(both, field, quantile_breaks(both, field, classes))
    return both.withColumn("_style", style).select("layer", classify(F.col(field), F.col("_style")).alias("class")).groupBy("layer", "class").agg(F.count(F.lit(1)).alias("n"))


def selection(df: DataFrame, value: str, ts: str, frame: tuple[str, str] | None = None,
              brush: tuple[float, float] | None = None, domain_top: float | None = None) -> DataFrame:
    """Rows inside the frame and the brush; both half-open, the domain top closed; missing never matches."""
    cond = F.lit(True)
    if frame:
        cond = cond & (F.col(ts) >= F.lit(frame[0]).cast("timestamp")) & (F.col(ts) < F.lit(frame[1]).cast("timestamp"))
    if brush:
        lo, hi = brush
        top = (F.col(value) < hi) if domain_top is None or hi < domain_top else (F.col(value) <= hi)
        cond = cond & (F.col(value) >= lo) & top
    return df.where(cond)


def bounded_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows with the total before the bound and a ``truncated`` flag."""
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total).withColumn("truncated", F.col("total") > n)


# ---- profiles -----------------------------------------------------------------------------

STRICT_TS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def strict_timestamp(text: Column) -> Column:
    """Timestamp of an offset-bearing, calendar-valid ISO string; anything else is null."""
    return F.when(text.rlike(STRICT_TS), F.try_to_timestamp(text))


def field_profile(df: DataFrame, props: str, fields: Sequence[str], window: tuple[str, str] | None = None) -> DataFrame:
    """Counts per field of a JSON properties column, without coercion; distinct counts stop at two.

    "At least two" only needs a minimum and a maximum, so no distinct shuffle happens.
    """
    wanted = list(dict.fromkeys(fields))
    parsed = df.select(F.try_parse_json(F.col(props)).alias("p"))
    rows = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("p").outer())).where(
        F.col("key").isin(wanted)).select(F.col("key").alias("field"), F.col("value").alias("v"))
    kind = F.schema_of_variant("v")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    num = F.when(number, F.try_variant_get("v", "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
    ts = strict_timestamp(text)
    scalar = F.when(number, F.concat(F.lit("n"), num.cast("string"))).when(kind == "STRING", F.concat(F.lit("s"), text)).when(
        kind == "BOOLEAN", F.concat(F.lit("b"), F.try_variant_get("v", "$", "string")))
    present = F.col("v").isNotNull() & (kind != "VOID")

    def many(c):
        return F.when(F.min(c).isNull(), 0).when(F.min(c) == F.max(c), 1).otherwise(2)

    aggs = [F.count_if(present).alias("present"), F.count(num).alias("numeric"), F.count_if(num > 0).alias("positive"),
            F.count_if(num >= 0).alias("nonnegative"), F.count(ts).alias("timestamps"),
            F.count_if(F.length(F.trim(text)) > 0).alias("identities"), many(scalar).alias("distinct"), many(num).alias("numeric_distinct")]
    if window:
        lo, hi = (F.lit(w).cast("timestamp") for w in window)
        aggs.append(F.count_if((ts >= lo) & (ts < hi)).alias("in_window"))
    seen = rows.groupBy("field").agg(*aggs)
    every = df.sparkSession.createDataFrame([(f,) for f in wanted], "field string")
    return every.join(seen, "field", "left").na.fill(0)


def ratio_profile(df: DataFrame, num: str, den: str) -> DataFrame:
    ratio = measure("rate", F.col(num).cast("double"), F.col(den).cast("double"))
    ok = F.when(ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) != float("inf")), ratio)
    return df.agg(F.count(ok).alias("valid"), F.when(F.min(ok).isNull(), 0).when(F.min(ok) == F.max(ok), 1).otherwise(2).alias("distinct"))


def geometry_family(geom_type: Column) -> Column:
    return (F.when(geom_type.isin("Point", "MultiPoint"), "point").when(geom_type.isin("LineString", "MultiLineString"), "line")
            .when(geom_type.isin("Polygon", "MultiPolygon"), "polygon").otherwise("unknown"))


# ---- grids --------------------------------------------------------------------------------

def grid_aggregate(df: DataFrame, cell_deg: float, value: str) -> DataFrame:
    cx, cy = F.floor(F.col("lon") / cell_deg).cast("long"), F.floor(F.col("lat") / cell_deg).cast("long")
    return df.groupBy(cx.alias("cx"), cy.alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("valued"), F.sum(value).alias("sum"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def kernel_density(df: DataFrame, cell_deg: float, bandwidth_m: float) -> DataFrame:
    """Quartic-kernel surface at cell centres (per square metre). Equal positions are counted first."""
    pts = df.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("w"))
    ry = math.ceil(bandwidth_m / METRES_PER_DEGREE / cell_deg) + 1
    rx = F.ceil(bandwidth_m / METRES_PER_DEGREE / F.cos(F.radians(F.col("lat"))) / cell_deg).cast("long") + 1
    cx, cy = F.floor(F.col("lon") / cell_deg).cast("long"), F.floor(F.col("lat") / cell_deg).cast("long")
    near = (pts.withColumn("cx", F.explode(F.sequence(cx - rx, cx + rx)))
            .withColumn("cy", F.explode(F.sequence(cy - ry, cy + ry))))
    d = haversine(F.col("lon"), F.col("lat"), (F.col("cx") + 0.5) * cell_deg, (F.col("cy") + 0.5) * cell_deg)
    near = near.withColumn("d", d).where(F.col("d") < bandwidth_m)
    k = 3 / (math.pi * bandwidth_m ** 2) * F.pow(1 - F.pow(F.col("d") / bandwidth_m, 2), 2)
    return near.groupBy("cx", "cy").agg(F.sum(k * F.col("w")).alias("density"))

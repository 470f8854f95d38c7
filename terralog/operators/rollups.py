"""Aggregates over measurement and operation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.plans.ranking import group_order_stats, value_ranks
from terralog.plans.running import Run, last_seen, running


def zonal(df: DataFrame, zone: str, value: str, denominator: str | None = None) -> DataFrame:
    """Per zone: count, missing, sum, mean, min, max, population sd; weighted mean and rate with a denominator."""
    v = F.col(value)
    aggs = [F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.sum(v).alias("sum"), F.avg(v).alias("mean"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("sd")]
    if denominator:
        d = F.col(denominator)
        ok = v.isNotNull() & d.isNotNull() & (d > 0)
        total = F.sum(F.when(ok, d))
        aggs += [(F.sum(F.when(ok, v * d)) / total).alias("weighted_mean"), (F.sum(F.when(ok, v)) / total).alias("sum_rate"),
                 F.count_if(v.isNotNull() & ~F.coalesce(d > 0, F.lit(False))).alias("excluded")]
    return df.groupBy(zone).agg(*aggs)


def zonal_excluded(df: DataFrame, unit: str, zone: str, value: str, denominator: str) -> DataFrame:
    """Units left out of the weighted figures, named."""
    return df.where(F.col(value).isNotNull() & ~F.coalesce(F.col(denominator) > 0, F.lit(False))).select(unit, zone)


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """Rank of each distinct value with ties averaged."""
    return value_ranks(df, col).select(col, "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def p_adjust(df: DataFrame, p: str, method: str = "fdr-bh") -> DataFrame:
    """Adjusted value per distinct p: columns ``p`` and ``p_adj``."""
    ranks = value_ranks(df, p)
    m = df.agg(F.count(p).alias("m")).scalar()
    if method == "none":
        return ranks.select(p, F.col(p).alias("p_adj"))
    if method == "bonferroni":
        return ranks.select(p, F.least(F.lit(1.0), F.col(p) * m).alias("p_adj"))
    if method != "fdr-bh":
        raise ValueError(f"unknown correction {method}")
    raw = ranks.withColumn("q", F.col(p) * m / (F.col("below") + F.col("n")))
    low = running(raw, [], [p], F.floor(F.col(p) * 4096).cast("long"), [Run("p_adj", "min", F.col("q"), backward=True)])
    return low.select(p, F.least(F.lit(1.0), F.col("p_adj")).alias("p_adj"))


def segment_latency(df: DataFrame, keys: list[str], wall: str) -> DataFrame:
    """count, total, max and nearest-rank p50/p95 per group."""
    basic = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(wall).alias("total"), F.max(wall).alias("max"))
    pct = group_order_stats(df, keys, wall, {"p50": lambda n: F.ceil(n * 0.5), "p95": lambda n: F.ceil(n * 0.95)})
    return basic.join(pct, keys)


def throughput(df: DataFrame, section: str, rate: str) -> DataFrame:
    """Batches, median rate and max/min spread per section."""
    basic = df.groupBy(section).agg(F.count(F.lit(1)).alias("batches"), F.try_divide(F.max(rate), F.min(rate)).alias("spread"))
    mid = group_order_stats(df, [section], rate, {"lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.ceil((n + 1) / 2)})
    return basic.join(mid, section).select(section, "batches", ((F.col("lo") + F.col("hi")) / 2).alias("median_rate"), "spread")


def operation_index(df: DataFrame, op: str, ts: str, level: str, levels: list[str]) -> DataFrame:
    return df.groupBy(op).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
                              *[F.count_if(F.col(level) == v).alias(f"n_{v}") for v in levels])


def transitions(df: DataFrame, plane: str, order: list[str], block: Column, status: str, initial: str = "ready") -> DataFrame:
    """Rows whose status differs from the row before; every plane starts as ``initial``."""
    seen = running(df, [plane], order, block, [last_seen("_prev", order, F.col(status), inclusive=False)])
    prev = F.coalesce(F.col("_prev.v"), F.lit(initial))
    return seen.withColumn("from_status", prev).where(prev != F.col(status)).drop("_prev")


def health(df: DataFrame, plane: str, order: list[str], status: str) -> DataFrame:
    """Latest status per plane, ``held_back`` rank (unavailable first) and overall readiness."""
    latest = df.groupBy(plane).agg(F.max_by(status, F.struct(*order)).alias("status"))
    rank = F.when(F.col("status") == "unavailable", 0).when(F.col("status") == "degraded", 1)
    ready = latest.agg(F.bool_and(F.col("status") == "ready").alias("r")).scalar()
    return latest.withColumn("held_back", rank).withColumn("ready", ready)


def budget(df: DataFrame, plane: str, order: str, block: Column, spend: str, limit: Column) -> DataFrame:
    """First row per plane whose cumulative spend crosses the limit, with the projected total."""
    run = running(df, [plane], [order], block, [Run("projected", "sum", F.col(spend))])
    over = run.withColumn("limit", limit).where(F.col("projected") > F.col("limit"))
    return over.groupBy(plane).agg(F.min(order).alias("first_over"), F.min_by("projected", order).alias("projected"), F.min_by("limit", order).alias("limit"))


def lineage_groups(df: DataFrame, refs: Column, version: Column, evidence_id: str) -> DataFrame:
    """One group per sorted input set and method version, so one source counts once."""
    key = F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(refs)), ","), version), 256)
    return df.select(key.alias("lineage"), evidence_id).groupBy("lineage").agg(
        F.count(F.lit(1)).alias("evidence"), F.min(evidence_id).alias("first_id"))


def feedback_rollup(df: DataFrame, key: str, order: list[str], deleted: Column, rating: Column, category: Column) -> DataFrame:
    """Counts by rating and category over the latest record per key; a delete removes the key."""
    last = df.groupBy(key).agg(F.max_by(F.struct(deleted.alias("gone"), rating.alias("rating"), category.alias("category")), F.struct(*order)).alias("s"))
    return last.where("NOT s.gone").groupBy("s.rating", "s.category").agg(F.count(F.lit(1)).alias("n"))

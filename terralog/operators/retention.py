"""Newest-first selections: latest version, bounded history, pages and byte rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.text import utf8_tail
from terralog.plans.running import BLOCK_ROWS, Run, int_block, running


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as a combining aggregate: no sort, no key in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def newest(df: DataFrame, keys: list[str], order: list[str], block: Column, n: int) -> DataFrame:
    """Newest ``n`` rows per key; blocks that lie wholly behind the newest n are dropped unsorted."""
    return running(df, keys, order, block, [Run("age", "sum", F.lit(1).cast("long"), backward=True)],
                   keep=F.coalesce("_c0", F.lit(0)) < n).where(F.col("age") <= n)


def history(df: DataFrame, key: str, order: list[str], at: str, block: Column, days: int, n: int) -> DataFrame:
    """Rows within ``days`` of the newest and at most ``n``; ``pruned`` says whether any were left out."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("_total"), F.max(at).alias("_newest"))
    kept = newest(df, [key], order, block, n).join(total, key).where(F.col(at) >= F.col("_newest") - F.make_dt_interval(F.lit(days)))
    count = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_kept"))
    return kept.join(count, key).withColumn("pruned", F.col("_kept") < F.col("_total")).drop("_total", "_newest", "_kept", "age")


def page(df: DataFrame, order: str, before, limit: int) -> DataFrame:
    """Newest-first page below a cursor; ``next_before`` is the next cursor or null."""
    got = df.where(F.col(order) < before).orderBy(F.desc(order)).limit(limit + 1)
    edge = got.agg(F.count(F.lit(1)).alias("c"), F.array_sort(F.collect_list(order)).alias("o")).select(F.struct("c", "o").alias("e")).scalar()
    d = got.withColumn("_e", edge)
    more = F.col("_e.c") > limit
    floor = F.when(more, F.element_at("_e.o", 2)).otherwise(F.element_at("_e.o", 1))
    return d.where(F.col(order) >= floor).withColumn("next_before", F.when(more, floor)).drop("_e")


def ring(df: DataFrame, key: str, order: str, text: str, cap: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Newest chunks within a byte cap, with absolute offsets; a lone oversized chunk keeps its tail."""
    d = df.withColumn("bytes", F.octet_length(text)).where("bytes > 0")
    d = running(d, [key], [order], int_block(order, block_rows), [
        Run("at", "sum", F.col("bytes"), inclusive=False), Run("_left", "sum", F.col("bytes"), backward=True)])
    last = F.col("_left") == F.col("bytes")
    kept = d.where((F.col("_left") <= cap) | last)
    cut = F.col("bytes") > cap
    tail = utf8_tail(F.col(text), cap)
    size = F.octet_length(tail)
    return kept.select(key, order, (F.col("at") + F.when(cut, F.col("bytes") - size).otherwise(0)).alias("at"),
                       F.when(cut, size).otherwise(F.col("bytes")).alias("bytes"), cut.alias("gap_before"), tail.alias("text"))

"""Several sources on one event-time line, and per-advance quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.plans.ranking import with_range
from terralog.plans.running import BLOCK_ROWS, Run, int_block, running

# States of a source.
LIVE, FINISHED, PAUSED, FAILED = "live", "finished", "paused", "failed"


def source_union(sources: dict[str, DataFrame], event_id: str = "event_id") -> DataFrame:
    """Union of 2..8 sources (batch or stream) with ids named ``source::event``."""
    if not 2 <= len(sources) <= 8:
        raise ValueError("fusion needs 2 to 8 sources")
    tagged = [d.withColumn("source", F.lit(n)).withColumn("source_order", F.lit(i)).withColumn(
        event_id, F.concat_ws("::", F.lit(n), F.col(event_id).cast("string"))) for i, (n, d) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, tagged)


def fuse(sources: dict[str, DataFrame], states: dict[str, str]) -> DataFrame:
    """Released events in order (event time, declared source order, arrival) with their position.

    The horizon is the least of the live sources' largest event times. Finished sources do not hold
    it; paused and failed ones neither hold it nor release. Positions are counted per time range, so
    nothing is sorted as a whole table.
    """
    active = {n: d for n, d in sources.items() if states.get(n, LIVE) in (LIVE, FINISHED)}
    every = source_union(sources).where(F.col("source").isin(*active))
    live = [n for n in active if states.get(n, LIVE) == LIVE]
    if live:
        per = every.where(F.col("source").isin(*live)).groupBy("source").agg(F.max("ts").alias("m"))
        horizon = per.agg(F.when(F.count(F.lit(1)) == len(live), F.min("m")).alias("h")).scalar()
        every = every.withColumn("_h", horizon).where(F.col("ts") <= F.col("_h")).drop("_h")
    ranged = with_range(every.withColumn("_t", F.unix_micros("ts")), "_t")
    return running(ranged, [], ["ts", "source_order", "arrival", "event_id"], F.col("_range"),
                   [Run("position", "sum", F.lit(1).cast("long"))]).drop("_t", "_range")


def fuse_streams(sources: dict[str, DataFrame], lateness: str) -> DataFrame:
    """Streaming union; the session's ``multipleWatermarkPolicy=min`` keeps the slowest source in charge."""
    spark = next(iter(sources.values())).sparkSession
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    return source_union({n: d.withWatermark("ts", lateness) for n, d in sources.items()})


def quota(events: DataFrame, order: str, tick: str, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``advance`` in which each event is let through when at most ``n`` pass per advance.

    A queue in arrival order: slot = position + running maximum of (arrival tick * n - position),
    which carries every surplus forward and loses nothing.
    """
    d = running(events, [], [order], int_block(order, block_rows), [Run("_pos", "sum", F.lit(1).cast("long"))])
    d = running(d, [], [order], int_block(order, block_rows), [Run("_lead", "max", F.col(tick) * n - (F.col("_pos") - 1))])
    slot = F.col("_pos") - 1 + F.col("_lead")
    return d.withColumn("advance", F.floor(slot / n).cast("long")).drop("_pos", "_lead")

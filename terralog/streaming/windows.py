"""Event-time windows: admission, deduplication, tumbling aggregates and late revisions.

Functions on plain columns work on batch and streaming DataFrames alike. Late revisions need the
arrival order across all windows, which no single keyed state sees; they run per micro-batch over a
small table of window totals that is rewritten once per batch (``RevisionSink``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terralog.plans.running import BLOCK_ROWS, Run, int_block, running
from terralog.session import cut, scratch_path

SUMS = ("count", "sum", "lon_sum", "lat_sum")
LAND_TASKS = 4


def reject_reason(event_id: str = "event_id") -> Column:
    """First offending field of an event, or null."""
    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    text = F.col(event_id).cast("string")
    return (F.when(text.isNull() | (F.trim(text) == ""), "event_id").when(F.col("ts").isNull(), "ts")
            .when(~finite("lon") | ~F.col("lon").between(-180, 180), "lon").when(~finite("lat") | ~F.col("lat").between(-90, 90), "lat")
            .when(~finite("value"), "value"))


def admit(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with the field)."""
    tagged = events.withColumn("reject", reject_reason())
    return tagged.where("reject IS NULL").drop("reject"), tagged.where("reject IS NOT NULL")


def dedup_stream(stream: DataFrame, lateness: str) -> DataFrame:
    """First sight of an id wins; ids are forgotten once the watermark passes."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def dedup(events: DataFrame, order: list[str]) -> DataFrame:
    """Batch twin of ``dedup_stream``: the first arrival per id, as a combining aggregate."""
    rest = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("event_id", "r.*")


def totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.avg("value").alias("mean"), F.avg("lon").alias("mean_lon"), F.avg("lat").alias("mean_lat")]


def tumble(events: DataFrame, size: str) -> DataFrame:
    """Tumbling windows; on a stream, call it on a watermarked frame."""
    w = events.groupBy(F.window("ts", size)).agg(*totals())
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in w.columns if c != "window"])


def watermarked(events: DataFrame, order: str, lateness_s: float, prior: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Event, arrival and watermark time side by side: ``seen`` is the largest event time before a row."""
    t = F.unix_micros("ts")
    d = running(events.withColumn("_t", t), [], [order], int_block(order, block_rows), [Run("seen", "max", F.col("_t"), inclusive=False)])
    if prior is not None:
        d = d.withColumn("seen", F.greatest("seen", F.lit(prior).cast("long")))
    return d.withColumn("watermark", F.timestamp_micros(F.col("seen") - int(lateness_s * 1e6))).drop("_t")


def classify(events: DataFrame, order: str, size_s: int, lateness_s: int, prior: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``kind`` per event: on-time while its window is open, late within the lateness, else expired."""
    d = watermarked(events, order, lateness_s, prior, block_rows)
    size = size_s * 1_000_000
    start = F.floor(F.unix_micros("ts") / F.lit(size)).cast("long") * size
    end = start + size
    kind = (F.when(F.col("seen").isNull() | (F.col("seen") < end), "on-time").when(F.col("seen") < end + lateness_s * 1_000_000, "late").otherwise("expired"))
    return d.withColumn("window_start", F.timestamp_micros(start)).withColumn("kind", kind)


def _measures() -> dict[str, Column]:
    return {"count": F.lit(1).cast("long"), "sum": F.col("value"), "lon_sum": F.col("lon"), "lat_sum": F.col("lat")}


def _published(df: DataFrame) -> DataFrame:
    return df.select("window_start", "revision", "count", "sum", "min", "max", (F.col("sum") / F.col("count")).alias("mean"),
                     (F.col("lon_sum") / F.col("count")).alias("mean_lon"), (F.col("lat_sum") / F.col("count")).alias("mean_lat"))


def late_revisions(classified: DataFrame, order: str, max_revisions: int, state: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Revision 1 is the on-time total of a window; each late event adds one revision up to the maximum.

    ``state`` brings totals and the late and on-time counts of earlier batches.
    """
    m = _measures()
    base = classified.where("kind = 'on-time'").groupBy("window_start").agg(
        *[F.sum(c).alias(n) for n, c in m.items()], F.min("value").alias("min"), F.max("value").alias("max"))
    base = base.withColumns({"late_n": F.lit(0).cast("long"), "on_n": F.col("count")})
    if state is not None:
        both = state.select(base.columns).unionByName(base)
        base = both.groupBy("window_start").agg(*[F.sum(n).alias(n) for n in (*SUMS, "late_n", "on_n")], F.min("min").alias("min"), F.max("max").alias("max"))
    late = classified.where("kind = 'late'").withColumns({f"_{n}": c for n, c in m.items()})
    run = running(late, ["window_start"], [order], int_block(order, block_rows), [
        Run("nth", "sum", F.lit(1).cast("long")), *[Run(f"r_{n}", "sum", F.col(f"_{n}")) for n in SUMS],
        Run("r_min", "min", F.col("value")), Run("r_max", "max", F.col("value"))])
    j = run.join(base, "window_start", "left")
    # a window that never had an on-time event has no on-time revision before its late ones
    first = F.when(F.col("on_n") > 0, 1).otherwise(0)
    rev = first + F.coalesce("late_n", F.lit(0)) + F.col("nth")
    more = j.select("window_start", rev.cast("long").alias("revision"), *[(F.coalesce(n, F.lit(0)) + F.col(f"r_{n}")).alias(n) for n in SUMS],
                    F.least("min", "r_min").alias("min"), F.greatest("max", "r_max").alias("max")).where(F.col("revision") <= max_revisions)
    one = base.where("late_n = 0 AND on_n > 0").select("window_start", F.lit(1).cast("long").alias("revision"), *SUMS, "min", "max")
    return _published(one.unionByName(more))


def late_counts(classified: DataFrame) -> DataFrame:
    """How many events were on time, late and expired."""
    return classified.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def window_digest(revisions: DataFrame) -> DataFrame:
    """Digest of (from, revision, aggregate); values enter at micro precision, so it is engine-independent."""
    micro = [F.round(F.col(c) * 1_000_000, 0).cast("long").cast("string") for c in ("sum", "min", "max", "mean", "mean_lon", "mean_lat")]
    text = F.concat_ws("|", F.unix_micros("window_start").cast("string"), F.col("revision").cast("string"), F.col("count").cast("string"), *micro)
    return revisions.select("window_start", "revision", F.sha2(text, 256).alias("digest"))


def retain_windows(revisions: DataFrame, windows: int, per_window: int) -> DataFrame:
    """Newest ``windows`` windows, and the newest ``per_window`` revisions of each."""
    from terralog.operators.retention import newest
    recent = revisions.select("window_start").distinct().orderBy(F.desc("window_start")).limit(windows)
    kept = revisions.join(recent, "window_start", "left_semi")
    return newest(kept, ["window_start"], ["revision"], int_block("revision"), per_window).drop("age")


def insert_only(new: DataFrame, published: DataFrame) -> DataFrame:
    """Rows whose (window, revision) is not published yet; a published row is never rewritten."""
    return new.join(published.select("window_start", "revision"), ["window_start", "revision"], "left_anti")


@dataclass
class RevisionSink:
    """``foreachBatch`` target that publishes window revisions with durable, replayable state.

    Each batch writes ``state/<epoch>`` and ``out/<epoch>`` from ``state/<epoch-1>``; a replay of the
    same epoch overwrites exactly its own folders.
    """

    root: str
    size_s: int
    lateness_s: int
    max_revisions: int
    order: str = "arrival"

    STATE = ("window_start timestamp, count long, sum double, lon_sum double, lat_sum double, late_n long, on_n long, min double, max double, "
             "published boolean, max_seen long")

    def _state(self, spark: SparkSession, epoch: int) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], self.STATE)
        return spark.read.schema(self.STATE).parquet(f"{self.root}/state/{epoch}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = self._state(spark, epoch - 1)
        prior = old.agg(F.max("max_seen").alias("m")).first()["m"]
        rows = cut(classify(batch, self.order, self.size_s, self.lateness_s, prior), "batch")
        seen = rows.agg(F.max(F.greatest(F.unix_micros("ts"), F.coalesce("seen", F.lit(0)))).alias("m")).first()["m"]
        seen = max(v for v in (seen, prior, 0) if v is not None)
        revs = cut(late_revisions(rows, self.order, self.max_revisions, old), "revisions")
        m = _measures()
        both = ("on-time", "late")
        part = rows.where(F.col("kind").isin(*both)).groupBy("window_start").agg(
            *[F.sum(c).cast(t).alias(n) for (n, c), t in zip(m.items(), ("long", "double", "double", "double"))],
            F.count_if(F.col("kind") == "late").alias("late_n"), F.count_if(F.col("kind") == "on-time").alias("on_n"), F.min("value").alias("min"), F.max("value").alias("max"))
        merged = old.select(part.columns).unionByName(part).groupBy("window_start").agg(
            *[F.sum(n).alias(n) for n in (*SUMS, "late_n", "on_n")], F.min("min").alias("min"), F.max("max").alias("max"))
        closed = F.unix_micros("window_start") + self.size_s * 1_000_000 <= seen
        was = old.where("published").select("window_start", F.lit(True).alias("_was"))
        out = revs.join(was, "window_start", "left").where(closed & ((F.col("revision") > 1) | F.col("_was").isNull())).drop("_was")
        out.write.mode("overwrite").parquet(f"{self.root}/out/{epoch}")
        # windows that can no longer change leave the state; one row keeps the watermark
        live = F.unix_micros("window_start") + (self.size_s + self.lateness_s) * 1_000_000 > seen
        newest = merged.agg(F.max("window_start").alias("m")).scalar()
        (merged.withColumn("_top", newest).where(live | (F.col("window_start") == F.col("_top"))).drop("_top")
         .withColumn("published", closed).withColumn("max_seen", F.lit(seen).cast("long"))
         .select([c.split()[0] for c in self.STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/state/{epoch}"))

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/out/*")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available and stop; the checkpoint resumes it later."""
    q: StreamingQuery = (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
                         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def land(events: DataFrame, order: str, slices: int, path: str | None = None, tasks: int = LAND_TASKS) -> str:
    """Replay helper: write events as ``slices`` slices of ``tasks`` files one after the other, so that a file stream
    (which goes by modification time) of as many files a trigger delivers them in arrival order."""
    path = path or scratch_path(events.sparkSession, "landing")
    staged = cut(events, "slices")
    edge = staged.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    step = (edge["hi"] - edge["lo"]) // slices + 1
    for i in range(slices):
        lo = edge["lo"] + i * step
        staged.where((F.col(order) >= lo) & (F.col(order) < lo + step)).repartition(tasks).write.mode("append").parquet(path)
    return path

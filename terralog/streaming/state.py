"""Window revisions and source fusion in Spark's keyed state.

Both operators hold back what is not decided yet in the state store and act on event-time timers, so memory is bounded by open windows and by
events above the horizon, a restart goes on from the checkpoint, and evicted keys leave the store. The clock is the stream's watermark:
``seen`` is the largest event time of earlier triggers. The watermark runs ``delay`` behind it, so that Spark keeps rows that are still
admissible; timers are set back by the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from math import isnan, nan
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terralog.plans.running import Run, running
from terralog.session import scratch_path
from terralog.streaming.fusion import FAILED, FINISHED, LIVE, PAUSED, source_union

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH_ID = "streaming.sql.batchId"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


# ---- window revisions -----------------------------------------------------------------------

TOTALS = "count long, sum double, lon_sum double, lat_sum double, min double, max double"
OUT = f"kind string, window_start timestamp, revision long, {TOTALS}"
PUBLISHED, RETIRED, EXPIRED, SURPLUS = "published", "retired", "expired", "surplus"
MS = 1000


WINDOWS, LANES = 32, 8             # a key costs as much as hundreds of events, so it holds many windows; neighbours are in different ones


def _micros(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


@dataclass
class Window:
    """Totals of one window, its on-time and late rows, and whether its end was seen. A missing value counts as a row and adds to no total."""

    start: int
    count: int = 0
    sum: float = 0.0
    lon_sum: float = 0.0
    lat_sum: float = 0.0
    min: float = nan
    max: float = nan
    on_n: int = 0
    late_n: int = 0
    published: bool = False

    SCHEMA = f"start long, {TOTALS}, on_n long, late_n long, published boolean"

    def row(self) -> tuple:
        return tuple(vars(self).values())

    def totals(self) -> tuple:
        return self.row()[1:7]

    def add(self, count: int, value: float, lon: float, lat: float, low: float, high: float) -> None:
        self.count += int(count)
        self.sum, self.lon_sum, self.lat_sum = self.sum + float(value), self.lon_sum + float(lon), self.lat_sum + float(lat)
        self.min, self.max = float(np.fmin(self.min, low)), float(np.fmax(self.max, high))


@dataclass
class Late:
    """Late rows of one window in a trigger: how many came, and the first of them in order."""

    came: int
    first: list[tuple]


@dataclass
class WindowRevisions(StatefulProcessor):
    """State of the windows of one key: totals, on-time and late counts, as one value that is read and written once a trigger.

    Rows count as on-time while the window's end is not seen, then as late until ``late_ms`` after it, then as expired. The on-time total is
    revision 1, published when the end is seen; each late row in order adds one, up to ``max_revisions``. Later ones are counted as surplus, expired ones as
    expired. At most ``keep_revisions`` revisions of a window are kept, and a window ``keep_ms`` after its end; what goes is told as retired. Kept revisions need no state of
    their own: they are the newest ones, and each has one row more than the one before. A trigger's rows pass frame by frame: only the next revisions' rows are held, whatever the
    number of late rows. One timer stands at the time when the first of the windows has something to do.
    """

    size_ms: int
    late_ms: int
    delay_ms: int
    max_revisions: int
    keep_revisions: int
    keep_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("windows", f"timer long, windows array<struct<{Window.SCHEMA}>>")

    def close(self) -> None:
        pass

    def _seen(self, timers: Any) -> int | None:
        mark = timers.getCurrentWatermarkInMs()
        return mark + self.delay_ms if mark > 0 else None

    def _load(self) -> tuple[int | None, dict[int, Window]]:
        held = self.held.get()
        return (held[0], {w[0]: Window(*w) for w in held[1]}) if held else (None, {})

    def _last(self, w: Window) -> int:
        """Number of the newest revision of a window whose end was seen."""
        first = 1 if w.on_n else 0
        return max(first, min(first + w.late_n, self.max_revisions))

    def _revision(self, out: list, w: Window, revision: int) -> None:
        out.append((PUBLISHED, _micros(w.start), revision, *w.totals()))
        if revision > self.keep_revisions:
            out.append((RETIRED, _micros(w.start), revision - self.keep_revisions, w.count - self.keep_revisions, *[None] * 5))

    def _fold(self, frame: pd.DataFrame, seen: int | None, windows: dict[int, Window], late: dict[int, Late], expired: dict[int, int]) -> None:
        """Rows of one frame go to their windows by kind; all rows a window has in a trigger are of one kind."""
        starts = frame["start_ms"].to_numpy()
        order = np.argsort(starts, kind="stable")
        starts, cells = starts[order], frame[["value", "lon", "lat"]].to_numpy(dtype=float)[order]
        ords = frame["ord"].to_numpy()[order]
        cuts = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1]])
        # summed along rows of memory, where numpy adds in pairs and loses less than one after the other
        filled = np.ascontiguousarray(np.where(np.isnan(cells), 0.0, cells).T)
        low, high = np.fmin.reduceat(cells[:, 0], cuts), np.fmax.reduceat(cells[:, 0], cuts)
        for k, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)])):
            start = int(starts[a])
            end = start + self.size_ms
            if seen is None or seen < end:
                w = windows.setdefault(start, Window(start))
                w.add(b - a, *filled[:, a:b].sum(axis=1), low[k], high[k])
                w.on_n += b - a
            elif seen >= end + self.late_ms:
                expired[start] = expired.get(start, 0) + b - a
            else:
                w = windows.setdefault(start, Window(start))
                rows = late.setdefault(start, Late(0, []))
                room = max(self.max_revisions - (1 if w.on_n else 0) - w.late_n, 0)
                next_ = a + np.lexsort((cells[a:b, 2], cells[a:b, 1], cells[a:b, 0], ords[a:b]))[:room]
                rows.came += b - a
                rows.first = sorted([*rows.first, *((ords[i], *cells[i].tolist()) for i in next_)])[:room]

    def _settle(self, seen: int | None, windows: dict[int, Window], late: dict[int, Late], out: list) -> None:
        """What is due by now: the first revisions, those of late rows, and windows that go."""
        if seen is None:
            return
        for w in [w for w in windows.values() if seen >= w.start + self.size_ms]:
            if not w.published:
                w.published = True
                if w.on_n:
                    self._revision(out, w, 1)
            if rows := late.get(w.start):
                for _, *cells in rows.first:
                    value, lon, lat = (0.0 if isnan(c) else c for c in cells)
                    w.add(1, value, lon, lat, cells[0], cells[0])
                    w.late_n += 1
                    self._revision(out, w, self._last(w))
                if surplus := rows.came - len(rows.first):
                    out.append((SURPLUS, _micros(w.start), None, surplus, *[None] * 5))
                    w.late_n += surplus
            if seen >= w.start + self.size_ms + max(self.late_ms, self.keep_ms):
                if self.keep_ms:
                    last = self._last(w)
                    out += [(RETIRED, _micros(w.start), r, w.count - (last - r), *[None] * 5) for r in range(max(last - self.keep_revisions, 0) + 1, last + 1)]
                del windows[w.start]

    def _store(self, timer: int | None, windows: dict[int, Window]) -> None:
        if not windows:
            self.held.clear()
            return
        after = max(self.late_ms, self.keep_ms)
        due = min(w.start + self.size_ms + (after if w.published else 0) for w in windows.values()) - self.delay_ms
        if due != timer:
            self.handle.registerTimer(due)
        self.held.update((due, [w.row() for w in windows.values()]))

    @staticmethod
    def _frame(out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen, out, late, expired = self._seen(timerValues), [], {}, {}
        timer, windows = self._load()
        had = bool(windows)
        for frame in rows:
            if len(frame):
                self._fold(frame, seen, windows, late, expired)
        out += [(EXPIRED, _micros(start), None, n, *[None] * 5) for start, n in expired.items()]
        self._settle(seen, windows, late, out)
        if had or windows:
            self._store(timer, windows)
        yield from self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        timer, windows = self._load()
        if not windows or timer > expiredTimerInfo.getExpiryTimeInMs():
            return
        out: list = []
        self._settle(self._seen(timerValues), windows, {}, out)
        self._store(timer, windows)
        yield from self._frame(out)


def revision_stream(stream: DataFrame, size_s: int, lateness_s: int, max_revisions: int, keep_revisions: int | None = None, keep_s: int = 0) -> DataFrame:
    """A log of what happens to windows of ``ts, value, lon, lat, ord``: ``kind, window_start, revision`` and totals.

    ``published`` rows are revisions, ``retired`` ones tell that a revision is kept no longer (more than ``keep_revisions`` newer ones, or ``keep_s`` after the window's end; 0 keeps
    it), ``surplus`` and ``expired`` rows carry a count. Rows that are ``lateness_s`` and a window behind may be dropped by Spark itself, and are in its progress figures. Equal to
    ``classify_by_trigger`` and ``late_revisions`` over the same triggers.
    """
    use_state_store(stream.sparkSession)
    delay = lateness_s + size_s
    start = (F.floor(F.unix_millis("ts") / (size_s * MS)) * (size_s * MS)).cast("long")
    nth = F.floor(F.col("start_ms") / (size_s * MS)).cast("long")
    key = F.floor(nth / (WINDOWS * LANES)).cast("long") * LANES + F.pmod(nth, F.lit(LANES))
    rows = stream.withWatermark("ts", f"{delay} seconds").withColumn("start_ms", start).select(key.alias("key"), "start_ms", "ts", "ord", "value", "lon", "lat")
    step = WindowRevisions(size_s * MS, lateness_s * MS, delay * MS, max_revisions, keep_revisions or max_revisions, keep_s * MS)
    return rows.groupBy("key").transformWithStateInPandas(step, OUT, "append", "EventTime")


def classify_by_trigger(events: DataFrame, trigger: str, size_s: int, lateness_s: int) -> DataFrame:
    """Batch twin of the stream's clock: ``kind`` and ``window_start`` per event, where ``seen`` is the largest event time of earlier triggers."""
    # one row per trigger
    tops = running(events.groupBy(trigger).agg(F.max("ts").alias("_top")), [], [trigger], F.lit(0), [Run("seen", "max", F.date_trunc("millisecond", F.col("_top")), inclusive=False)])
    d = events.join(tops.select(trigger, F.unix_micros("seen").alias("seen")), trigger)
    size = size_s * 1_000_000
    start = (F.floor(F.unix_micros("ts") / size) * size).cast("long")
    late = F.col("seen") < start + size + lateness_s * 1_000_000
    kind = F.when(F.col("seen").isNull() | (F.col("seen") < start + size), "on-time").when(late, "late").otherwise("expired")
    return d.withColumn("window_start", F.timestamp_micros(start)).withColumn("kind", kind)


def retained(log: DataFrame) -> DataFrame:
    """Revisions of a log that were published and not retired."""
    gone = log.where(F.col("kind") == RETIRED).select("window_start", "revision")
    return log.where(F.col("kind") == PUBLISHED).join(gone, ["window_start", "revision"], "left_anti").drop("kind")


@dataclass
class InsertOnly:
    """``foreachBatch`` target that publishes each (window, revision) once, into folders by day.

    A trigger that is run again, or a whole stream that is read anew, finds its rows published and adds nothing; a published row is never rewritten.
    Only the days of the trigger are read for the comparison.
    """

    root: str

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("kind") == PUBLISHED).drop("kind").dropDuplicates(["window_start", "revision"]).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
        before = self.result(spark)
        if before is not None:
            rows = rows.join(before.select("day", "window_start", "revision"), ["day", "window_start", "revision"], "left_anti").select(*rows.columns)
        # what is read is listed when the plan is made, so the files written here are not among it
        rows.write.partitionBy("day").mode("append").parquet(self.root)

    def result(self, spark: SparkSession) -> DataFrame | None:
        schema = f"window_start timestamp, revision long, {TOTALS}, day string"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(schema).parquet(self.root)


# ---- fusion ---------------------------------------------------------------------------------

EVENT = "source string, source_order int, event_id string, ts timestamp, arrival long, at_ms long"
RELEASED = f"release long, {EVENT.rsplit(', ', 1)[0]}"
BUCKET_S = 3600                    # a key costs as much as hundreds of events


@dataclass
class HoldBack(StatefulProcessor):
    """Events of one time bucket and lane that the horizon has not reached, or whose source is not released now.

    A timer stands at the earliest event time that is still to be released. Events of a bucket that the horizon has not come to are only added: what is held already is
    neither read nor written again. Order is told by columns, so lanes of a bucket need not meet in one task.
    """

    delay_ms: int
    active: tuple[str, ...]
    bucket_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)

    def close(self) -> None:
        pass

    def _advance(self, new: list[tuple], timers: Any, fired: int | None = None) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs()
        horizon = mark + self.delay_ms if mark > 0 else None
        held, out, wake = [], [], None
        release = int(TaskContext.get().getLocalProperty(BATCH_ID))
        for e in [*(tuple(r) for r in self.events.get()), *new]:
            due = e[-1] - self.delay_ms
            if horizon is not None and e[-1] <= horizon:
                if e[0] in self.active:
                    out.append((release, *e[:-1]))
                    continue
                # looked at again in the next trigger: its source may be live then. A timer that has just fired is deleted after this call
                due = mark - (fired == mark)
            held.append(e)
            wake = due if wake is None else min(wake, due)
        if held:
            self.events.put(held)
            self.handle.registerTimer(wake)
        else:
            self.events.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RELEASED.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENT.split(", ")]
        mark = timerValues.getCurrentWatermarkInMs()
        ahead = mark <= 0 or mark + self.delay_ms < int(key[0]) * self.bucket_ms
        for frame in rows:
            new = [(s, int(o), i, t.to_pydatetime(), int(a), int(m)) for s, o, i, t, a, m in frame[names].itertuples(index=False)]
            if not ahead:
                yield from self._advance(new, timerValues)
            elif new:
                self.events.appendList(new)
                self.handle.registerTimer(min(e[-1] for e in new) - self.delay_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues, expiredTimerInfo.getExpiryTimeInMs())


def fuse_streams(sources: dict[str, DataFrame], states: dict[str, str], delay_s: int, bucket_s: int = BUCKET_S, lanes: int = 4) -> DataFrame:
    """Released events of 2..8 streams (``event_id, ts, arrival``): ``release`` (the trigger), then source, order, id, time and arrival.

    The horizon of a trigger is the least of the live sources' largest event times in earlier triggers; an event goes out in the first trigger after its own whose horizon has reached
    it. Finished sources do not hold the horizon; without live ones it is the largest time of all. Paused and failed sources neither hold it nor release: their events stay in state
    and go out once the source is live again. A change of states is a restart with the same checkpoint. Without a live or finished source nothing can be released, which is refused as
    ``offline``. No event is too
    late: the time is a computed column, so Spark drops none. ``delay_s`` sets the watermark back; it must be less than the age of the first event since 1970.
    """
    spark = next(iter(sources.values())).sparkSession
    use_state_store(spark)
    state = {n: states.get(n, LIVE) for n in sources}
    if unknown := set(state.values()) - {LIVE, FINISHED, PAUSED, FAILED}:
        raise ValueError(f"unknown source state {sorted(unknown)}")
    active = tuple(n for n in sources if state[n] in (LIVE, FINISHED))
    if not active:
        raise ValueError("offline: no live or finished source")
    live = [n for n in active if state[n] == LIVE]
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    # the order of the sources is that of the checkpoint, whatever their states
    every = source_union({n: d.withWatermark("ts", f"{delay_s} seconds") if n in live else d for n, d in sources.items()})
    if not live:
        every = every.withWatermark("ts", f"{delay_s} seconds")
    # the horizon is the query's watermark; as a computed column the time itself is not dropped for being late
    every = every.withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))
    bucket, lane = F.floor(F.unix_seconds("ts") / bucket_s).cast("long"), F.pmod(F.xxhash64("event_id"), F.lit(lanes)).cast("int")
    rows = every.withColumn("at_ms", F.unix_millis("ts")).select(bucket.alias("bucket"), lane.alias("lane"), *[c.split()[0] for c in EVENT.split(", ")])
    return rows.groupBy("bucket", "lane").transformWithStateInPandas(HoldBack(delay_s * MS, active, bucket_s * MS), RELEASED, "append", "EventTime")


def positions(released: DataFrame) -> DataFrame:
    """``position`` of every released event: by trigger, event time, declared order of sources, arrival."""
    at = F.struct("release", F.floor(F.unix_seconds("ts") / 3600).alias("hour"))
    return running(released, [], ["release", "ts", "source_order", "arrival", "event_id"], at, [Run("position", "sum", F.lit(1).cast("long"))])


def run_log(stream: DataFrame, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over everything available into Parquet and read its whole log."""
    from terralog.streaming.windows import run_available
    spark = stream.sparkSession
    path = path or scratch_path(spark, "log")
    run_available(stream, path, checkpoint or scratch_path(spark, "ck"))
    return spark.read.schema(stream.schema).parquet(path)

"""Windows of a revision stream share keys: what that costs, and that every window still gets its own revisions."""

from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralog.session import scratch_path
from terralog.streaming import state

SIZE, LATE, DAY = 60_000, 120_000, 1_700_006_400_000


class Held:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, Counter()

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def clear(self):
        self.value = None


def play(triggers, most, keep, keep_ms, size=SIZE, late=LATE, frame_rows=5):
    """The log of one key over triggers of (ord, ms, value) and a trigger without rows, and its state."""
    held, timers, log, mark, top, delay = Held(), set(), [], 0, None, size + late
    step = state.WindowRevisions(size, late, delay, most, keep, keep_ms)
    step.init(SimpleNamespace(getValueState=lambda *a: held, registerTimer=timers.add))
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    for rows in [*triggers, []]:
        mark = 0 if top is None else max(mark, top - delay)
        d = pd.DataFrame([(ms // size * size, o, v, 1.0, 2.0) for o, ms, v in rows], columns=["start_ms", "ord", "value", "lon", "lat"])
        outs = list(step.handleInputRows((0,), (d[i:i + frame_rows] for i in range(0, len(d), frame_rows)), clock)) if rows else []
        for t in sorted(t for t in timers if t <= mark):
            outs += step.handleExpiredTimer((0,), clock, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
            timers.discard(t)
        log += [r for o in outs for r in o.itertuples(index=False)]
        top = max([ms for _, ms, _ in rows] + ([] if top is None else [top]))
    return log, held, timers


def plain(triggers, most, size=SIZE, late=LATE):
    """Revisions (start, revision, count, sum), surplus and expired rows by the rule alone."""
    seen, on, after, expired = None, defaultdict(list), defaultdict(list), Counter()
    for rows in triggers:
        for o, ms, v in sorted(rows):
            end = ms // size * size + size
            if seen is None or seen < end:
                on[end - size].append(v)
            elif seen < end + late:
                after[end - size].append(v)
            else:
                expired[end - size] += 1
        seen = max([ms for _, ms, _ in rows] + ([] if seen is None else [seen]))
    out, surplus = [], {}
    for start in sorted({*on, *after}):
        if start + size > seen:
            continue
        first = 1 if on[start] else 0
        out += [(start, 1, len(on[start]), sum(on[start]))] * first
        room = most - first
        out += [(start, first + k, len(on[start]) + k, sum(on[start]) + sum(after[start][:k])) for k in range(1, min(room, len(after[start])) + 1)]
        if len(after[start]) > room:
            surplus[start] = len(after[start]) - room
    return out, surplus, dict(expired)


def ms_of(t):
    return int(pd.Timestamp(t, tz="UTC").timestamp() * 1000)


@pytest.mark.parametrize("seed", range(6))
def test_windows_of_a_key_do_not_mix(seed):
    rng = np.random.default_rng(seed)
    triggers, o = [], 0
    for k in range(6):
        ms = DAY + (rng.integers(0, 400, 25) + 60 * k * (seed % 3 + 1)) * 1000
        triggers.append([(o + j, int(m), float(j)) for j, m in enumerate(ms)])
        rng.shuffle(triggers[-1])
        o += 25
    most, keep, keep_ms = 4, 2 + seed % 3, (0, 300_000)[seed % 2]
    log, held, timers = play(triggers, most, keep, keep_ms)
    revisions, surplus, expired = plain(triggers, most)
    published = sorted((ms_of(r.window_start), int(r.revision), r.count, r.sum) for r in log if r.kind == state.PUBLISHED)
    assert published == revisions and any(r[1] == 4 for r in revisions) and expired
    for kind, want in ((state.SURPLUS, surplus), (state.EXPIRED, expired)):
        got = Counter()
        for r in log:
            got[ms_of(r.window_start)] += r.count if r.kind == kind else 0
        assert +got == Counter(want)
    # what goes was there, goes once, and with the count it was published with
    gone = [(ms_of(r.window_start), int(r.revision), r.count) for r in log if r.kind == state.RETIRED]
    assert len(gone) == len(set(gone)) and set(gone) <= {r[:3] for r in published}
    left, seen = {r[:2] for r in published} - {r[:2] for r in gone}, max(ms for t in triggers for _, ms, _ in t)
    newest = {s: r for s, r, *_ in published}
    assert left == {(s, r) for s, r, *_ in published if r > newest[s] - keep and not (keep_ms and seen >= s + SIZE + max(LATE, keep_ms))}
    assert [w[0] for w in held.value[1]] and len([t for t in timers if t == held.value[0]]) == 1


def test_a_key_is_read_and_written_once_a_trigger():
    rows = [(k, DAY + k * 1000, 1.0) for k in range(64 * 60)]
    log, held, timers = play([rows, [(9999, DAY + 10**9, 1.0)]], 4, 4, 0, frame_rows=10**6)
    # two triggers with rows, two sets of timers
    assert sum(r.kind == state.PUBLISHED for r in log) == 64 and held.calls["get"] <= 4 and held.calls["update"] <= 4 and len(timers) == 1


def test_a_missing_value_adds_to_no_total():
    first, second = [(0, DAY, float("nan")), (1, DAY + 1, 2.0)], [(2, DAY + 100_000, 1.0)]
    log, *_ = play([first, second, [(3, DAY + 2, float("nan"))]], 4, 4, 0)
    assert [(r.revision, r.count, r.sum, r.min, r.max) for r in log if ms_of(r.window_start) == DAY] == [(1, 2, 2.0, 2.0, 2.0), (2, 3, 2.0, 2.0, 2.0)]


def test_state_has_fewer_keys_than_windows(spark):
    path = scratch_path(spark, "landing")
    spark.range(600).select(F.col("id").alias("ord"), F.timestamp_seconds(F.lit(DAY // 1000) + F.col("id") * 30).alias("ts"), F.lit(1.0).alias("value"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = scratch_path(spark, "log")
    q = state.revision_stream(stream, 60, 120, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress) <= 24
    assert spark.read.parquet(out).where("kind = 'published' AND count = 2 AND revision = 1").count() == 299

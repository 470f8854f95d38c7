"""Keyed state: revisions and fusion over triggers, with restarts, against batch twins and plain Python."""

import pytest
from pyspark.sql import functions as F

from terralog.session import scratch_path
from terralog.streaming import fusion, state, windows

DAY = 1_700_000_000 // 86400 * 86400


def land(spark, events, names, path=None):
    """One file a trigger."""
    path = path or scratch_path(spark, "landing")
    for rows in events:
        spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.createDataFrame([], names).withColumn("ts", F.timestamp_seconds("s")).schema
    return path, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


NAMES = "ord long, s long, value double, lon double, lat double"


def told(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def triggers(*seconds):
    out, n = [], 0
    for batch in seconds:
        out.append([(n + k + 1, DAY + s, float(n + k), 1.0, 2.0) for k, s in enumerate(batch)])
        n += len(batch)
    return out


# windows of a minute, two minutes of lateness
STORY = triggers([0, 30, 10], [70, 5, 130], [20, 25, 28, 29, 31, 75], [300, 80], [85, 10, 310], [600])


def test_revisions_in_state(spark):
    path, stream = land(spark, STORY[:3], NAMES)
    out, ck = scratch_path(spark, "log"), scratch_path(spark, "ck")

    def run(stream):
        return state.run_log(state.revision_stream(stream, 60, 120, 3, keep_revisions=2), ck, out)
    run(stream)
    log = run(land(spark, STORY[3:], NAMES, path)[1])
    at = F.unix_seconds("window_start") - DAY
    published = told(log.where("kind = 'published'"), at, "revision", "count", "sum", "min", "max")
    # the first window: on time 0, 30, 10 and 5 s; late 20 and 25 s are applied, 28, 29 and 31 s are surplus
    assert published[:3] == [(0, 1, 4, 7.0, 0.0, 4.0), (0, 2, 5, 13.0, 0.0, 6.0), (0, 3, 6, 20.0, 0.0, 7.0)]
    assert told(log.where("kind = 'surplus'"), at, "count") == [(0, 3)]
    assert told(log.where("kind = 'expired'"), at, "count") == [(0, 1), (60, 1)]
    assert told(log.where("kind = 'retired'"), at, "revision") == [(0, 1), (60, 1)]
    rows = [(k, *r) for k, batch in enumerate(STORY) for r in batch]
    batch = spark.createDataFrame(rows, "trigger long, " + NAMES).withColumn("ts", F.timestamp_seconds("s"))
    twin = windows.late_revisions(state.classify_by_trigger(batch, "trigger", 60, 120), "ord", 3).where(at + 60 <= 600)
    assert published == told(twin, at, "revision", "count", "sum", "min", "max")


def test_late_first_window_and_eviction(spark):
    story = triggers([200], [90], [95, 400], [1000], [2000])
    path, stream = land(spark, story, NAMES)
    log = state.run_log(state.revision_stream(stream, 60, 120, 5, keep_s=700))
    at = F.unix_seconds("window_start") - DAY
    assert set(told(log.where("kind = 'published'"), at, "revision", "count")) == {(60, 1, 1), (60, 2, 2), (180, 1, 1), (360, 1, 1), (960, 1, 1)}
    # kept seven hundred seconds after their end: at 2000 s all of them are gone, the last window is still open
    assert state.retained(log).count() == 0
    log = state.run_log(state.revision_stream(land(spark, story, NAMES)[1], 60, 120, 5, keep_s=1000))
    assert told(state.retained(log), at, "revision") == [(960, 1)]


def test_insert_only_publish(spark):
    path, stream = land(spark, STORY, NAMES)
    sink = state.InsertOnly(scratch_path(spark, "published"))
    assert sink.result(spark) is None
    seen = []
    for _ in range(2):
        q = state.revision_stream(stream, 60, 120, 3).writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(told(sink.result(spark), "window_start", "revision", "count"))
    assert seen[0] == seen[1] and len(seen[0]) == len({r[:2] for r in seen[0]}) > 4


FUSED = "event_id string, arrival long, s long"


def plain_fusion(batches, states, start=0, horizon=None, held=()):
    """Triggers of one run and the one without events after them: released (trigger, time, order, arrival, id), what is held, and the horizon."""
    held, out, tops = list(held), [], {}
    for k in range(len(batches[0]) + 1):
        if k and all(tops.get(i) is not None for i, s in enumerate(states) if s == "live"):
            clocks = [tops[i] for i, s in enumerate(states) if s == "live"]
            least = min(clocks) if clocks else max(tops.values())
            horizon = max(horizon or 0, least)
        for i, source in enumerate(batches):
            for e, a, s in source[k] if k < len(source) else []:
                held.append((s, i, a, f"s{i}::{e}"))
                tops[i] = max(tops.get(i) or 0, s)
        go = [h for h in held if horizon is not None and h[0] <= horizon and states[h[1]] in ("live", "finished")]
        out += [(start + k, *g) for g in go]
        held = [h for h in held if h not in go]
    return out, held, horizon


def runs(spark, parts):
    """Parts are (batches by source, states) of one run each, over one checkpoint."""
    out, ck, paths = scratch_path(spark, "released"), scratch_path(spark, "ck"), {}
    want, held, horizon, at = [], (), None, 0
    for batches, states in parts:
        streams = {}
        for i, source in enumerate(batches):
            paths[i], streams[f"s{i}"] = land(spark, source, FUSED, paths.get(i))
        log = state.run_log(state.fuse_streams(streams, {f"s{i}": s for i, s in enumerate(states)}, 86400, bucket_s=7, lanes=3), ck, out)
        more, held, horizon = plain_fusion(batches, states, at, horizon, held)
        want += more
        at += len(batches[0]) + 1
    got = [r.event_id for r in state.positions(log).orderBy("position").collect()]
    return got, [w[-1] for w in sorted(want)], held


def source(seed, count, start):
    import numpy as np
    rng = np.random.default_rng(seed)
    return [[(f"e{start + k * count + j}", start + k * count + j, DAY + int(100 * k + rng.integers(0, 160)) + 4 * start) for j in range(count)] for k in range(2)]


def test_fusion_pause_resume_and_finish(spark):
    first = [source(1, 8, 0), source(2, 8, 0), source(3, 8, 0)]
    second = [source(4, 8, 50), source(5, 8, 50), source(6, 8, 50)]
    got, want, held = runs(spark, [(first, ("live", "live", "paused")), (second, ("live", "finished", "live"))])
    assert got == want and len(held) + len(got) == 96 and any(g.startswith("s2") for g in got)


def test_fusion_failed_source_loses_nothing(spark):
    first, second = [source(1, 6, 0), source(2, 6, 0)], [source(3, 6, 50), source(4, 6, 50)]
    got, want, held = runs(spark, [(first, ("live", "failed")), (second, ("finished", "finished"))])
    assert got == want and sorted(got) == sorted(f"s{i}::{e}" for run in (first, second) for i, s in enumerate(run) for b in s for e, _, _ in b) and not held


def test_fusion_offline(spark):
    _, stream = land(spark, source(1, 2, 0)[:1], FUSED)
    with pytest.raises(ValueError, match="offline"):
        state.fuse_streams({"a": stream, "b": stream}, {"a": fusion.PAUSED, "b": fusion.FAILED}, 60)
    with pytest.raises(ValueError, match="unknown"):
        state.fuse_streams({"a": stream, "b": stream}, {"a": "odd"}, 60)

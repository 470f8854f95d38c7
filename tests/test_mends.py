"""Inputs that the fixtures do not hold: cycles beside cycles, concave overlaps, late-first windows, crowded turns, conflicts, bad JSON, clock changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.operators import lineage, patterns, records, sessions
from terralog.operators.geometry import ring_valid
from terralog.operators.shapes import Shape, pair_areas
from terralog.plans.iterate import on_cycles
from terralog.streaming.windows import classify, late_revisions


def test_edges_between_cycles_are_on_none(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (7, 5), (7, 8), (0, 1)]
    got = {tuple(r) for r in on_cycles(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 7), (7, 5)}
    assert on_cycles(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 0


def test_deleted_tasks_are_absent(spark):
    tasks = spark.createDataFrame([(1, [2], "pending"), (2, [1], "deleted"), (3, [2], "pending")], "id long, blocked_by array<long>, status string")
    assert sorted(tuple(r) for r in lineage.dependency_check(tasks).collect()) == [(1, 2, "missing"), (3, 2, "missing")]


SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]
ELL = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]


def area(a, b):
    shape = lambda r: [Shape([[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]]])]
    return pair_areas(shape(a), shape(b), np.zeros(1, int), np.zeros(1, int))[0] / (6371008.8 ** 2 * np.radians(1) ** 2)


def test_overlap_of_concave_rings():
    assert area(ELL, SQUARE) == pytest.approx(3, rel=2e-3)
    for a, b in ((ELL, SQUARE), (ELL, ELL), (SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)]), (ELL, [(3, 3), (5, 3), (5, 5), (3, 5)])):
        assert area(a, b) == pytest.approx(area(b, a), abs=1e-9) == pytest.approx(area(a[::-1], b), abs=1e-9)
    assert area(ELL, [(3, 3), (5, 3), (5, 5), (3, 5)]) == pytest.approx(0, abs=1e-9)
    assert area(ELL, ELL) == pytest.approx(7, rel=2e-3)


def test_ring_crossings(spark):
    def valid(points):
        return spark.range(1).select(ring_valid(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])).alias("v")).first()["v"]
    assert valid([*ELL, ELL[0]]) and valid([*ELL[::-1], ELL[-1]])
    assert not valid([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)])                 # touches a side
    assert not valid([(0, 0), (6, 0), (6, 2), (4, 0), (2, 0), (0, 2), (0, 0)])         # runs along a side
    assert not valid([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)])


def test_late_first_window_over_batches(spark):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [(1, at(130), 1.0), (2, at(30), 2.0), (3, at(40), 3.0)]
    events = spark.createDataFrame(rows, "ord long, ts string, value double").withColumns({"ts": F.col("ts").cast("timestamp"), "lon": F.lit(0.0), "lat": F.lit(0.0)})
    whole = late_revisions(classify(events, "ord", 3600, 6 * 3600), "ord", 9)
    late = [(r["revision"], r["count"]) for r in whole.where("hour(window_start) = 0").orderBy("revision").collect()]
    assert late == [(1, 1), (2, 2)]
    first = classify(events.where("ord <= 2"), "ord", 3600, 6 * 3600)
    state = first.where("kind <> 'expired'").groupBy("window_start").agg(
        F.count("*").alias("count"), F.sum("value").alias("sum"), F.sum("lon").alias("lon_sum"), F.sum("lat").alias("lat_sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("kind") == "late").alias("late_n"), F.count_if(F.col("kind") == "on-time").alias("on_n"))
    prior = 1704067200_000000 + 130 * 60_000000
    more = late_revisions(classify(events.where("ord = 3"), "ord", 3600, 6 * 3600, prior), "ord", 9, state)
    assert [(r["revision"], r["count"]) for r in more.where("hour(window_start) = 0").collect()] == [(2, 2)]


def test_seventy_open_calls(spark):
    rows = [("s", i, 1, "tool/call", f"c{i}", False) for i in range(70)] + [("s", 100 + i, 1, "tool/result", f"c{i}", False) for i in range(70)]
    log = spark.createDataFrame(rows, "session_id string, seq long, turn long, type string, call_id string, is_error boolean")
    assert [r["call_id"] for r in sessions.first_per_turn(log).collect()] == ["c0"]
    assert sessions.pair_calls(log).where("outcome = 'evicted'").count() == 6


def test_header_conflict_keeps_the_stored_log(spark):
    log = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "session_id long, seq long")
    live = spark.createDataFrame([(1, 5), (2, 9), (3, 0)], "session_id long, seq long")
    stored_heads = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "session_id long, cwd string, depth int")
    live_heads = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "c", 0)], "session_id long, cwd string, depth int")
    got = sorted(tuple(r) for r in sessions.merge_live(live, log, live_heads, stored_heads, "cwd", "depth").collect())
    assert got == [(1, 0, "refused"), (1, 1, "refused"), (2, 9, "live"), (3, 0, "live")]
    assert sessions.refused_live(live_heads, stored_heads, "cwd", "depth").count() == 1


def test_next_page_starts_behind_the_last(spark):
    pages = spark.createDataFrame([("q", 0, i, 50) for i in range(20)] + [("q", 20, 100 + i, 50) for i in range(20)], "request string, offset long, item_id long, total long")
    assert lineage.paged_collect(pages)[1].first()["next_offset"] == 40


def test_unreadable_json(spark):
    raw = ['{"a": {"apiKey": "x", "b": [1, "/home/u/f", {"geometry": [1]}]}}', "not json", None, '"/etc/passwd/x"']
    got = records.sanitize_json(spark.createDataFrame([(r,) for r in raw], "payload string").coalesce(1), "payload").collect()
    assert got[0]["payload"] == '{"a": {"apiKey": "[redacted:apiKey]", "b": [1, "<path>", {"geometry": {"obsRedacted": "geometry"}}]}}'
    assert got[0]["redactions"] == ["credential:apiKey", "path:b[1]", "geometry:geometry"]
    assert (got[1]["payload"], got[1]["redactions"]) == (None, ["unreadable:<root>"])
    assert (got[2]["payload"], got[2]["redactions"]) == (None, [])
    assert got[3]["payload"] == '"<path>"'


def test_hours_at_a_clock_change(spark):
    obs = spark.createDataFrame([("2024-11-03 05:30:00",), ("2024-11-03 06:30:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = patterns.calendar_frames(obs, "2024-11-03 04:00:00", "2024-11-03 09:00:00", "hour", "America/New_York").orderBy("frame").collect()
    assert [(r["frame"].hour, r["n"]) for r in got] == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 0)]
    spring = patterns.calendar_frames(obs, "2024-03-10 05:00:00", "2024-03-10 09:00:00", "hour", "America/New_York").orderBy("frame").collect()
    assert [r["frame"].hour for r in spring] == [0, 1, 3, 4]

"""The kept index against search over the logs themselves, and what it reads."""

import re

import pytest
from pyspark.sql import functions as F

from terralog.fixtures import Tables
from terralog.operators import search, text_index
from terralog.session import scratch_path
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def kept(spark):
    t = Tables(spark, SMALL)
    log, sessions = t.log.cache(), t.sessions
    index = text_index.write_index(log, sessions.select("session_id", F.col("cwd").alias("scope")), scratch_path(spark, "index"))
    return log, sessions, index


def told(df):
    return [(r["session_id"], r["seq"], round(r["score"], 9)) for r in df.collect()]


@pytest.mark.parametrize("words", [("des", "the", "und", "lookup"), ("result", "Q"), ("the", "nothingofthekind", "THE")])
@pytest.mark.parametrize("n, first", [(100, 8), (3, 1)])
def test_session_search(kept, words, n, first):
    log, sessions, index = kept
    for scope in (0, 77):
        assert told(index.session_search(words, scope, n, first)) == told(search.session_search(log, sessions, words, scope, n))


def test_event_search(kept):
    log, _, index = kept
    for session, skip in ((6, F.col("seq").between(8, 15)), (1, None), (99_999, None)):
        words = ("the", "des", "result")
        assert told(index.event_search(words, session, 50, skip)) == told(search.event_search(log, words, session, 50, skip))


def test_only_folders_of_the_words_are_read(kept):
    _, _, index = kept
    every = index.spark.read.parquet(f"{index.path}/postings").inputFiles()
    plan = index.postings(["lookup"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "EqualTo(term,lookup)" in plan.replace(" ", "") or "In(term" in plan
    assert len(every) > 40
    read = {r[0] for r in index.postings(["lookup"]).select(F.input_file_name()).distinct().collect()}
    assert len({re.search(r"bucket=(\d+)", f).group(1) for f in read}) == 1


def test_bounds_hold_and_blocks_are_skipped(kept, monkeypatch):
    log, sessions, index = kept
    words = ("des", "the")
    order, df = index.bounds(words, 1)
    scored = index.postings(words).where("scope = '1'").join(df, "term").groupBy("block", "session_id", "seq").agg(F.sum(text_index._part(F.col("tf"), F.col("length"))).alias("s"))
    best = {r["block"]: r["s"] for r in scored.groupBy("block").agg(F.max("s").alias("s")).collect()}
    assert set(best) == {b for b, _ in order} and all(best[b] <= bound + 1e-9 for b, bound in order)


def test_sessions_are_added(spark):
    t = Tables(spark, SMALL)
    path, scopes = scratch_path(spark, "index"), t.sessions.select("session_id", F.lit("all").alias("scope"))
    for part in (0, 1):
        index = text_index.write_index(t.log, scopes.where(F.col("session_id") % 2 == part), path)
    want = search.top_match(search.bm25(search.postings(search.documents(t.log)), search.lengths(search.documents(t.log)), ("des", "lookup")), 20)
    assert told(index.session_search(("des", "lookup"), "all", 20)) == told(want)
    empty = text_index.write_index(t.log.limit(0), scopes, scratch_path(spark, "index"))
    assert empty.session_search(("des",), "all").count() == 0

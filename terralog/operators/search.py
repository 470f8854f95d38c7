"""Full-text search over session logs: postings once, BM25 by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.text import terms
from terralog.operators.sessions import KEY, SEQ, event_text, surface_state

K1, B = 1.2, 0.75        # our choice of the usual BM25 defaults
MAX_SESSIONS = 100


def documents(events: DataFrame) -> DataFrame:
    """One row per searchable event."""
    return (surface_state(events).withColumn("body", event_text(events)).where("body <> ''")
            .select(KEY, SEQ, "type", F.col("time_ms").alias("time"), "surface", "body", F.char_length("body").alias("codepoint_length")))


def postings(docs: DataFrame) -> DataFrame:
    """``term, session, seq, tf, length``. Counts combine before the shuffle."""
    words = docs.select(KEY, SEQ, F.array_sort(terms(F.col("body"))).alias("w")).withColumn("length", F.size("w"))
    return (words.select(KEY, SEQ, "length", F.explode("w").alias("term"))
            .groupBy(KEY, SEQ, "length", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")))


def bm25(index: DataFrame, docs_total: DataFrame, query: Sequence[str]) -> DataFrame:
    """``session, seq, score`` of the events that hold any query term."""
    wanted = list(dict.fromkeys(w.lower() for w in query))
    g = docs_total.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).alias("g")).scalar()
    hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))      # one row per query term
    h = hits.join(F.broadcast(df), "term").withColumn("_g", g)
    idf = F.log(1 + (F.col("_g.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_g.avg"))
    return h.groupBy(KEY, SEQ).agg(F.sum(idf * F.col("tf") * (K1 + 1) / norm).alias("score"))


def top_match(scored: DataFrame, n: int = MAX_SESSIONS) -> DataFrame:
    """Strongest event per session, then the top ``n`` sessions."""
    best = scored.groupBy(KEY).agg(F.max(F.struct(F.col("score"), (-F.col(SEQ)).alias("s"))).alias("m"))
    return (best.select(KEY, (-F.col("m.s")).alias(SEQ), F.col("m.score").alias("score"))
            .orderBy(F.desc("score"), KEY).limit(n))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select(KEY, SEQ, F.size(terms(F.col("body"))).alias("length"))


def session_search(events: DataFrame, sessions: DataFrame, query: Sequence[str], cwd, n: int = MAX_SESSIONS) -> DataFrame:
    """Ranked sessions of one workspace; the workspace filter comes before scoring."""
    docs = documents(events.join(sessions.where(F.col("cwd") == cwd).select(KEY), KEY, "left_semi"))
    return top_match(bm25(postings(docs), lengths(docs), query), n)


def event_search(events: DataFrame, query: Sequence[str], session, n: int, skip: Column | None = None) -> DataFrame:
    """Ranked events of one session; ``skip`` marks the calling step."""
    docs = documents(events.where(F.col(KEY) == session))
    if skip is not None:
        docs = docs.where(~skip)
    return bm25(postings(docs), lengths(docs), query).orderBy(F.desc("score"), SEQ).limit(n)

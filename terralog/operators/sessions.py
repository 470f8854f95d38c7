"""Folds over append-only session logs: ``session_id, seq, type, turn, text, ...``.

Every fold is an aggregate or a blocked running aggregate, so a session that holds a third of
the log is still spread over many tasks.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions import text as X
from terralog.plans.running import BLOCK_ROWS, Run, int_block, last_seen, next_seen, running

KEY, SEQ = "session_id", "seq"
PROMPT_PREVIEW, RESPONSE_PREVIEW = 50, 120
MAX_PENDING = 64
SURFACE_TYPES = ("system/message", "user/message", "assistant/message", "tool/result")


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def _one(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def over(events: DataFrame, runs: list[Run], block_rows: int = BLOCK_ROWS) -> DataFrame:
    return running(events, [KEY], [SEQ], int_block(SEQ, block_rows), runs)


def session_stats(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """turns, steps, llm/tool/first-token/decode times over the whole log."""
    stepped = over(events, [Run("step", "sum", _one(_is("step/start")))], block_rows)
    t = F.col("time_ms")
    step = stepped.where("step > 0").groupBy(KEY, "step").agg(
        F.min(F.when(_is("step/start"), t)).alias("began"),
        F.min(F.when(_is("assistant/delta") & (F.char_length("text") > 0), t)).alias("first"),
        F.min(F.when(_is("assistant/message"), t)).alias("done"),
        F.max(F.when(_is("assistant/message"), F.col("output_tokens"))).alias("out"))
    timed = F.col("first").isNotNull() & F.col("done").isNotNull() & F.col("out").isNotNull()
    per_step = step.groupBy(KEY).agg(
        F.sum(F.col("done") - F.col("began")).alias("llm_ms"), F.sum(F.col("first") - F.col("began")).alias("ttft_ms"),
        F.count("first").alias("ttft_steps"), F.sum(F.when(timed, F.col("done") - F.col("first"))).alias("decode_ms"),
        F.sum(F.when(timed, F.col("out"))).alias("decode_tokens"))
    turn = events.where(_is("step/end")).groupBy(KEY, "turn").agg(F.count(F.lit(1)).alias("c"))
    turns = turn.groupBy(KEY).agg(F.count(F.lit(1)).alias("turns"), F.sum("c").alias("steps"))
    tool = (events.where(_is("tool/call", "tool/result")).groupBy(KEY, "call_id").agg(
        F.min(F.when(_is("tool/call"), t)).alias("a"), F.min(F.when(_is("tool/result"), t)).alias("b"))
        .groupBy(KEY).agg(F.sum(F.col("b") - F.col("a")).alias("tool_ms")))
    every = events.select(KEY).distinct()
    joined = every.join(turns, KEY, "left").join(per_step, KEY, "left").join(tool, KEY, "left")
    names = ("turns", "steps", "llm_ms", "tool_ms", "ttft_ms", "ttft_steps", "decode_ms", "decode_tokens")
    return joined.select(KEY, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def token_usage(events: DataFrame) -> DataFrame:
    cols = {"uncached_input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read", "cache_write": "cache_write"}
    return events.groupBy(KEY).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in cols.items()])


def event_tokens() -> Column:
    """Price of an event on the visible surface, 0 for anything else."""
    return F.when(_is(*SURFACE_TYPES), X.message_tokens(F.coalesce("text", F.lit("")), _is("system/message"))).otherwise(0)


def surface_tokens(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running visible total. A replacement adds its price minus the price stated just before it, for the same first and last event."""
    claims = _is("compaction/prune", "compaction/summary")
    prev = F.struct(claims.alias("claim"), F.struct("replace_seq", "replace_to").alias("at"), F.col("price").alias("price"))
    d = over(events, [last_seen("_p", [SEQ], prev, inclusive=False)], block_rows)
    claim, replaces = F.coalesce(F.col("_p.v.claim"), F.lit(False)), _is(*SURFACE_TYPES) & F.col("replace_seq").isNotNull()
    wrong = replaces & claim & (F.col("_p.v.at") != F.struct("replace_seq", "replace_to"))
    delta = (F.when(~replaces, event_tokens()).when(~claim | wrong, 0).otherwise(event_tokens() - F.col("_p.v.price")))
    d = d.withColumn("delta", delta.cast("long")).withColumn("error", F.coalesce(wrong, F.lit(False))).drop("_p")
    return over(d, [Run("total", "sum", F.col("delta"))], block_rows)


def context_pressure(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Last reported prompt size, that size plus the token change since, and the newest capacity."""
    s = surface_tokens(events, block_rows)
    size = F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")
    told = F.when(size.isNotNull(), F.col(SEQ))
    per = s.groupBy(KEY).agg(
        F.max_by(size, told).alias("pressure"), F.max_by("total", told).alias("then"), F.max_by("total", SEQ).alias("now"),
        F.max_by("context_window", F.when(F.col("context_window").isNotNull(), F.col(SEQ))).alias("context_window"))
    return per.select(KEY, "pressure", (F.col("pressure") + F.col("now") - F.col("then")).alias("projected"), "context_window")


def _replaced(events: DataFrame, keep: list[Column]) -> DataFrame:
    """One row per sequence number that an event replaces; runs are as long as what was visible before, so they add up to the log at most once each."""
    return events.where("replace_seq IS NOT NULL").select(KEY, *keep, F.explode(F.sequence("replace_seq", F.greatest("replace_seq", F.coalesce("replace_to", "replace_seq")))).alias(SEQ))


def surface_state(events: DataFrame) -> DataFrame:
    """current, shadowed or log-only per event, after replacements of the runs ``replace_seq..replace_to``."""
    gone = _replaced(events.where(_is(*SURFACE_TYPES)), []).distinct().withColumn("_gone", F.lit(True))
    state = F.when(~_is(*SURFACE_TYPES), "log-only").when(F.col("_gone"), "shadowed").otherwise("current")
    return events.join(gone, [KEY, SEQ], "left").withColumn("surface", state).drop("_gone")


def event_records(events: DataFrame) -> DataFrame:
    return surface_state(events).select(KEY, SEQ, "type", F.col("time_ms").alias("time"), "surface")


def event_trace(events: DataFrame) -> DataFrame:
    """Each replacement with every source event it cites, and how the two relate."""
    rep = _replaced(events, [F.col(SEQ).alias("by_seq"), F.col("type").alias("by_type")])
    src = events.select(KEY, SEQ, F.col("type").alias("source_type"))
    relation = F.when(F.col("source_type").isNull(), "missing").when(F.col("by_type").isin(*SURFACE_TYPES), "replaced").otherwise("cited")
    return rep.join(src, [KEY, SEQ], "left").withColumn("relation", relation)


def context_breakdown(events: DataFrame) -> DataFrame:
    """Estimated system, tool and message tokens of the visible surface."""
    s = surface_state(events).where("surface = 'current'")
    sys = _is("system/message")
    tool = _is("tool/result")
    cost = event_tokens()
    return s.groupBy(KEY).agg(*[F.coalesce(F.sum(F.when(c, cost)), F.lit(0)).cast("long").alias(n) for n, c in
                                (("system_tokens", sys), ("tool_tokens", tool), ("message_tokens", ~sys & ~tool))])


def consumed_work(events: DataFrame) -> DataFrame:
    """Latest turn end that accounts for work, and whether input was cancelled unrun after it."""
    turn = events.groupBy(KEY, "turn").agg(
        F.bool_or(_is("step/start")).alias("stepped"),
        F.bool_or(_is("inbox/spliced") & (F.col("outcome") == "claimed")).alias("claimed"),
        F.max(F.when(_is("turn/end"), F.struct(F.col(SEQ).alias("seq"), F.col("reason").alias("reason")))).alias("end"))
    accounts = F.col("stepped") | (F.coalesce("claimed", F.lit(False)) & (F.col("end.reason") != "completed"))
    ends = turn.groupBy(KEY).agg(F.max(F.when(F.col("end").isNotNull() & accounts, F.col("end"))).alias("end"))
    drops = events.where(_is("inbox/spliced") & (F.col("outcome") == "canceled")).groupBy(KEY).agg(F.max(SEQ).alias("drop"))
    return ends.join(drops, KEY, "left").select(
        KEY, F.col("end.seq").alias("end_seq"), F.col("end.reason").alias("reason"),
        F.coalesce(F.col("drop") > F.coalesce("end.seq", F.lit(-1)), F.lit(False)).alias("dropped_unrun"))


def turn_outline(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per turn: start, first human prompt, last reply committed by a turn end."""
    d = over(events, [Run("at_turn", "max", F.when(_is("turn/start"), F.col("turn"))),
                      next_seen("_end", [SEQ], F.col("turn"), _is("turn/end"))], block_rows).where("at_turn IS NOT NULL")
    ask, reply = X.preview(F.col("text"), PROMPT_PREVIEW), X.preview(F.col("text"), RESPONSE_PREVIEW)
    asked = F.when(_is("user/message") & (F.col("source") == "user") & (ask != ""), F.col(SEQ))
    said = F.when(_is("assistant/message") & (reply != "") & (F.col("_end.v") == F.col("at_turn")), F.col(SEQ))
    return d.groupBy(KEY, F.col("at_turn").alias("turn")).agg(
        F.min(F.when(_is("turn/start"), F.col(SEQ))).alias("seq"),
        F.coalesce(F.min_by(ask, asked), F.lit("")).alias("prompt"), F.coalesce(F.max_by(reply, said), F.lit("")).alias("response"))


def pair_calls(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Calls matched to results by id inside their turn; ``outcome`` paired, dropped or evicted.

    Only turns where more than MAX_PENDING calls were ever open at once can evict; those turns, and
    no others, replay their call order exactly.
    """
    io = events.where(_is("tool/call", "tool/result")).select(KEY, "turn", SEQ, "type", "call_id", "is_error")
    calls = matched_calls(io)
    open_ = running(io, [KEY, "turn"], [SEQ], int_block(SEQ, block_rows), [Run("open", "sum", _one(_is("tool/call")) - _one(_is("tool/result")))])
    crowded = open_.groupBy(KEY, "turn").agg(F.max("open").alias("m")).where(F.col("m") > MAX_PENDING).select(KEY, "turn")

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pending = None, {}          # at most MAX_PENDING calls are held, whatever the turn's length
        for frame in frames:
            lost = []
            for row in frame.itertuples(index=False):
                here = (getattr(row, KEY), row.turn)
                if here != at:
                    at, pending = here, {}
                if row.type == "tool/call":
                    if len(pending) >= MAX_PENDING:
                        oldest = next(iter(pending))
                        lost.append((*here, oldest))
                        del pending[oldest]
                    pending[row.call_id] = True
                else:
                    pending.pop(row.call_id, None)
            yield pd.DataFrame(lost, columns=[KEY, "turn", "call_id"])
    schema = io.select(KEY, "turn", "call_id").schema
    ordered = io.join(crowded, [KEY, "turn"], "left_semi").repartition(KEY, "turn").sortWithinPartitions(KEY, "turn", SEQ)
    evicted = ordered.mapInPandas(replay, schema).withColumn("_ev", F.lit(True))
    outcome = F.when(F.col("_ev"), "evicted").when(F.col("result_seq").isNull(), "dropped").otherwise("paired")
    return calls.join(evicted, [KEY, "turn", "call_id"], "left").withColumn("outcome", outcome).drop("_ev")


def matched_calls(events: DataFrame) -> DataFrame:
    """``session_id, turn, call_id, call_seq, result_seq, is_error``: calls with their results inside a turn, however many are open."""
    io = events.where(_is("tool/call", "tool/result"))
    return io.groupBy(KEY, "turn", "call_id").agg(
        F.min(F.when(_is("tool/call"), F.col(SEQ))).alias("call_seq"),
        F.min(F.when(_is("tool/result"), F.col(SEQ))).alias("result_seq"),
        F.bool_or(_is("tool/result") & F.col("is_error")).alias("is_error")).where("call_seq IS NOT NULL")


def first_per_turn(events: DataFrame, inherited: int = 0) -> DataFrame:
    """First successful call per turn is admitted; a newer admission replaces the earlier ones. No call is evicted here."""
    own = matched_calls(events.where(F.col(SEQ) >= inherited)).where("result_seq IS NOT NULL AND NOT is_error")
    first = own.groupBy(KEY, "turn").agg(F.min(F.struct("result_seq", "call_id")).alias("f"))
    newest = first.groupBy(KEY).agg(F.max("f.result_seq").alias("last"))
    return first.join(newest, KEY).select(KEY, "turn", F.col("f.call_id").alias("call_id"), F.col("f.result_seq").alias("result_seq"),
                                          F.when(F.col("f.result_seq") < F.col("last"), "replaced").otherwise("open").alias("phase"))


def pairing_balance(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running open-call count; a cut after a row is safe at 0, a negative count is corrupt."""
    d = over(events, [Run("open", "sum", _one(_is("tool/call")) - _one(_is("tool/result")))], block_rows)
    state = F.when(F.col("open") < 0, "corrupt").when(F.col("open") == 0, "safe").otherwise("open")
    return d.select(KEY, SEQ, F.col("open").cast("long").alias("open"), state.alias("cut"))


def event_neighbors(events: DataFrame, targets: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows around each target (``session_id, target_seq``), by position in the log."""
    pos = over(events, [Run("pos", "sum", F.lit(1).cast("long"))], block_rows)
    at = pos.select(KEY, F.col(SEQ).alias("target_seq"), F.col("pos").alias("target_pos")).join(targets, [KEY, "target_seq"])
    rel = F.col("pos") - F.col("target_pos")
    return pos.join(at, KEY).where(rel.between(-before, after)).withColumn("offset", rel).drop("pos", "target_pos")


def close_turns(events: DataFrame) -> DataFrame:
    """Closing events for an unfinished last turn: the open step, then the turn as interrupted."""
    g = events.groupBy(KEY).agg(
        F.max(SEQ).alias("top"), F.max("time_ms").alias("time_ms"), F.max_by("turn", F.when(_is("turn/start"), F.col(SEQ))).alias("turn"),
        *[F.max(F.when(_is(t), F.col(SEQ))).alias(a) for t, a in (("turn/start", "ts"), ("turn/end", "te"), ("step/start", "ss"), ("step/end", "se"))])
    g = g.where(F.col("ts") > F.coalesce("te", F.lit(-1)))
    step_open = F.col("ss") > F.greatest(F.coalesce("se", F.lit(-1)), F.col("ts"))
    rows = F.filter(F.array(F.when(step_open, F.struct(F.lit("step/end").alias("type"), F.lit(None).cast("string").alias("reason"))),
                            F.struct(F.lit("turn/end").alias("type"), F.lit("interrupted").alias("reason"))), lambda r: r.isNotNull())
    return g.select(KEY, "top", "turn", "time_ms", F.posexplode(rows).alias("i", "r")).select(
        KEY, (F.col("top") + 1 + F.col("i")).alias(SEQ), "turn", "time_ms", "r.type", "r.reason")


def event_text(events: DataFrame) -> Column:
    """Searchable text by event type; structural events give an empty string."""
    def joined(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda s: s != ""), "\n")
    text = F.col("text")
    code = F.when(F.col("is_error"), "error")
    ended = F.when(F.col("reason").isin("error", "aborted", "interrupted", "max-tokens"), F.col("reason"))
    return (F.when(_is("user/message", "assistant/message"), joined(text)).when(_is("tool/call"), joined(F.col("name"), text))
            .when(_is("tool/result"), joined(text, code)).when(_is("turn/end"), joined(ended)).otherwise(F.lit("")))


def refused_live(live_headers: DataFrame, stored_headers: DataFrame, *header: str) -> DataFrame:
    """Sessions whose live header differs from the stored one in any of the named fields, with both values of each."""
    live = live_headers.select(KEY, F.struct(*header).alias("live"))
    both = live.join(stored_headers.select(KEY, F.struct(*header).alias("stored")), KEY)
    differs = reduce(Column.__or__, [~F.col(f"live.{c}").eqNullSafe(F.col(f"stored.{c}")) for c in header])
    wrong = both.where(differs)
    return wrong.select(KEY, F.col(f"live.{header[0]}").alias("live"), F.col(f"stored.{header[0]}").alias("stored")) if len(header) == 1 else wrong


def merge_live(live: DataFrame, stored: DataFrame, live_headers: DataFrame, stored_headers: DataFrame, *header: str) -> DataFrame:
    """Stored events, replaced by the live observation of a session.

    A session whose headers differ keeps its stored log, with origin ``refused`` so that the conflict is seen.
    """
    refused = refused_live(live_headers, stored_headers, *header).select(KEY)
    accepted = live_headers.select(KEY).join(refused, KEY, "left_anti")
    kept = stored.join(accepted, KEY, "left_anti").join(refused.withColumn("_no", F.lit(True)), KEY, "left")
    kept = kept.withColumn("origin", F.when(F.col("_no"), "refused").otherwise("stored")).drop("_no")
    return live.join(refused, KEY, "left_anti").withColumn("origin", F.lit("live")).unionByName(kept)


def retain_ends(blocks: DataFrame, key: str, order: str, text: str, budget: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Characters kept of each block by a head and a tail of half the token budget each."""
    head, tail = -(-budget // 2), budget // 2
    n = F.char_length(text)
    cost = X.block_tokens(n)
    d = running(blocks.withColumn("n", n).withColumn("cost", cost), [key], [order], int_block(order, block_rows),
                [Run("fwd", "sum", F.col("cost")), Run("bwd", "sum", F.col("cost"), backward=True)])

    def fit(left: Column, limit: Column) -> Column:
        return F.least(limit, F.greatest(F.lit(0), (left - X.BLOCK_OVERHEAD) * X.CHARS_PER_TOKEN))
    before, behind = F.col("fwd") - F.col("cost"), F.col("bwd") - F.col("cost")
    head_chars = F.when(F.col("fwd") <= head, F.col("n")).when(before <= head, fit(head - before, F.col("n"))).otherwise(0)
    rest = F.col("n") - F.col("head_chars")
    tail_chars = F.when(F.col("fwd") <= head, 0).when(behind > tail, 0).when(
        behind + X.block_tokens(rest) <= tail, rest).otherwise(fit(tail - behind, rest))
    return d.withColumn("head_chars", head_chars.cast("long")).withColumn("tail_chars", tail_chars.cast("long")).drop("fwd", "bwd")

"""Session folds, retention, text and search queries over ``conversations``."""

from pyspark.sql import functions as F

from terralog.fixtures import with_sql
from terralog.functions import text as X
from terralog.operators import retention as K
from terralog.operators import search as Q
from terralog.operators import sessions as S
from terralog.operators import text_index as I
from terralog.operators import viz as V
from terralog.plans.running import int_block
from terralog.queries.registry import query
from terralog.session import scratch_path

LOG = with_sql("log")
SURFACE = "type IN ('system/message','user/message','assistant/message','tool/result')"
EST = f"CAST(CASE WHEN type = 'system/message' THEN CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text)/4.0::DOUBLE) + 4 END WHEN {SURFACE} THEN ceil(length(text)/4.0::DOUBLE) + 8 ELSE 0 END AS BIGINT)"


def preview_sql(col: str, n: int) -> str:
    short = f"trim(regexp_replace(substring({col}, 1, {2 * n}), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN length({short}) > {n - 1} THEN rtrim(substring({short}, 1, {n - 1})) || '…' WHEN length({col}) > {2 * n} THEN {short} || '…' ELSE {short} END)"


@query("session_stats", LOG + """, s AS (SELECT *, sum(CASE WHEN type = 'step/start' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS step FROM log),
st AS (SELECT session_id, step, min(time_ms) FILTER (type = 'step/start') AS b, min(time_ms) FILTER (type = 'assistant/delta' AND length(text) > 0) AS f,
 min(time_ms) FILTER (type = 'assistant/message') AS d, max(output_tokens) AS o FROM s WHERE step > 0 GROUP BY ALL),
ps AS (SELECT session_id, sum(d - b) AS llm_ms, sum(f - b) AS ttft_ms, count(f) AS ttft_steps, sum(CASE WHEN o IS NOT NULL THEN d - f END) AS decode_ms, sum(CASE WHEN d - f IS NOT NULL THEN o END) AS decode_tokens FROM st GROUP BY 1),
tn AS (SELECT session_id, count(DISTINCT turn) AS turns, count(*) AS steps FROM log WHERE type = 'step/end' GROUP BY 1),
tl AS (SELECT a.session_id, sum(b.time_ms - a.time_ms) AS tool_ms FROM log a JOIN log b ON a.session_id = b.session_id AND a.call_id = b.call_id AND a.type = 'tool/call' AND b.type = 'tool/result' GROUP BY 1)
SELECT session_id, coalesce(turns, 0) AS turns, coalesce(steps, 0) AS steps, CAST(coalesce(llm_ms, 0) AS BIGINT) AS llm_ms, CAST(coalesce(tool_ms, 0) AS BIGINT) AS tool_ms, CAST(coalesce(ttft_ms, 0) AS BIGINT) AS ttft_ms, coalesce(ttft_steps, 0) AS ttft_steps,
 CAST(coalesce(decode_ms, 0) AS BIGINT) AS decode_ms, CAST(coalesce(decode_tokens, 0) AS BIGINT) AS decode_tokens FROM (SELECT DISTINCT session_id FROM log) LEFT JOIN tn USING (session_id) LEFT JOIN ps USING (session_id) LEFT JOIN tl USING (session_id)""")
def session_stats(t):
    return S.session_stats(t.log)


@query("token_usage", LOG + """ SELECT session_id, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS uncached_input, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read, CAST(coalesce(sum(cache_write), 0) AS BIGINT) AS cache_write FROM log GROUP BY 1""")
def token_usage(t):
    return S.token_usage(t.log)


_STATE = f"""st AS (SELECT l.*, CASE WHEN NOT ({SURFACE}) THEN 'log-only' WHEN EXISTS (SELECT 1 FROM log r WHERE r.session_id = l.session_id AND r.type = 'user/message' AND l.seq BETWEEN r.replace_seq AND r.replace_to) THEN 'shadowed' ELSE 'current' END AS surface FROM log l)"""


@query("surface_state", f"{LOG}, {_STATE} SELECT session_id, seq, type, surface FROM st")
def surface_state(t):
    return S.surface_state(t.log).select("session_id", "seq", "type", "surface")


@query("event_records", f"{LOG}, {_STATE} SELECT session_id, seq, type, time_ms AS time, surface FROM st")
def event_records(t):
    return S.event_records(t.log)


@query("context_breakdown", f"""{LOG}, {_STATE} SELECT session_id, CAST(coalesce(sum(c) FILTER (type = 'system/message'), 0) AS BIGINT) AS system_tokens, CAST(coalesce(sum(c) FILTER (type = 'tool/result'), 0) AS BIGINT) AS tool_tokens,
 CAST(coalesce(sum(c) FILTER (type IN ('user/message', 'assistant/message')), 0) AS BIGINT) AS message_tokens FROM (SELECT *, {EST} AS c FROM st WHERE surface = 'current') GROUP BY 1""")
def context_breakdown(t):
    return S.context_breakdown(t.log)


_SURF = f"""sf AS (SELECT *, lag(type) OVER w AS pt, lag(replace_seq) OVER w AS pr, lag(replace_to) OVER w AS pe, lag(price) OVER w AS pp, {EST} AS est FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
sd AS (SELECT *, CASE WHEN NOT ({SURFACE} AND replace_seq IS NOT NULL) THEN est WHEN pt <> 'compaction/prune' OR pt IS NULL OR pr <> replace_seq OR pe <> replace_to THEN 0 ELSE est - pp END AS delta, coalesce({SURFACE} AND replace_seq IS NOT NULL AND pt = 'compaction/prune' AND (pr <> replace_seq OR pe <> replace_to), false) AS error FROM sf),
tot AS (SELECT *, sum(delta) OVER (PARTITION BY session_id ORDER BY seq) AS total FROM sd)"""


@query("surface_tokens", f"{LOG}, {_SURF} SELECT session_id, seq, delta, CAST(total AS BIGINT) AS total, error FROM tot")
def surface_tokens(t):
    return S.surface_tokens(t.log).select("session_id", "seq", "delta", "total", "error")


@query("context_pressure", f"""{LOG}, {_SURF}, u AS (SELECT session_id, arg_max(input_tokens + cache_read + cache_write, seq) AS pressure, arg_max(total, seq) AS then_, arg_max(context_window, seq) AS context_window FROM tot WHERE input_tokens IS NOT NULL GROUP BY 1),
n AS (SELECT session_id, arg_max(total, seq) AS now_ FROM tot GROUP BY 1) SELECT n.session_id, pressure, CAST(pressure + now_ - then_ AS BIGINT) AS projected, context_window FROM n LEFT JOIN u USING (session_id)""")
def context_pressure(t):
    return S.context_pressure(t.log)


@query("consumed_work", LOG + """, tn AS (SELECT session_id, turn, bool_or(type = 'step/start') AS stepped, bool_or(type = 'inbox/spliced' AND outcome = 'claimed') AS claimed, max(seq) FILTER (type = 'turn/end') AS e, max(reason) AS reason FROM log GROUP BY ALL),
en AS (SELECT session_id, max(e) AS end_seq, arg_max(reason, e) AS reason FROM tn WHERE e IS NOT NULL AND (stepped OR (claimed AND reason <> 'completed')) GROUP BY 1),
dr AS (SELECT session_id, max(seq) AS d FROM log WHERE type = 'inbox/spliced' AND outcome = 'canceled' GROUP BY 1)
SELECT session_id, end_seq, reason, coalesce(d > coalesce(end_seq, -1), false) AS dropped_unrun FROM (SELECT DISTINCT session_id FROM log) LEFT JOIN en USING (session_id) LEFT JOIN dr USING (session_id)""")
def consumed_work(t):
    return S.consumed_work(t.log)


@query("turn_outline", f"""{LOG}, a AS (SELECT *, max(CASE WHEN type = 'turn/start' THEN turn END) OVER (PARTITION BY session_id ORDER BY seq) AS at_turn, {preview_sql('text', 50)} AS ask, {preview_sql('text', 120)} AS reply FROM log),
e AS (SELECT session_id, turn, max(seq) AS e FROM log WHERE type = 'turn/end' GROUP BY ALL)
SELECT a.session_id, at_turn AS turn, min(seq) FILTER (type = 'turn/start') AS seq, coalesce(arg_min(ask, seq) FILTER (type = 'user/message' AND source = 'user' AND ask <> ''), '') AS prompt,
 coalesce(arg_max(reply, seq) FILTER (type = 'assistant/message' AND reply <> '' AND seq < e), '') AS response FROM a LEFT JOIN e ON e.session_id = a.session_id AND e.turn = a.at_turn WHERE at_turn IS NOT NULL GROUP BY ALL""")
def turn_outline(t):
    return S.turn_outline(t.log)


_PAIR = """pr AS (SELECT session_id, turn, call_id, min(seq) FILTER (type = 'tool/call') AS call_seq, min(seq) FILTER (type = 'tool/result') AS result_seq, bool_or(is_error) AS is_error FROM log WHERE type IN ('tool/call', 'tool/result') GROUP BY ALL)"""


@query("call_result_pair", f"{LOG}, {_PAIR} SELECT *, CASE WHEN result_seq IS NULL THEN 'dropped' ELSE 'paired' END AS outcome FROM pr")
def call_result_pair(t):
    return S.pair_calls(t.log)


@query("first_per_turn", f"""{LOG}, {_PAIR}, f AS (SELECT session_id, turn, arg_min(call_id, result_seq) AS call_id, min(result_seq) AS result_seq FROM pr WHERE result_seq IS NOT NULL AND NOT is_error AND call_seq >= 8 GROUP BY ALL)
SELECT *, CASE WHEN result_seq < max(result_seq) OVER (PARTITION BY session_id) THEN 'replaced' ELSE 'open' END AS phase FROM f""")
def first_per_turn(t):
    return S.first_per_turn(t.log, inherited=8)


@query("pairing_balance", LOG + """, b AS (SELECT session_id, seq, CAST(sum(CASE type WHEN 'tool/call' THEN 1 WHEN 'tool/result' THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS open FROM log)
SELECT *, CASE WHEN open < 0 THEN 'corrupt' WHEN open = 0 THEN 'safe' ELSE 'open' END AS cut FROM b""")
def pairing_balance(t):
    return S.pairing_balance(t.log)


@query("event_neighbors", LOG + """, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS pos FROM log), t AS (SELECT session_id, max(seq) AS target_seq FROM log WHERE type = 'user/message' GROUP BY 1)
SELECT p.session_id, p.seq, target_seq, p.type, p.pos - q.pos AS "offset" FROM p JOIN t USING (session_id) JOIN p q ON q.session_id = p.session_id AND q.seq = target_seq WHERE p.pos - q.pos BETWEEN -4 AND 3""")
def event_neighbors(t):
    targets = t.log.where("type = 'user/message'").groupBy("session_id").agg(F.max("seq").alias("target_seq"))
    return S.event_neighbors(t.log, targets, 4, 3).select("session_id", "seq", "target_seq", "type", "offset")


@query("event_trace", LOG + f""" SELECT r.session_id, r.seq AS by_seq, r.type AS by_type, r.at AS seq, s.type AS source_type,
 CASE WHEN s.type IS NULL THEN 'missing' WHEN r.type = 'user/message' THEN 'replaced' ELSE 'cited' END AS relation FROM (SELECT *, unnest(range(replace_seq, replace_to + 1)) AS at FROM log WHERE replace_seq IS NOT NULL) r LEFT JOIN log s ON s.session_id = r.session_id AND s.seq = r.at""")
def event_trace(t):
    return S.event_trace(t.log)


@query("interrupted_closers", LOG + """, g AS (SELECT session_id, max(seq) AS top, max(time_ms) AS time_ms, arg_max(turn, seq) FILTER (type = 'turn/start') AS turn, max(seq) FILTER (type = 'turn/start') AS ts, coalesce(max(seq) FILTER (type = 'turn/end'), -1) AS te,
 max(seq) FILTER (type = 'step/start') AS ss, coalesce(max(seq) FILTER (type = 'step/end'), -1) AS se FROM log GROUP BY 1), o AS (SELECT *, coalesce(ss > greatest(se, ts), false) AS step_open FROM g WHERE ts > te)
SELECT session_id, top + 1 AS seq, turn, time_ms, 'step/end' AS type, NULL::VARCHAR AS reason FROM o WHERE step_open UNION ALL SELECT session_id, top + CASE WHEN step_open THEN 2 ELSE 1 END, turn, time_ms, 'turn/end', 'interrupted' FROM o""")
def interrupted_closers(t):
    return S.close_turns(t.log)


_TEXT = """CASE WHEN type IN ('user/message', 'assistant/message') THEN trim(text) WHEN type = 'tool/call' THEN trim(name) || chr(10) || trim(text) WHEN type = 'tool/result' THEN trim(text) || CASE WHEN is_error THEN chr(10) || 'error' ELSE '' END
 WHEN type = 'turn/end' AND reason <> 'completed' THEN reason ELSE '' END"""
_TERMS = r"list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("event_text", f"{LOG} SELECT session_id, seq, type, {_TEXT} AS body FROM log")
def event_text(t):
    return t.log.select("session_id", "seq", "type", S.event_text(t.log).alias("body"))


@query("search_documents", f"{LOG}, {_STATE} SELECT session_id, seq, type, time_ms AS time, surface, body, length(body) AS codepoint_length FROM (SELECT *, {_TEXT} AS body FROM st) WHERE body <> ''")
def search_documents(t):
    return Q.documents(t.log)


_POST = f"""dc AS (SELECT session_id, seq, {_TERMS} AS w FROM (SELECT *, {_TEXT} AS body FROM log) WHERE body <> ''), po AS (SELECT session_id, seq, len(w) AS length, unnest(w) AS term FROM dc), ix AS (SELECT session_id, seq, length, term, CAST(count(*) AS INT) AS tf FROM po GROUP BY ALL)"""


@query("build_index", f"{LOG}, {_POST} SELECT * FROM ix")
def build_index(t):
    return Q.postings(Q.documents(t.log))


def bm25_sql(words: tuple[str, ...], docs: str = "dc", index: str = "ix") -> str:
    inlist = ", ".join(f"'{w}'" for w in words)
    return f"""df AS (SELECT term, count(*) AS df FROM {index} WHERE term IN ({inlist}) GROUP BY 1), g AS (SELECT count(*) AS n, avg(len(w)) AS av FROM {docs}),
sc AS (SELECT session_id, seq, sum(ln(1 + (n - df + 0.5::DOUBLE)/(df + 0.5::DOUBLE))*tf*2.2::DOUBLE/(tf + 1.2::DOUBLE*(0.25::DOUBLE + 0.75::DOUBLE*length/av))) AS score FROM {index} JOIN df USING (term), g GROUP BY ALL)"""


_WORDS = ("des", "the", "und", "lookup")


@query("session_search", f"""{LOG}, ss AS (SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id % 4 = 1), {_POST.replace('FROM log)', 'FROM log JOIN ss USING (session_id))')}, {bm25_sql(_WORDS)},
b AS (SELECT session_id, max(score) AS score FROM sc GROUP BY 1) SELECT b.session_id, min(sc.seq) AS seq, round(b.score, 6) AS score FROM b JOIN sc ON sc.session_id = b.session_id AND sc.score = b.score GROUP BY b.session_id, b.score ORDER BY b.score DESC, b.session_id LIMIT 100""")
def session_search(t):
    return Q.session_search(t.log, t.sessions, _WORDS, 1).withColumn("score", F.round("score", 6))


@query("top_match_per_session", f"""{LOG}, {_POST}, {bm25_sql(_WORDS)}, b AS (SELECT session_id, max(score) AS score FROM sc GROUP BY 1)
SELECT b.session_id, min(sc.seq) AS seq, round(b.score, 6) AS score FROM b JOIN sc ON sc.session_id = b.session_id AND sc.score = b.score GROUP BY b.session_id, b.score ORDER BY b.score DESC, b.session_id LIMIT 20""")
def top_match_per_session(t):
    docs = Q.documents(t.log)
    return Q.top_match(Q.bm25(Q.postings(docs), Q.lengths(docs), _WORDS), 20).withColumn("score", F.round("score", 6))


@query("event_search", f"""{LOG}, {_POST.replace("WHERE body <> ''", "WHERE body <> '' AND session_id = 6 AND NOT (seq BETWEEN 8 AND 15)")}, {bm25_sql(_WORDS)} SELECT session_id, seq, round(score, 6) AS score FROM sc ORDER BY score DESC, seq LIMIT 50""")
def event_search(t):
    return Q.event_search(t.log, _WORDS, 6, 50, skip=F.col("seq").between(8, 15)).withColumn("score", F.round("score", 6))


def _kept(t):
    """The index of all sessions, by workspace."""
    return I.write_index(t.log, t.sessions.select("session_id", F.col("cwd").alias("scope")), scratch_path(t.spark, "index"))


@query("session_search_kept", f"""{LOG}, ss AS (SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id % 4 = 1), {_POST.replace('FROM log)', 'FROM log JOIN ss USING (session_id))')}, {bm25_sql(_WORDS)},
b AS (SELECT session_id, max(score) AS score FROM sc GROUP BY 1) SELECT b.session_id, min(sc.seq) AS seq, round(b.score, 6) AS score FROM b JOIN sc ON sc.session_id = b.session_id AND sc.score = b.score GROUP BY b.session_id, b.score ORDER BY b.score DESC, b.session_id LIMIT 20""")
def session_search_kept(t):
    return _kept(t).session_search(_WORDS, 1, 20).withColumn("score", F.round("score", 6))


@query("event_search_kept", f"""{LOG}, {_POST.replace("WHERE body <> ''", "WHERE body <> '' AND session_id = 6 AND NOT (seq BETWEEN 8 AND 15)")}, {bm25_sql(_WORDS)} SELECT session_id, seq, round(score, 6) AS score FROM sc ORDER BY score DESC, seq LIMIT 50""")
def event_search_kept(t):
    return _kept(t).event_search(_WORDS, 6, 50, skip=F.col("seq").between(8, 15)).withColumn("score", F.round("score", 6))


def _live(t):
    live = t.log.where("session_id % 5 = 0")
    headers = t.sessions.select("session_id", "cwd")
    return live, headers.where("session_id % 5 = 0").withColumn("cwd", F.when(F.col("session_id") % 35 == 0, -1).otherwise(F.col("cwd"))), headers


@query("live_over_persisted", LOG + """ SELECT session_id, CASE WHEN session_id % 35 = 0 THEN 'refused' WHEN session_id % 5 = 0 THEN 'live' ELSE 'stored' END AS origin, count(*) AS n FROM log GROUP BY ALL""")
def live_over_persisted(t):
    live, lh, sh = _live(t)
    return S.merge_live(live, t.log, lh, sh, "cwd").groupBy("session_id", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("live_header_conflicts", """SELECT DISTINCT conv_id AS session_id, -1 AS live, conv_id % 4 AS stored FROM conversations WHERE conv_id % 35 = 0""")
def live_header_conflicts(t):
    _, lh, sh = _live(t)
    return S.refused_live(lh, sh, "cwd").withColumn("live", F.col("live").cast("int"))


@query("retain_ends", """WITH b AS (SELECT conv_id, turn, length(text) AS n, CAST(ceil(length(text)/4.0::DOUBLE) + 4 AS BIGINT) AS cost FROM conversations),
r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS f, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM b),
h AS (SELECT *, CASE WHEN f <= 60 THEN n WHEN f - cost <= 60 THEN least(n, greatest(0, (60 - (f - cost) - 4)*4)) ELSE 0 END AS head_chars FROM r)
SELECT conv_id, turn, CAST(head_chars AS BIGINT) AS head_chars, CAST(CASE WHEN f <= 60 OR b - cost > 60 THEN 0 WHEN b - cost + ceil((n - head_chars)/4.0::DOUBLE) + 4 <= 60 THEN n - head_chars ELSE least(n - head_chars, greatest(0, (60 - (b - cost) - 4)*4)) END AS BIGINT) AS tail_chars FROM h""")
def retain_ends(t):
    return S.retain_ends(t.conversations, "conv_id", "turn", "text", 120).select("conv_id", "turn", "head_chars", "tail_chars")


# ---- text ------------------------------------------------------------------------------------

@query("preview_text", f"SELECT doc_id, {preview_sql('text', 50)} AS p50, {preview_sql('text', 120)} AS p120 FROM documents")
def preview_text(t):
    return t.documents.select("doc_id", X.preview(F.col("text"), 50).alias("p50"), X.preview(F.col("text"), 120).alias("p120"))


_DIRTY = r"concat(chr(27), '[31m', text, chr(27), '[0m ', chr(7), '  end')"


@query("clean_title", rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({_DIRTY}, '\x1B\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{200B}}\x{{200E}}\x{{200F}}\x{{202A}}-\x{{202E}}\x{{FEFF}}]', '', 'g'), '\s+', ' ', 'g'))) AS title FROM documents""")
def clean_title(t):
    return t.documents.select("doc_id", F.md5(X.clean_title(F.expr(_DIRTY))).alias("title"))


@query("utf8_truncate", """SELECT doc_id, CASE WHEN strlen(text) <= 97 THEN text ELSE (SELECT max_by(substring(text, 1, n), n) FROM range(0, 98) r(n) WHERE strlen(substring(text, 1, n)) <= 97) END AS head FROM documents""")
def utf8_truncate(t):
    return t.documents.select("doc_id", X.utf8_truncate(F.col("text"), 97).alias("head"))


@query("fallback_title", """WITH m AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
w AS (SELECT conv_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{200B}\\x{FEFF}]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')[1:6], ' ') AS s FROM m)
SELECT conv_id, rtrim(CASE WHEN strlen(s) <= 40 THEN s ELSE (SELECT max_by(substring(s, 1, n), n) FROM range(0, 41) r(n) WHERE strlen(substring(s, 1, n)) <= 40) END) AS title FROM w""".replace("\\\\", "\\"))
def fallback_title(t):
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", X.fallback_title(F.col("text"), 6, 40).alias("title"))


@query("prune_middle", """SELECT doc_id, md5(CASE WHEN length(text) > 8192 THEN substring(text, 1, 4096) || chr(10) || '[... middle removed ...]' || chr(10) || substring(text, length(text) - 1023, 1024) ELSE text END) AS pruned, length(text) > 8192 AS was_pruned FROM documents""")
def prune_middle(t):
    return t.documents.select("doc_id", F.md5(X.prune_middle(F.col("text"))).alias("pruned"), (F.char_length("text") > X.PRUNE_THRESHOLD).alias("was_pruned"))


@query("token_estimate", """SELECT conv_id, turn, CAST(CASE WHEN role = 'system' THEN CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text)/4.0::DOUBLE) + 4 END ELSE ceil(length(text)/4.0::DOUBLE) + 8 END AS BIGINT) AS tokens FROM conversations""")
def token_estimate(t):
    return t.conversations.select("conv_id", "turn", X.message_tokens(F.col("text"), F.col("role") == "system").cast("long").alias("tokens"))


_HTML = r"""regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"""
for _t in ("script", "style", "head", "noscript"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_t}[ >].*?</{_t}>', ' ', 'g')"


def _ent(e: str) -> str:
    for name, ch in X.ENTITIES:
        quoted = ch.replace("'", "''")
        e = f"replace({e}, '{name}', '{quoted}')"
    return e


_BODY = f"substring(trim(regexp_replace({_ent(f'''regexp_replace({_HTML}, '<[^>]*>', ' ', 'g')''')}, '\\s+', ' ', 'g')), 1, 200000)"


@query("html_to_text", f"""SELECT page_id, {_ent(r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))")} AS title, md5({_BODY}) AS body, length({_BODY}) AS chars FROM pages""")
def html_to_text(t):
    body = X.html_to_text(F.col("html"))
    return t.pages.select("page_id", X.html_title(F.col("html")).alias("title"), F.md5(body).alias("body"), F.char_length(body).cast("long").alias("chars"))


_TS = """CASE event_id % 6 WHEN 0 THEN '2024-02-30T00:00:00Z' WHEN 1 THEN '2024-01-05T00:00:00' WHEN 2 THEN concat('2024-01-05T00:00:0', event_id % 10, '+08:00')
 WHEN 3 THEN concat('2024-01-0', 1 + event_id % 9, 'T01:02:03Z') WHEN 4 THEN 'yesterday' ELSE concat('2024-12-31T23:59:59.', 100 + event_id % 900, 'Z') END"""


@query("strict_timestamp", """SELECT event_id, CASE event_id % 6 WHEN 2 THEN TIMESTAMP '2024-01-04 16:00:00' + to_seconds(event_id % 10) WHEN 3 THEN TIMESTAMP '2024-01-01 01:02:03' + to_days(CAST(event_id % 9 AS INT))
 WHEN 5 THEN TIMESTAMP '2024-12-31 23:59:59' + to_milliseconds(100 + event_id % 900) END AS ts FROM events""")
def strict_timestamp(t):
    return t.events.select("event_id", V.strict_timestamp(F.expr(_TS)).alias("ts"))


# ---- retention -------------------------------------------------------------------------------

@query("latest_version", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def latest_version(t):
    return K.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def _day():
    return F.unix_date(F.to_date("o_orderdate")).cast("long")


@query("bounded_tail", "SELECT o_custkey, o_orderkey, rn AS age FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def bounded_tail(t):
    return K.newest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], _day(), 3).select("o_custkey", "o_orderkey", "age")


@query("history_retention", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, max(o_orderdate) OVER (PARTITION BY o_custkey) AS mx, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS kept FROM r WHERE rn <= 5 AND o_orderdate >= mx - INTERVAL 400 DAY) SELECT o_custkey, o_orderkey, kept < total AS pruned FROM k""")
def history_retention(t):
    return K.history(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", _day(), 400, 5).select("o_custkey", "o_orderkey", "pruned")


@query("keyset_page", "WITH p AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 50) SELECT *, (SELECT min(o_orderkey) FROM p) AS next_before FROM p")
def keyset_page(t):
    return K.page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 9000, 50)


@query("ring_retention", """WITH c AS (SELECT conv_id, turn, text, strlen(text) AS b FROM conversations WHERE strlen(text) > 0), r AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(b) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS lft FROM c),
k AS (SELECT *, CASE WHEN b > 300 THEN (SELECT max_by(right(text, n), n) FROM range(1, 301) q(n) WHERE strlen(right(text, n)) <= 300) ELSE text END AS tail FROM r WHERE lft <= 300 OR lft = b)
SELECT conv_id, turn, CAST(start + b - strlen(tail) AS BIGINT) AS "at", strlen(tail) AS bytes, b > 300 AS gap_before, tail AS text FROM k""")
def ring_retention(t):
    return K.ring(t.conversations, "conv_id", "turn", "text", 300)


@query("log_export_lines", LOG + """ SELECT session_id, seq, '- **' || type || '** (' || seq || ') ' || coalesce(text, '') AS line FROM log""")
def log_export_lines(t):
    from terralog.sources.logs import transcript_lines
    return transcript_lines(t.log)


def _turn_fold():
    from terralog.functions.folds import Fold

    def step(state, row):
        opened = row.type == "turn/start" and row.turn > state["last"]
        return {"turns": state["turns"] + opened, "last": row.turn if opened else state["last"], "events": state["events"] + 1}
    return Fold("session_id", "seq", lambda: {"turns": 0, "last": -1, "events": 0}, step, dict, "turns long, last long, events long")


@query("register_fold", LOG + """ SELECT session_id, count(DISTINCT turn) FILTER (type = 'turn/start') AS turns, coalesce(max(turn) FILTER (type = 'turn/start'), -1) AS last, count(*) AS events FROM log GROUP BY 1""")
def register_fold(t):
    from terralog.functions.folds import run_fold
    return run_fold(t.log.select("session_id", "seq", "type", "turn"), _turn_fold())


@query("register_fold_sql", LOG + """ SELECT session_id, count(DISTINCT turn) FILTER (type = 'turn/start') AS turns, coalesce(max(turn) FILTER (type = 'turn/start'), -1) AS last, count(*) AS events FROM log GROUP BY 1""")
def register_fold_sql(t):
    from terralog.functions.folds import register_fold as make
    make(t.spark, "turn_fold", _turn_fold())
    t.log.select("session_id", "seq", "type", "turn").createOrReplaceTempView("terralog_log")
    return t.spark.sql("SELECT * FROM turn_fold(TABLE(terralog_log) PARTITION BY session_id ORDER BY seq)")


@query("register_operator", """SELECT doc_id, round(ln(1 + n_chars), 9) AS scaled FROM documents""")
def register_operator(t):
    import numpy as np

    from terralog.functions import folds
    log1p = folds.numeric(lambda v: np.log1p(v))

    @folds.operator("scale_chars")
    def scale_chars(df, column):
        return df.select("doc_id", F.round(log1p(F.col(column).cast("double")), 9).alias("scaled"))
    folds.run("scale_chars", t.documents, view="terralog_scaled", column="n_chars")
    return t.spark.sql("SELECT doc_id, scaled FROM terralog_scaled")

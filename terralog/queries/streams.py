"""Stream queries: batch twins checked by SQL, and real streams over landed files."""

from pyspark.sql import functions as F

from terralog.fixtures import with_sql
from terralog.queries.registry import query
from terralog.session import scratch_path
from terralog.streaming import fusion as U
from terralog.streaming import state as S
from terralog.streaming import windows as W

ARR = with_sql("arrivals")
# A unique integer arrival order: (arrival, event_id, dup); event ids stay below 2^40.
_ORD = "arrival * 4 + dup"
SIZE, LATE, REVS = 3600, 6 * 3600, 4


def _arr(t):
    """Arrivals with a unique arrival rank ``ord``: the tie of equal arrivals is broken by event id."""
    from terralog.plans.running import Run, int_block, running
    a = running(t.arrivals, [], ["arrival", "event_id", "dup"], int_block("arrival"), [Run("ord", "sum", F.lit(1).cast("long"))])
    return a.select("event_id", "ts", "user_id", "value", "lon", "lat", "arrival", "dup", "ord")


_OA = ARR + """, oa AS (SELECT *, row_number() OVER (ORDER BY arrival, event_id, dup) AS ord FROM arrivals), dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS rn FROM oa WHERE lon <= 180) WHERE rn = 1)"""


@query("stream_admit", ARR + " SELECT CASE WHEN lon > 180 THEN 'lon' END AS reject, count(*) AS n FROM arrivals GROUP BY 1")
def stream_admit(t):
    path = W.land(_arr(t), "ord", 4)
    src = t.spark.readStream.schema(_arr(t).schema).option("maxFilesPerTrigger", W.LAND_TASKS).parquet(path)
    out, ck = scratch_path(t.spark, "admit"), scratch_path(t.spark, "ck")
    W.run_available(src.withColumn("reject", W.reject_reason()), out, ck)
    return t.spark.read.parquet(out).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedup", ARR + " SELECT DISTINCT event_id FROM arrivals WHERE lon <= 180")
def stream_dedup(t):
    path = W.land(_arr(t), "ord", 4)
    src = t.spark.readStream.schema(_arr(t).schema).option("maxFilesPerTrigger", W.LAND_TASKS).parquet(path)
    out, ck = scratch_path(t.spark, "dedup"), scratch_path(t.spark, "ck")
    W.run_available(W.dedup_stream(W.admit(src)[0], "36 hours").select("event_id"), out, ck)
    return t.spark.read.parquet(out)


@query("stream_dedup_batch", _OA + " SELECT event_id, ord FROM dd")
def stream_dedup_batch(t):
    return W.dedup(W.admit(_arr(t))[0], ["ord"]).select("event_id", "ord")


@query("stream_watermark", _OA + " SELECT event_id, dup, ts, arrival, max(ts) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 6 HOUR AS watermark FROM oa")
def stream_watermark(t):
    return W.watermarked(_arr(t), "ord", LATE).select("event_id", "dup", "ts", "arrival", "watermark")


_TUMBLE = """SELECT window_start, n AS count, round(s, 4) AS sum, mn AS min, mx AS max, round(s/n, 6) AS mean, round(ml, 6) AS mean_lon, round(mt, 6) AS mean_lat FROM (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, sum(value) AS s, min(value) AS mn, max(value) AS mx, avg(lon) AS ml, avg(lat) AS mt FROM dd GROUP BY 1)"""


def _rounded(df):
    return df.select("window_start", *[c for c in ("revision",) if c in df.columns], "count", F.round("sum", 4).alias("sum"), "min", "max",
                     *[F.round(c, 6).alias(c) for c in ("mean", "mean_lon", "mean_lat")])


@query("stream_tumble", _OA + ", x AS (" + _TUMBLE + ") SELECT * FROM x WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM dd) - INTERVAL 36 HOUR")
def stream_tumble(t):
    good = W.dedup(W.admit(_arr(t))[0], ["ord"])
    path = W.land(good, "ord", 4)
    src = t.spark.readStream.schema(good.schema).option("maxFilesPerTrigger", W.LAND_TASKS).parquet(path)
    out, ck = scratch_path(t.spark, "tumble"), scratch_path(t.spark, "ck")
    W.run_available(W.tumble(src.withWatermark("ts", "36 hours"), "1 hour"), out, ck)
    return _rounded(t.spark.read.parquet(out))


@query("stream_tumble_batch", _OA + " " + _TUMBLE)
def stream_tumble_batch(t):
    return _rounded(W.tumble(W.dedup(W.admit(_arr(t))[0], ["ord"]), "1 hour"))


_CLS = _OA + f""", sn AS (SELECT *, date_trunc('hour', ts) AS window_start, max(ts) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM dd),
cl AS (SELECT *, CASE WHEN seen IS NULL OR seen < window_start + INTERVAL 1 HOUR THEN 'on-time' WHEN seen < window_start + INTERVAL 7 HOUR THEN 'late' ELSE 'expired' END AS kind FROM sn),
bs AS (SELECT window_start, count(*) AS n, sum(value) AS s, min(value) AS mn, max(value) AS mx, sum(lon) AS sl, sum(lat) AS st FROM cl WHERE kind = 'on-time' GROUP BY 1),
lt AS (SELECT window_start, row_number() OVER w AS nth, count(*) OVER w AS n, sum(value) OVER w AS s, min(value) OVER w AS mn, max(value) OVER w AS mx, sum(lon) OVER w AS sl, sum(lat) OVER w AS st FROM cl WHERE kind = 'late' WINDOW w AS (PARTITION BY window_start ORDER BY ord)),
al AS (SELECT window_start, 1 AS revision, n, s, mn, mx, sl, st FROM bs UNION ALL SELECT window_start, nth + CASE WHEN bs.n IS NULL THEN 0 ELSE 1 END, coalesce(bs.n, 0) + lt.n, coalesce(bs.s, 0) + lt.s, least(bs.mn, lt.mn), greatest(bs.mx, lt.mx), coalesce(bs.sl, 0) + lt.sl, coalesce(bs.st, 0) + lt.st FROM lt LEFT JOIN bs USING (window_start)),
rv AS (SELECT window_start, CAST(revision AS BIGINT) AS revision, n AS count, s AS sum, mn AS min, mx AS max, s/n AS mean, sl/n AS mean_lon, st/n AS mean_lat FROM al WHERE revision <= {REVS})"""


def _classified(t):
    return W.classify(W.dedup(W.admit(_arr(t))[0], ["ord"]), "ord", SIZE, LATE)


def _revisions(t):
    from terralog.session import cut
    return W.late_revisions(cut(_classified(t), "classified"), "ord", REVS)


_RV = "SELECT window_start, revision, count, round(sum, 4) AS sum, min, max, round(mean, 6) AS mean, round(mean_lon, 6) AS mean_lon, round(mean_lat, 6) AS mean_lat FROM rv"


@query("late_revisions", f"{_CLS} {_RV}")
def late_revisions(t):
    return _rounded(_revisions(t))


@query("late_counts", f"{_CLS} SELECT kind, count(*) AS n FROM cl GROUP BY 1")
def late_counts(t):
    return W.late_counts(_classified(t))


@query("late_revisions_stream", f"{_CLS} {_RV} WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM dd)")
def late_revisions_stream(t):
    good = W.dedup(W.admit(_arr(t))[0], ["ord"])
    path = W.land(good, "ord", 4)
    src = t.spark.readStream.schema(good.schema).option("maxFilesPerTrigger", W.LAND_TASKS).parquet(path)
    sink = W.RevisionSink(scratch_path(t.spark, "revisions"), SIZE, LATE, REVS, "ord")
    q = src.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(t.spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return _rounded(sink.result(t.spark))


def _micro(c: str) -> str:
    return f"CAST(CAST(round({c}*1000000, 0) AS BIGINT) AS VARCHAR)"


@query("stream_digest", f"{_CLS}, o AS ({_RV}) SELECT window_start, revision, sha256(concat_ws('|', epoch_us(window_start), revision, count, " + ", ".join(_micro(c) for c in ("sum", "min", "max", "mean", "mean_lon", "mean_lat")) + ")) AS digest FROM o")
def stream_digest(t):
    return W.window_digest(_rounded(_revisions(t)))


@query("stream_retention", f"{_CLS}, w AS (SELECT DISTINCT window_start FROM rv ORDER BY 1 DESC LIMIT 48), r AS (SELECT rv.window_start, revision, count, row_number() OVER (PARTITION BY rv.window_start ORDER BY revision DESC) AS rn FROM rv SEMI JOIN w ON w.window_start = rv.window_start) SELECT window_start, revision, count FROM r WHERE rn <= 2")
def stream_retention(t):
    return W.retain_windows(_revisions(t), 48, 2).select("window_start", "revision", "count")


@query("stream_materialize", f"{_CLS} SELECT window_start, revision, count FROM rv WHERE revision > 1")
def stream_materialize(t):
    from terralog.session import cut
    revs = cut(_revisions(t), "revs")
    return W.insert_only(revs, revs.where("revision = 1")).select("window_start", "revision", "count")


@query("stream_resume", _OA + " SELECT date_trunc('day', ts) AS day, count(*) AS n FROM dd GROUP BY 1")
def stream_resume(t):
    good = W.dedup(W.admit(_arr(t))[0], ["ord"])
    half = good.agg((F.max("ord") / 2).alias("h")).first()["h"]
    path = W.land(good.where(F.col("ord") <= half), "ord", 2)
    out, ck = scratch_path(t.spark, "resume"), scratch_path(t.spark, "ck")
    for part in (None, good.where(F.col("ord") > half)):
        if part is not None:
            W.land(part, "ord", 2, path)
        src = t.spark.readStream.schema(good.schema).option("maxFilesPerTrigger", W.LAND_TASKS).parquet(path)
        W.run_available(W.dedup_stream(src, "36 hours"), out, ck)
    return t.spark.read.parquet(out).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _sources(t):
    e = t.arrivals.where("lon <= 180")
    return {f"s{i}": e.where(F.col("event_id") % 3 == i) for i in range(3)}


@query("source_union", ARR + " SELECT 's' || (event_id % 3) || '::' || event_id AS event_id, 's' || (event_id % 3) AS source, ts FROM arrivals WHERE lon <= 180")
def source_union(t):
    return U.source_union(_sources(t)).select("event_id", "source", "ts")


@query("stream_fusion", ARR + """, s AS (SELECT *, event_id % 3 AS so FROM arrivals WHERE lon <= 180), h AS (SELECT min(m) AS h FROM (SELECT so, max(ts) AS m FROM s WHERE so IN (0, 2) GROUP BY 1))
SELECT 's' || so || '::' || event_id AS event_id, row_number() OVER (ORDER BY ts, so, arrival) AS position FROM s, h WHERE ts <= h""")
def stream_fusion(t):
    return U.fuse(_sources(t), {"s0": U.LIVE, "s1": U.FINISHED, "s2": U.LIVE}).select("event_id", "position")


@query("stream_quota", _OA.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT ord, event_id, dup, arrival // 100 AS tick FROM oa), q AS (SELECT *, ord - 1 + max(tick*80 - (ord - 1)) OVER (ORDER BY ord) AS slot FROM p) SELECT event_id, dup, CAST(slot // 80 AS BIGINT) AS advance FROM q""")
def stream_quota(t):
    a = _arr(t).withColumn("tick", F.floor(F.col("arrival") / 100))
    return U.quota(a, "ord", "tick", 80).select("event_id", "dup", "advance")


# ---- keyed state: the clock moves by trigger, four slices of the arrivals ----------------------

_TRG = _OA + f""", ed AS (SELECT min(ord) AS lo, max(ord) AS hi FROM dd), tg AS (SELECT dd.*, (ord - lo) // ((hi - lo) // 4 + 1) AS trig FROM dd, ed),
tm AS (SELECT trig, max(date_trunc('millisecond', max(ts))) OVER (ORDER BY trig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM tg GROUP BY trig),
sn AS (SELECT tg.*, seen, date_trunc('hour', ts) AS window_start FROM tg JOIN tm USING (trig))""" + ",\ncl AS" + _CLS.split(",\ncl AS")[1] + ", fin AS (SELECT date_trunc('millisecond', max(ts)) AS seen FROM dd)"
_CLOSED = "window_start + INTERVAL 1 HOUR <= (SELECT seen FROM fin)"


def _landed(t, good, slices, path=None):
    """The deduplicated arrivals of some of the four slices, as a stream of one slice a trigger."""
    path = W.land(good.where(F.col("slice").isin(slices)), "slice", len(slices), path)
    return path, t.spark.readStream.schema(good.schema).option("maxFilesPerTrigger", W.LAND_TASKS).parquet(path)


def _sliced(t):
    from terralog.session import cut
    good = cut(W.dedup(W.admit(_arr(t))[0], ["ord"]), "good")
    edge = good.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).first()
    return cut(good.withColumn("slice", F.floor((F.col("ord") - edge["lo"]) / ((edge["hi"] - edge["lo"]) // 4 + 1)).cast("long")), "sliced")


def _revision_log(t, **bounds):
    """The log of the four slices, with a restart from the checkpoint after the second."""
    good, out, ck = _sliced(t), scratch_path(t.spark, "log"), scratch_path(t.spark, "ck")
    path, stream = _landed(t, good, [0, 1])
    S.run_log(S.revision_stream(stream, SIZE, LATE, REVS, **bounds), ck, out)
    _, stream = _landed(t, good, [2, 3], path)
    return S.run_log(S.revision_stream(stream, SIZE, LATE, REVS, **bounds), ck, out)


def _means(df):
    return df.select("window_start", "revision", "count", F.round("sum", 4).alias("sum"), "min", "max", *[F.round(F.col(c) / F.col("count"), 6).alias(n) for c, n in (("sum", "mean"), ("lon_sum", "mean_lon"), ("lat_sum", "mean_lat"))])


@query("late_revisions_state", f"{_TRG} {_RV} WHERE {_CLOSED}")
def late_revisions_state(t):
    return _means(S.retained(_revision_log(t)))


@query("late_revisions_trigger", f"{_TRG} {_RV}")
def late_revisions_trigger(t):
    from terralog.session import cut
    return _rounded(W.late_revisions(cut(S.classify_by_trigger(_sliced(t), "slice", SIZE, LATE), "classified"), "ord", REVS))


@query("stream_retention_state", f"{_TRG}, r AS (SELECT window_start, revision, count, row_number() OVER (PARTITION BY window_start ORDER BY revision DESC) AS rn FROM rv WHERE {_CLOSED} AND window_start + INTERVAL 49 HOUR > (SELECT seen FROM fin)) SELECT window_start, revision, count FROM r WHERE rn <= 2")
def stream_retention_state(t):
    return S.retained(_revision_log(t, keep_revisions=2, keep_s=48 * 3600)).select("window_start", "revision", "count")


@query("stream_publish", f"{_TRG} SELECT window_start, revision, count FROM rv WHERE {_CLOSED}")
def stream_publish(t):
    """The whole stream is read and published twice; the second time finds everything there."""
    good = _sliced(t)
    path, stream = _landed(t, good, [0, 1, 2, 3])
    sink = S.InsertOnly(scratch_path(t.spark, "published"))
    for _ in range(2):
        q = S.revision_stream(stream, SIZE, LATE, REVS).writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(t.spark, "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return sink.result(t.spark).select("window_start", "revision", "count")


# s0 and s1 are live in two triggers while s2 is paused; after a restart s1 is finished and s2 live. Horizons h0..h5, the third and the last trigger have no new events.
_FUSED = _TRG + """, e AS (SELECT event_id, ts, ord, event_id % 3 AS so, CAST(trig AS INT) + CASE WHEN trig >= 2 THEN 1 ELSE 0 END AS k FROM tg),
m AS (SELECT so, k, date_trunc('millisecond', max(ts)) AS top FROM e GROUP BY ALL),
h2 AS (SELECT min(top) AS h1, min(ever) AS h2 FROM (SELECT so, max(top) FILTER (k = 0) AS top, max(top) AS ever FROM m WHERE k <= 1 AND so IN (0, 1) GROUP BY so)),
h5 AS (SELECT min(top) AS h4, min(ever) AS h5 FROM (SELECT so, max(top) FILTER (k = 3) AS top, max(top) AS ever FROM m WHERE k >= 3 AND so IN (0, 2) GROUP BY so)),
h AS (SELECT k, CASE k WHEN 1 THEN h1 WHEN 2 THEN greatest(h1, h2) WHEN 3 THEN greatest(h1, h2) WHEN 4 THEN greatest(h1, h2, h4) WHEN 5 THEN greatest(h1, h2, h4, h5) END AS h FROM h2, h5, range(1, 6) r(k)),
r AS (SELECT e.so, e.event_id, e.ts, e.ord, min(h.k) AS release FROM e JOIN h ON h.k >= e.k AND date_trunc('millisecond', e.ts) <= h.h AND (e.so < 2 OR h.k >= 3) GROUP BY ALL)"""


@query("stream_fusion_state", _FUSED + " SELECT 's' || so || '::' || event_id AS event_id, row_number() OVER (ORDER BY release, ts, so, ord, 's' || so || '::' || event_id) AS position FROM r")
def stream_fusion_state(t):
    from terralog.session import cut
    good = _sliced(t).withColumn("arrival", F.col("ord"))
    own = {f"s{i}": cut(good.where(F.col("event_id") % 3 == i), f"s{i}") for i in range(3)}
    out, ck, paths = scratch_path(t.spark, "released"), scratch_path(t.spark, "ck"), dict.fromkeys(own)
    for slices, states in (([0, 1], {"s0": U.LIVE, "s1": U.LIVE, "s2": U.PAUSED}), ([2, 3], {"s0": U.LIVE, "s1": U.FINISHED, "s2": U.LIVE})):
        streams = {}
        for n, d in own.items():
            paths[n], streams[n] = _landed(t, d, slices, paths[n])
        log = S.run_log(S.fuse_streams(streams, states, 400 * 86400), ck, out)
    return S.positions(log).select("event_id", "position")

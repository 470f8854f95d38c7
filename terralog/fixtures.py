"""Derived inputs: spatial and log tables computed from the base tables by integer arithmetic.

Each fixture exists twice, as a DataFrame and as the SQL text the oracle runs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy readers over one data folder."""

    NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
             "pages benchmark labels conversations").split()

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name in Tables.NAMES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def units(self) -> DataFrame:
        n = self.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"))
        k = F.col("c_custkey")
        return self.customer.join(n, F.col("o_custkey") == k, "left").select(
            k.alias("unit_id"), lon_of(k).alias("lon"), lat_of(k).alias("lat"),
            F.when(k % 17 != 0, F.col("c_acctbal")).alias("value"), F.when(k % 7 != 0, F.col("orders")).alias("denominator"),
            F.col("c_nationkey").alias("zone"))

    @cached_property
    def population(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(k.alias("unit_id"), lon_of(k).alias("lon"), lat_of(k).alias("lat"),
                                    (1 + k % 97).alias("population"), F.col("c_nationkey").alias("community"))

    @cached_property
    def facilities(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("fac_id"), lon_of(k * 31 + 7).alias("lon"), lat_of(k * 31 + 7).alias("lat"),
                                    (500 + k % 500).alias("capacity"), (5 + k % 20).alias("cost"))

    @cached_property
    def observations(self) -> DataFrame:
        k = F.col("user_id") * 13 + F.hour("ts")
        return self.events.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("entity_id"), "ts", "value",
                                  lon_of(k).alias("lon"), lat_of(k).alias("lat"))

    @cached_property
    def arrivals(self) -> DataFrame:
        e = F.col("event_id")
        delay = F.when(e % 53 == 0, 400).when(e % 11 == 0, 40).otherwise(0)
        return self.events.select(
            e, F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", (e + delay).alias("arrival"),
            F.when(e % 101 == 0, F.lit(200.0)).otherwise(lon_of(e)).alias("lon"), lat_of(e).alias("lat"),
            F.explode(F.when(e % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("dup"))

    @cached_property
    def surface(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.orders.select((k % SURFACE_WIDTH).cast("int").alias("gx"),
                                  F.floor(k / SURFACE_WIDTH).cast("int").alias("gy"),
                                  (F.col("o_totalprice") % 61).alias("elev"))

    @cached_property
    def zones(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.nation.select(k.alias("zone_id"), (116.0 + (k % 5) / 5.0).alias("west"),
                                  (39.5 + F.floor(k / 5) / 5.0).alias("south"),
                                  (116.0 + (k % 5 + 1) / 5.0).alias("east"),
                                  (39.5 + (F.floor(k / 5) + 1) / 5.0).alias("north"))

    @cached_property
    def log(self) -> DataFrame:
        rows = self.conversations.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("type", F.expr(LOG_TYPE))
        return rows.where("type is not null").selectExpr(*[f"{sql} AS {name}" for name, sql in LOG_COLUMNS.items()])

    @cached_property
    def sessions(self) -> DataFrame:
        c = F.col("conv_id")
        return self.conversations.select(c).distinct().select(
            c.alias("session_id"), F.when(c >= 1, F.floor(c / 3)).alias("parent_id"), (c % 4).alias("cwd"))

    @cached_property
    def tasks(self) -> DataFrame:
        k = F.col("p_partkey")
        blockers = F.filter(F.array(
            F.when(k >= 1, F.floor(k / 2)), F.when(k % 97 == 0, k + 1000000000), F.when(k % 89 == 0, k),
            F.when((k % 83 == 0) & (k > 0), k + 1), F.when((k % 83 == 1) & (k > 1), k - 1)),
            lambda v: v.isNotNull())
        status = F.when(k % 71 == 5, "deleted").otherwise(F.element_at(F.array(*map(F.lit, ("pending", "in_progress", "completed"))), (k % 3 + 1).cast("int")))
        scope = F.when(k % 10 == 0, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", "p_brand"))
        return self.part.select(k.alias("id"), blockers.alias("blocked_by"), status.alias("status"), scope.alias("write_scope"))


SURFACE_WIDTH = 128


def lon_of(k: Column) -> Column:
    return F.lit(116.0) + ((k * 7919) % 10007) / F.lit(10007.0)


def lat_of(k: Column) -> Column:
    return F.lit(39.5) + ((k * 104729) % 10009) / F.lit(10009.0)


# ---- session log: one expression set, read by both engines -------------------------------

LOG_TYPE = """CASE
 WHEN role = 'system' AND k = 0 THEN 'system/message'
 WHEN role = 'user' AND k = 0 THEN 'turn/start'
 WHEN role = 'user' AND k = 1 AND (conv_id + turn) % 9 <> 0 THEN 'step/start'
 WHEN role = 'user' AND k = 2 THEN 'user/message'
 WHEN role = 'user' AND k = 3 AND turn % 4 >= 2 THEN 'compaction/prune'
 WHEN role = 'user' AND k = 4 AND turn % 4 >= 2 THEN 'user/message'
 WHEN role = 'user' AND k = 5 AND turn % 5 <= 1 THEN 'inbox/spliced'
 WHEN role = 'assistant' AND k = 0 THEN 'assistant/delta'
 WHEN role = 'assistant' AND k = 1 THEN 'assistant/message'
 WHEN role = 'assistant' AND k = 2 AND (conv_id * 31 + turn) % 3 = 0 THEN 'tool/call'
 WHEN role = 'assistant' AND k = 3 AND (conv_id * 31 + turn) % 3 = 0 AND (conv_id + turn) % 10 <> 0 THEN 'tool/result'
 WHEN role = 'assistant' AND k = 4 THEN 'step/end'
 WHEN role = 'assistant' AND k = 5 THEN 'turn/end' END"""

LOG_COLUMNS = {
    "session_id": "conv_id",
    "seq": "turn * 8 + k",
    "type": "type",
    "turn": "CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END",
    "source": "CASE WHEN type = 'user/message' THEN CASE WHEN k = 2 THEN 'user' ELSE 'compaction' END END",
    "call_id": "CASE WHEN type IN ('tool/call', 'tool/result') THEN concat('c', conv_id, '-', turn) END",
    "text": """CASE WHEN type = 'user/message' AND k = 4 THEN concat('summary of turn ', turn - 2)
 WHEN type IN ('user/message', 'assistant/message', 'system/message', 'assistant/delta') THEN text
 WHEN type = 'tool/call' THEN concat('{"q": ', turn, '}') WHEN type = 'tool/result' THEN concat('result ', turn) END""",
    "name": "CASE WHEN type = 'tool/call' THEN 'lookup' END",
    "is_error": "type = 'tool/result' AND (conv_id + turn) % 4 = 0",
    "reason": """CASE WHEN type = 'turn/end' THEN CASE WHEN (conv_id + turn) % 7 = 0 THEN 'error'
 WHEN (conv_id + turn) % 11 = 0 THEN 'aborted' ELSE 'completed' END END""",
    "outcome": "CASE WHEN type = 'inbox/spliced' THEN CASE WHEN conv_id % 2 = 0 THEN 'canceled' ELSE 'claimed' END END",
    "replace_seq": "CASE WHEN type = 'compaction/prune' OR (type = 'user/message' AND k = 4) THEN (turn - 2) * 8 + 2 END",
    # a summary replaces a run of the log; the claim before it states the same run, but for some that state one too many
    "replace_to": """CASE WHEN type = 'compaction/prune' OR (type = 'user/message' AND k = 4) THEN (turn - 2) * 8 + 2 + (conv_id + turn) % 3 * 5
 + CASE WHEN type = 'compaction/prune' AND (conv_id + turn) % 13 = 0 THEN 1 ELSE 0 END END""",
    "price": "CASE WHEN type = 'compaction/prune' THEN 5 + turn END",
    "input_tokens": "CASE WHEN type = 'assistant/message' THEN 100 + length(text) % 900 END",
    "output_tokens": "CASE WHEN type = 'assistant/message' THEN 1 + length(text) % 77 END",
    "cache_read": "CASE WHEN type = 'assistant/message' THEN length(text) % 50 END",
    "cache_write": "CASE WHEN type = 'assistant/message' THEN length(text) % 20 END",
    "context_window": "CASE WHEN type = 'assistant/message' THEN 4096 + turn END",
    "time_ms": "1704067200000 + (turn * 8 + k) * 1000 + length(text) % 500",
}

LON_SQL = "(116.0::DOUBLE + (({k}*7919) % 10007)/10007.0::DOUBLE)"
LAT_SQL = "(39.5::DOUBLE + (({k}*104729) % 10009)/10009.0::DOUBLE)"


def lonlat_sql(k: str) -> str:
    return f"{LON_SQL.format(k=k)} AS lon, {LAT_SQL.format(k=k)} AS lat"


def hav_sql(a: str, b: str) -> str:
    """Haversine metres between two aliases carrying lon and lat."""
    return (f"(2*6371008.8::DOUBLE*asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)"
            f"+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2)))))")


SQL = {
    "units": f"""units AS (SELECT c_custkey AS unit_id, {lonlat_sql('c_custkey')},
 CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS value, CASE WHEN c_custkey % 7 <> 0 THEN CAST(n AS DOUBLE) END AS denominator, c_nationkey AS zone
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)""",
    "population": f"""population AS (SELECT c_custkey AS unit_id, {lonlat_sql('c_custkey')},
 1 + c_custkey % 97 AS population, c_nationkey AS community FROM customer)""",
    "facilities": f"""facilities AS (SELECT s_suppkey AS fac_id, {lonlat_sql('(s_suppkey*31+7)')},
 500 + s_suppkey % 500 AS capacity, 5 + s_suppkey % 20 AS cost FROM supplier)""",
    "observations": f"""observations AS (SELECT event_id AS obs_id, user_id AS entity_id, ts, value,
 {lonlat_sql('(user_id*13+hour(ts))')} FROM events)""",
    "arrivals": f"""arrivals AS (SELECT event_id, ts, user_id, value,
 event_id + CASE WHEN event_id % 53 = 0 THEN 400 WHEN event_id % 11 = 0 THEN 40 ELSE 0 END AS arrival,
 CASE WHEN event_id % 101 = 0 THEN 200.0::DOUBLE ELSE {LON_SQL.format(k='event_id')} END AS lon,
 {LAT_SQL.format(k='event_id')} AS lat, dup FROM events, (VALUES (0), (1)) d(dup) WHERE dup = 0 OR event_id % 29 = 0)""",
    "surface": f"""surface AS (SELECT CAST(o_orderkey % {SURFACE_WIDTH} AS INT) AS gx,
 CAST(o_orderkey // {SURFACE_WIDTH} AS INT) AS gy, o_totalprice % 61 AS elev FROM orders)""",
    "zones": """zones AS (SELECT n_nationkey AS zone_id, 116.0::DOUBLE + (n_nationkey % 5)/5.0::DOUBLE AS west,
 39.5::DOUBLE + (n_nationkey // 5)/5.0::DOUBLE AS south, 116.0::DOUBLE + (n_nationkey % 5 + 1)/5.0::DOUBLE AS east,
 39.5::DOUBLE + (n_nationkey // 5 + 1)/5.0::DOUBLE AS north FROM nation)""",
    "log": "log AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in LOG_COLUMNS.items())
           + f" FROM (SELECT *, {LOG_TYPE} AS type FROM conversations, (VALUES (0),(1),(2),(3),(4),(5)) s(k)) WHERE type IS NOT NULL)",
    "sessions": """sessions AS (SELECT DISTINCT conv_id AS session_id,
 CASE WHEN conv_id >= 1 THEN conv_id // 3 END AS parent_id, conv_id % 4 AS cwd FROM conversations)""",
    "tasks": """tasks AS (SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey >= 1 THEN p_partkey // 2 END,
 CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 1000000000 END, CASE WHEN p_partkey % 89 = 0 THEN p_partkey END,
 CASE WHEN p_partkey % 83 = 0 AND p_partkey > 0 THEN p_partkey + 1 END, CASE WHEN p_partkey % 83 = 1 AND p_partkey > 1 THEN p_partkey - 1 END],
 lambda v: v IS NOT NULL) AS blocked_by, CASE WHEN p_partkey % 71 = 5 THEN 'deleted' ELSE ['pending','in_progress','completed'][p_partkey % 3 + 1] END AS status,
 CASE WHEN p_partkey % 10 = 0 THEN p_type ELSE concat_ws('/', p_type, p_brand) END AS write_scope FROM part)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause holding the named fixtures (no trailing comma)."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)

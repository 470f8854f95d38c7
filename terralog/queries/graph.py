"""Lineage, dependency, diff and reference queries."""

from pyspark.sql import functions as F

from terralog.fixtures import with_sql
from terralog.operators import lineage as L
from terralog.operators.viz import bounded_rows
from terralog.queries.registry import query


@query("session_trace", with_sql("sessions", recursive=True) + """, up AS (SELECT session_id AS src, parent_id AS node, -1 AS depth FROM sessions WHERE parent_id IS NOT NULL UNION ALL SELECT src, parent_id, depth - 1 FROM up JOIN sessions ON session_id = node WHERE parent_id IS NOT NULL)
SELECT src, node, depth FROM up UNION ALL SELECT node, src, -depth FROM up UNION ALL SELECT session_id, session_id, 0 FROM sessions""")
def session_trace(t):
    return L.session_trace(t.sessions, t.sessions.select(F.col("session_id").alias("id")))


@query("flatten_lineage", with_sql("sessions", recursive=True) + """, t AS (SELECT session_id, 0 AS depth, lpad(CAST(session_id AS VARCHAR), 12, '0') AS path FROM sessions WHERE parent_id IS NULL
 UNION ALL SELECT s.session_id, depth + 1, path || '/' || lpad(CAST(s.session_id AS VARCHAR), 12, '0') FROM sessions s JOIN t ON s.parent_id = t.session_id) SELECT * FROM t""")
def flatten_lineage(t):
    return L.flatten_lineage(t.sessions.withColumn("pos", F.col("session_id")))


@query("dependency_check", with_sql("tasks", recursive=True) + """, here AS (SELECT * FROM tasks WHERE status <> 'deleted'), e AS (SELECT id, unnest(blocked_by) AS blocker FROM here),
reach AS (SELECT id, blocker FROM e WHERE id <> blocker UNION SELECT r.id, e.blocker FROM reach r JOIN e ON e.id = r.blocker AND e.id <> e.blocker)
SELECT DISTINCT id, blocker, 'missing' AS violation FROM e WHERE blocker NOT IN (SELECT id FROM here) UNION ALL SELECT DISTINCT id, blocker, 'self' FROM e WHERE id = blocker
 UNION ALL SELECT id, blocker, 'duplicate' FROM e GROUP BY ALL HAVING count(*) > 1
 UNION ALL SELECT DISTINCT e.id, e.blocker, 'cycle' FROM e JOIN reach r ON r.id = e.blocker AND r.blocker = e.id WHERE e.id <> e.blocker""")
def dependency_check(t):
    return L.dependency_check(t.tasks)


@query("task_readiness", with_sql("tasks") + """, e AS (SELECT id, unnest(blocked_by) AS blocker FROM tasks), r AS (SELECT e.id, bool_and(coalesce(b.status = 'completed', false)) AS free FROM e LEFT JOIN tasks b ON b.id = e.blocker GROUP BY 1)
SELECT t.id, t.status = 'pending' AND coalesce(free, true) AS ready, (SELECT count(*) FROM tasks o WHERE o.status = 'in_progress' AND o.id <> t.id AND (o.write_scope = t.write_scope OR starts_with(o.write_scope, t.write_scope || '/') OR starts_with(t.write_scope, o.write_scope || '/'))) AS overlaps FROM tasks t LEFT JOIN r ON r.id = t.id""")
def task_readiness(t):
    return L.task_readiness(t.tasks)


@query("scope_overlaps", with_sql("tasks") + """, b AS (SELECT write_scope AS other, count(*) AS n, min(id) AS first_id FROM tasks WHERE status = 'in_progress' GROUP BY 1)
SELECT s.write_scope, other, n, first_id FROM (SELECT DISTINCT write_scope FROM tasks) s JOIN b ON other = s.write_scope OR starts_with(other, s.write_scope || '/') OR starts_with(s.write_scope, other || '/')""")
def scope_overlaps(t):
    return L.scope_overlaps(t.tasks)


def _layers(t):
    k = F.col("p_partkey")
    base = t.part.select(k.alias("id"), F.md5("p_name").alias("digest"), k.alias("position"))
    cur = t.part.where(k % 7 != 0).select(k.alias("id"), F.when(k % 11 == 0, F.md5("p_brand")).otherwise(F.md5("p_name")).alias("digest"), (k - F.floor(k / 7) - 1).alias("position"))
    top = t.part.where(k < 20).select((k + 1000000000).alias("id"), F.md5("p_name").alias("digest"), (k + 1000000000).alias("position"))
    return base, cur.unionByName(top)


_LAYERS = """WITH b AS (SELECT p_partkey AS id, md5(p_name) AS digest, p_partkey AS position FROM part),
c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN md5(p_brand) ELSE md5(p_name) END AS digest, p_partkey - p_partkey // 7 - 1 AS position FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey + 1000000000, md5(p_name), p_partkey + 1000000000 FROM part WHERE p_partkey < 20),
d AS (SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN b.digest <> c.digest THEN 'changed' ELSE 'same' END AS change, b.position AS base_pos, c.position AS cur_pos FROM b FULL JOIN c ON b.id = c.id)"""


@query("layer_diff", _LAYERS + " SELECT * FROM d")
def layer_diff(t):
    return L.layer_diff(*_layers(t))


@query("layer_diff_summary", _LAYERS + " SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'added') = 0 AND bool_or(base_pos IS NOT NULL AND base_pos IS DISTINCT FROM cur_pos) AS reordered FROM d")
def layer_diff_summary(t):
    return L.diff_summary(L.layer_diff(*_layers(t)))


@query("merge_ordered", """WITH c AS (SELECT p_partkey AS id, (p_partkey * 7919) % 1000003 AS pos FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS id, p_partkey AS pos, p_name AS value FROM part WHERE p_partkey % 5 <> 0),
k AS (SELECT b.*, c.pos AS cp FROM b LEFT JOIN c USING (id)), a AS (SELECT k.*, coalesce(cp, (SELECT arg_min(n.cp, n.pos) FROM k n WHERE n.pos > k.pos AND n.cp IS NOT NULL), 4611686018427387904) AS anchor FROM k)
SELECT id, value, row_number() OVER (ORDER BY anchor, cp IS NOT NULL, pos) AS position FROM a""")
def merge_ordered(t):
    k = F.col("p_partkey")
    cur = t.part.where(k % 3 != 0).select(k.alias("id"), ((k * 7919) % 1000003).alias("pos"))
    base = t.part.where(k % 5 != 0).select(k.alias("id"), k.alias("pos"), F.col("p_name").alias("value"))
    return L.merge_ordered(cur, base)


_KINDS = ("map-layer", "report", "export", "job", "backup-pin", "reader-pin")


def _protect(t):
    li = t.lineitem.select(
        (F.col("l_partkey") + F.when(F.col("l_partkey") % 3 == 0, 1000000000).otherwise(0)).alias("target"), F.col("l_orderkey").alias("holder"), F.col("l_returnflag").alias("detail"), ((F.col("l_linenumber") - 1) % 6).alias("kind"))
    return L.protectors({k: li.where(F.col("kind") == i).drop("kind") for i, k in enumerate(_KINDS)})


_PROT = """p AS (SELECT ['map-layer','report','export','job','backup-pin','reader-pin'][(l_linenumber - 1) % 6 + 1] AS kind, l_partkey + CASE WHEN l_partkey % 3 = 0 THEN 1000000000 ELSE 0 END AS target, l_orderkey AS holder, l_returnflag AS detail FROM lineitem)"""


@query("dataset_protectors", f"WITH {_PROT} SELECT * FROM p")
def dataset_protectors(t):
    return _protect(t)


@query("reclaim_candidates", f"WITH {_PROT} SELECT p_partkey AS target FROM part WHERE p_size < 25 AND p_partkey NOT IN (SELECT target FROM p)")
def reclaim_candidates(t):
    return L.reclaimable(t.part.where("p_size < 25").select(F.col("p_partkey").alias("target")), _protect(t))


@query("semantic_lookup", """WITH d AS (SELECT p_brand || '/' || p_type AS definition_id, p_partkey AS version, p_type AS alias, p_name AS applicability FROM part WHERE p_partkey % 13 <> 0),
l AS (SELECT definition_id, max(version) AS version, arg_max(alias, version) AS alias, arg_max(applicability, version) AS applicability FROM d GROUP BY 1), h AS (SELECT * FROM l WHERE alias = 'ECONOMY' AND applicability LIKE '%red%')
SELECT definition_id, version, (SELECT count(*) FROM h) AS total FROM h ORDER BY definition_id LIMIT 32""")
def semantic_lookup(t):
    d = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("definition_id"), F.col("p_partkey").alias("version"),
                      F.array(F.col("p_type"), F.lower("p_brand")).alias("aliases"), F.col("p_name").alias("applicability"))
    return L.semantic_lookup(d, d.where("version % 13 = 0"), "ECONOMY", "red").select("definition_id", "version", "total")


def _versions(t):
    k = F.col("o_custkey")
    return t.orders.groupBy(k.alias("resource_id")).agg(F.max("o_orderkey").alias("version"), F.sum("o_totalprice").cast("decimal(20,2)").cast("string").alias("d")).select(
        "resource_id", "version", F.sha2("d", 256).alias("digest"), (F.col("resource_id") % 10 == 3).alias("revoked"),
        F.when(F.col("resource_id") % 4 == 0, "restricted").otherwise("local").alias("authorization"))


@query("resource_resolve", """WITH v AS (SELECT o_custkey AS resource_id, max(o_orderkey) AS version FROM orders GROUP BY 1)
SELECT o_custkey AS resource_id, o_orderkey AS version, CASE WHEN v.resource_id IS NULL THEN 'not-found' WHEN o_custkey % 10 = 3 THEN 'revoked' ELSE 'available' END AS status FROM orders LEFT JOIN v ON v.resource_id = o_custkey AND version = o_orderkey AND o_custkey % 4 <> 0""")
def resource_resolve(t):
    refs = t.orders.select(F.col("o_custkey").alias("resource_id"), F.col("o_orderkey").alias("version"))
    return L.resource_resolve(refs, _versions(t), "local").select("resource_id", "version", "status")


@query("resource_register", """SELECT l_returnflag || l_linestatus AS resource_id, count(*) AS feature_count, 'l_orderkey:bigint,l_linenumber:int,l_quantity:double' AS schema, sha256(array_to_string(list_sort(list(sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}'))), '')) IS NOT NULL AS digested FROM lineitem GROUP BY 1""")
def resource_register(t):
    from terralog.sources.catalog import register
    li = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("resource_id"), "l_orderkey", "l_linenumber", "l_quantity")
    r = register(li, "resource_id", "EPSG:4326", "local")
    return r.select("resource_id", "feature_count", "schema", F.col("digest").isNotNull().alias("digested"))


@query("resource_features", """WITH f AS (SELECT l_linenumber AS resource_id, 1 AS version, l_orderkey*8 + l_linenumber AS position FROM lineitem), d AS (SELECT DISTINCT * FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY position) AS rn, count(*) OVER (PARTITION BY resource_id) AS total FROM d) SELECT resource_id, version, position, total FROM r WHERE rn <= 256 AND resource_id <> 3""")
def resource_features(t):
    f = t.lineitem.select(F.col("l_linenumber").alias("resource_id"), F.lit(1).alias("version"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position")).distinct()
    res = f.select("resource_id", "version").distinct().withColumn("status", F.when(F.col("resource_id") == 3, "revoked").otherwise("available"))
    return L.resource_features(res, f).select("resource_id", "version", "position", "total")


@query("citation_join", """WITH x AS (SELECT url, min(CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id END) AS title, min(sha256(html)) AS snippet FROM pages GROUP BY 1)
SELECT page_id, p.url, snippet, coalesce(title, regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS label FROM pages p LEFT JOIN x ON x.url = p.url""")
def citation_join(t):
    k = F.col("page_id")
    ex = t.pages.groupBy("url").agg(F.min(F.when(k % 2 == 0, F.concat(F.lit("page "), k))).alias("title"), F.min(F.sha2("html", 256)).alias("snippet"))
    return L.citations(t.pages.select("page_id", "url"), ex).select("page_id", "url", "snippet", "label")


def _pages(t):
    return t.lineitem.select(F.col("l_suppkey").alias("request"), (F.col("l_orderkey") % 40).alias("offset"), F.col("l_partkey").alias("item_id"), F.lit(500).alias("total"))


@query("paged_collect", """SELECT l_suppkey AS request, 500 AS total, count(DISTINCT l_partkey) AS collected, CASE WHEN count(DISTINCT l_partkey) < 500 THEN 'partial' ELSE 'complete' END AS coverage, count(DISTINCT l_partkey) < 500 AS has_more,
 CASE WHEN count(DISTINCT l_partkey) < 500 THEN max(l_orderkey % 40) + count(DISTINCT l_partkey) FILTER (l_orderkey % 40 = last) END AS next_offset FROM (SELECT *, max(l_orderkey % 40) OVER (PARTITION BY l_suppkey) AS last FROM lineitem) GROUP BY 1""")
def paged_collect(t):
    return L.paged_collect(_pages(t))[1]


@query("paged_rows", "SELECT DISTINCT l_suppkey AS request, l_partkey AS item_id FROM lineitem")
def paged_rows(t):
    return L.paged_collect(_pages(t))[0]


@query("top_orders_bounded", """SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total, true AS truncated FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
def top_orders_bounded(t):
    return bounded_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 100)

"""Session trees, task graphs, layer diffs and reference protection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.plans.iterate import ancestors, on_cycles, reachable
from terralog.plans.running import Run, int_block, next_seen, running
from terralog.session import cut


def session_trace(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Ancestors (negative depth) and descendants (positive) of each asked session."""
    links = sessions.where("parent_id IS NOT NULL").select(F.col("session_id").alias("child"), F.col("parent_id").alias("parent"))
    up = reachable(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), ids)
    down = reachable(links.select(F.col("parent").alias("a"), F.col("child").alias("b")), ids)
    return up.where("depth > 0").withColumn("depth", -F.col("depth")).unionByName(down)


def flatten_lineage(sessions: DataFrame) -> DataFrame:
    """Pre-order of the session forest: depth and a path key whose text order places every child
    after its parent and siblings in input order.

    ``sessions``: session_id, parent_id, pos. Orphans and cycle members become roots.
    """
    tree = sessions.select(F.col("session_id").alias("id"), F.col("parent_id").alias("parent"))
    info = ancestors(tree)
    ok = info.join(tree, "id")
    # a cycle member stands as a root; so does a node whose parent is unknown
    root_less = tree.join(tree.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    if info.where("cyclic").limit(1).count():
        loose = ok.where("cyclic").select(F.col("id").alias("a"), F.col("parent").alias("b"))
        root_less = root_less.join(on_cycles(loose).select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    pos = sessions.select(F.col("session_id").alias("id"), F.lpad(F.col("pos").cast("string"), 12, "0").alias("key"))
    at = cut(pos.join(root_less, "id", "left").select("id", F.col("parent").alias("up"), F.col("key").alias("path"), F.lit(0).alias("depth")), "path")
    # hops double, so this ends after as many rounds as the depth has binary digits
    while at.where("up IS NOT NULL").limit(1).count():
        nxt = at.select(F.col("id").alias("mid"), F.col("up").alias("up2"), F.col("path").alias("head"), F.col("depth").alias("d2"))
        # every hop joins the partial path of the node it points to; hops double each round
        at = cut(at.join(nxt, at.up == nxt.mid, "left").select(
            "id", F.col("up2").alias("up"), F.concat_ws("/", "head", "path").alias("path"),
            F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("d2") + 1).alias("depth")), "path")
    return at.select(F.col("id").alias("session_id"), "depth", "path")


def dependency_check(tasks: DataFrame) -> DataFrame:
    """``id, blocker, violation``: missing, repeated, self or cyclic blockers. Deleted tasks are as good as absent."""
    tasks = tasks.where(F.coalesce("status", F.lit("")) != "deleted")
    e = cut(tasks.select("id", F.explode("blocked_by").alias("blocker")), "deps")
    ids = tasks.select(F.col("id").alias("blocker"))
    missing = e.join(ids, "blocker", "left_anti").select("id", "blocker").distinct().withColumn("violation", F.lit("missing"))
    own = e.where("id = blocker").distinct().withColumn("violation", F.lit("self"))
    twice = e.groupBy("id", "blocker").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", "blocker").withColumn("violation", F.lit("duplicate"))
    ring = on_cycles(e.where("id <> blocker").select(F.col("id").alias("a"), F.col("blocker").alias("b")))
    cyc = ring.select(F.col("a").alias("id"), F.col("b").alias("blocker"), F.lit("cycle").alias("violation"))
    return reduce(DataFrame.unionByName, (missing, own, twice, cyc))


def task_readiness(tasks: DataFrame) -> DataFrame:
    """Readiness, and how many in-progress tasks have an equal, containing or contained write scope.

    Overlap is counted between distinct scopes, each carrying its task count, so tasks that share
    one scope are never paired with each other.
    """
    e = tasks.select("id", F.explode("blocked_by").alias("blocker"))
    done = tasks.select(F.col("id").alias("blocker"), (F.col("status") == "completed").alias("done"))
    ready = e.join(done, "blocker", "left").groupBy("id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("free"))
    busy = tasks.where("status = 'in_progress'").groupBy("write_scope").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    scopes = tasks.select("write_scope").distinct()

    def climb(df: DataFrame) -> DataFrame:
        parts = F.split("write_scope", "/")
        ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        return df.withColumn("up", F.explode(ups))
    inside = climb(scopes).join(busy.withColumnRenamed("write_scope", "up"), "up").select("write_scope", "n", "up")
    contained = (climb(busy).where("up <> write_scope").select(F.col("up").alias("write_scope"), "n").join(scopes, "write_scope", "left_semi"))
    near = inside.select("write_scope", "n").unionByName(contained).groupBy("write_scope").agg(F.sum("n").alias("n"))
    own = F.when(F.col("status") == "in_progress", 1).otherwise(0)
    return (tasks.join(ready, "id", "left").join(near, "write_scope", "left")
            .select("id", ((F.col("status") == "pending") & F.coalesce("free", F.lit(True))).alias("ready"),
                    (F.coalesce("n", F.lit(0)) - own).cast("long").alias("overlaps")))


def scope_overlaps(tasks: DataFrame) -> DataFrame:
    """Distinct scope pairs where one contains the other (or both are equal) and the second holds
    in-progress tasks, with how many and the smallest id. A task's warnings are its scope's rows."""
    busy = tasks.where("status = 'in_progress'").groupBy("write_scope").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    scopes = tasks.select("write_scope").distinct()

    def ups(df: DataFrame) -> DataFrame:
        parts = F.split("write_scope", "/")
        return df.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    above = ups(scopes).join(busy.withColumnRenamed("write_scope", "up"), "up").select("write_scope", F.col("up").alias("other"), "n", "first_id")
    below = ups(busy).where("up <> write_scope").select(F.col("up").alias("write_scope"), F.col("write_scope").alias("other"), "n", "first_id")
    return above.unionByName(below.join(scopes, "write_scope", "left_semi"))


def layer_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Per layer id: added, removed, changed or same, and both positions."""
    b = base.select("id", F.col("digest").alias("_bd"), F.col("position").alias("base_pos"))
    c = current.select("id", F.col("digest").alias("_cd"), F.col("position").alias("cur_pos"))
    change = (F.when(F.col("base_pos").isNull(), "added").when(F.col("cur_pos").isNull(), "removed")
              .when(F.col("_bd") != F.col("_cd"), "changed").otherwise("same"))
    return b.join(c, "id", "full").select("id", change.alias("change"), "base_pos", "cur_pos")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per difference; order counts as changed only when nothing was added."""
    n = {k: F.count_if(F.col("change") == k) for k in ("added", "removed", "changed")}
    moved = F.coalesce(F.bool_or(F.col("base_pos").isNotNull() & ~F.col("base_pos").eqNullSafe(F.col("cur_pos"))), F.lit(False))
    return diff.agg(*[v.alias(k) for k, v in n.items()], ((n["added"] == 0) & moved).alias("reordered"))


def merge_ordered(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline values in the established order; new ids go before the nearest following known id.

    ``current``: id, pos. ``baseline``: id, pos, value. Result adds the merged 1-based position.
    """
    known = current.select("id", F.col("pos").alias("cur_pos"))
    d = baseline.join(known, "id", "left")
    d = running(d, [], ["pos"], int_block("pos"), [next_seen("_n", ["pos"], F.col("cur_pos"), F.col("cur_pos").isNotNull())])
    last = F.lit(2 ** 62).cast("long")
    d = d.withColumn("_anchor", F.coalesce("cur_pos", "_n.v", last).cast("long")).withColumn("_known", F.when(F.col("cur_pos").isNull(), 0).otherwise(1))
    out = running(d, [], ["_anchor", "_known", "pos"], int_block("_anchor"), [Run("position", "sum", F.lit(1).cast("long"))])
    return out.select("id", "value", "position")


def protectors(edges: dict[str, DataFrame]) -> DataFrame:
    """All edges ``kind, target, holder, detail`` that protect a version."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), "target", "holder", "detail") for k, d in edges.items()])


def reclaimable(released: DataFrame, edges: DataFrame) -> DataFrame:
    return released.join(edges.select("target"), "target", "left_anti")


def semantic_lookup(defs: DataFrame, revoked: DataFrame, query: str, applicability: str, limit: int = 32) -> DataFrame:
    """Latest unrevoked version per definition with an exact alias and a matching applicability."""
    if not 1 <= limit <= 32:
        raise ValueError("limit must be within 1..32")
    live = defs.join(revoked.select("definition_id", "version"), ["definition_id", "version"], "left_anti")
    rest = [c for c in live.columns if c != "definition_id"]
    top = live.groupBy("definition_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("definition_id", "r.*")
    hit = top.where(F.exists("aliases", lambda a: a == query) & F.col("applicability").contains(applicability))
    total = hit.agg(F.count(F.lit(1)).alias("c")).scalar()
    return hit.orderBy("definition_id").limit(limit).withColumn("total", total)


def resource_resolve(refs: DataFrame, versions: DataFrame, domain: str) -> DataFrame:
    """Exact version after the authorization filter: not-found, revoked or available."""
    mine = versions.where(F.col("authorization") == domain).drop("authorization")
    status = F.when(F.col("digest").isNull(), "not-found").when(F.col("revoked"), "revoked").otherwise("available")
    return refs.join(mine, ["resource_id", "version"], "left").withColumn("status", status).drop("revoked")


def resource_features(resolved: DataFrame, features: DataFrame, cap: int = 256) -> DataFrame:
    """First ``cap`` feature refs of each available version (by position), with the full count."""
    from terralog.operators.retention import newest
    f = features.join(resolved.where("status = 'available'").select("resource_id", "version"), ["resource_id", "version"], "left_semi")
    total = f.groupBy("resource_id", "version").agg(F.count(F.lit(1)).alias("total"))
    head = newest(f.withColumn("_neg", -F.col("position")), ["resource_id", "version"], ["_neg"], int_block("_neg"), cap)
    return head.join(total, ["resource_id", "version"]).drop("_neg", "age")


def citations(items: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Excerpt of each result by URL; the title falls back to the host name."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1)
    return items.join(excerpts, "url", "left").withColumn("label", F.coalesce("title", host))


def paged_collect(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deduplicated rows, and per request the coverage against the declared total.

    ``pages``: request, offset, item_id, total.
    """
    rows = pages.select("request", "item_id").distinct()
    # the page that starts furthest on, and the rows it brought: the next page starts behind them
    sizes = pages.groupBy("request", "offset").agg(F.count_distinct("item_id").alias("rows"), F.max("total").alias("total"))
    said = sizes.groupBy("request").agg(F.max("total").alias("total"), F.max(F.struct("offset", "rows")).alias("_last"))
    got = rows.groupBy("request").agg(F.count(F.lit(1)).alias("collected"))
    more = F.col("collected") < F.col("total")
    cover = said.join(got, "request").select(
        "request", "total", "collected", F.when(more, "partial").otherwise("complete").alias("coverage"), more.alias("has_more"),
        F.when(more, F.col("_last.offset") + F.col("_last.rows")).alias("next_offset"))
    return rows, cover

"""Fixpoints over edge tables: components, ancestors, order and peeling.

Each round ends in a written table, so lineage stays short; loops stop on convergence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.session import cut


def components(nodes: DataFrame, edges: DataFrame, limit: int = 64) -> DataFrame:
    """Smallest reachable node id per node, over undirected ``a, b`` edges.

    Each round takes the least label among the neighbours and then the label of that label, which
    about halves the distance to the root; long chains need logarithmically many rounds.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(nodes.select(F.col("id"), F.col("id").alias("label")), "labels")
    for _ in range(limit):
        seen = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels.id == seen.a, "left").select("id", "label", F.least("label", "near").alias("low"))
        # hook the old root under the new label, so whole trees move at once
        hooks = step.where("low < label").groupBy("label").agg(F.min("low").alias("up")).withColumnRenamed("label", "root")
        step = cut(step.join(hooks, step.low == hooks.root, "left").select("id", "label", F.least("low", "up").alias("low")), "step")
        jump = step.select(F.col("id").alias("at"), F.col("low").alias("next"))
        new = cut(step.join(jump, step.low == jump["at"], "left").select("id", F.least("low", "next").alias("label"), F.col("label").alias("old")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not converge")


def ancestors(parents: DataFrame, limit: int = 64) -> DataFrame:
    """``id, root, depth, cyclic``: pointer doubling over ``id, parent``; an absent parent ends the walk.

    ``root`` of a node on or below a cycle is null and ``cyclic`` is true.
    """
    known = parents.select(F.col("id").alias("pid"))
    at = cut(parents.join(known, parents.parent == known.pid, "left").select(
        "id", F.col("pid").alias("up"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("depth")), "up")
    n = max(at.count(), 1)
    for _ in range(min(limit, n.bit_length() + 1)):
        if not at.where("up IS NOT NULL").limit(1).count():
            break
        nxt = at.select(F.col("id").alias("mid"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        at = cut(at.join(nxt, at.up == nxt.mid, "left").select(
            "id", "up2", (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
        ).withColumnRenamed("up2", "up"), "up")
    return at.select("id", "depth", F.col("up").isNotNull().alias("cyclic"))


def reachable(edges: DataFrame, start: DataFrame, limit: int = 10_000) -> DataFrame:
    """``src, node, depth``: nodes reached from each start along ``a -> b``; cycles end a walk."""
    seen = cut(start.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("depth")), "seen")
    front = seen
    for d in range(1, limit):
        nxt = front.join(edges, front.node == edges.a).select("src", F.col("b").alias("node")).distinct()
        front = cut(nxt.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("depth", F.lit(d)), "front")
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front), "seen")
    raise RuntimeError("walk did not end")


def _peel(edges: DataFrame) -> DataFrame:
    """Edges left after taking away, round by round, those out of sources and into sinks."""
    left, size = edges, edges.count()
    while size:
        kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        left = cut(kept.join(kept.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "edges")
        now = left.count()
        if now == size:
            break
        size = now
    return left


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Largest label that reaches each node along ``a -> b``; ``labels`` are ``id, label`` of all nodes."""
    while True:
        met = edges.join(labels, edges.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.max("label").alias("met"))
        new = cut(labels.join(met, "id", "left").select("id", F.greatest("label", "met").alias("label"), (F.col("met") > F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges on a cycle: those whose ends lie in one strongly connected component.

    Every round spreads the largest id forward; inside the nodes that got one id, those that reach its owner backward are its component. Edges
    between components are on no cycle and go; what remains undecided is peeled and taken up in the next round.
    """
    left = _peel(cut(edges.select("a", "b").distinct(), "edges"))
    found = left.limit(0)
    while left.limit(1).count():
        ids = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct()
        owner = _spread(left, ids.select("id", F.col("id").alias("label")))
        a_of, b_of = owner.select(F.col("id").alias("a"), F.col("label").alias("la")), owner.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        same = cut(left.join(a_of, "a").join(b_of, "b").where("la = lb").select("a", "b", F.col("la").alias("owner")), "same")
        # backward from the owner, along edges of its own colour
        back = _spread(same.select(F.col("b").alias("a"), F.col("a").alias("b")), owner.select("id", F.when(F.col("id") == F.col("label"), 1).otherwise(0).alias("label")))
        inside = back.where("label = 1").select("id")
        ends = same.join(inside.select(F.col("id").alias("a"), F.lit(True).alias("ia")), "a", "left").join(inside.select(F.col("id").alias("b"), F.lit(True).alias("ib")), "b", "left")
        ends = cut(ends.select("a", "b", F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib")), "ends")
        found = cut(found.unionByName(ends.where("ia AND ib").select("a", "b")), "cycles")
        left = _peel(cut(ends.where("NOT ia AND NOT ib").select("a", "b"), "edges"))
    return found

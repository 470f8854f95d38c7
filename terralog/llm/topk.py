"""Exact k best inner products of a query set against all vectors.

Queries are dealt into tiles and candidates into shards; each (tile, shard) cell is one bounded group. Inside a cell a matrix product
scores a block of candidates at a time and a partial selection keeps ``k`` per query; the lists then merge up a tree of shards
in Spark. A cell holds at most ``cell_mb`` of vectors a side, whatever the size of the tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.session import cut

BLOCK = 2048                      # candidates scored at a time
EXACT = float(1 << 53)            # doubles below hold every integer
TOP = "query_id long, query_key long, shard int, top array<struct<minus:long,vec_id:long>>"
LONG_MAX = (1 << 63) - 1


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, vec``: each component x becomes floor(scale * x). Rows without an id or with a null or non-finite component go."""
    def sound(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    named = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    return named.where("vec_id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", sound)).select(
        "vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys and components of the rows of one dimension, by ascending id."""
    rows = table.filter(pa.compute.equal(table["dim"], dim)).sort_by([("vec_id", "ascending"), ("key", "ascending")])
    flat = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows["vec_id"].to_numpy(), rows["key"].to_numpy(), flat.reshape(len(rows), dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, as doubles where these hold them and else as Python integers clamped to a long."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)))
    largest = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if largest * BLOCK < EXACT:
        return q.astype(float) @ c.astype(float).T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -LONG_MAX, LONG_MAX)


def best_of_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, score and id of the k best candidates of a block; ``cid`` ascends, so position breaks ties."""
    s, n = _scores(q, c), len(cid)
    own = np.searchsorted(cid, qid, "left"), np.searchsorted(cid, qid, "right")
    mine = np.zeros(s.shape, bool)
    for i in np.flatnonzero(own[0] < own[1]):
        mine[i, own[0][i]:own[1][i]] = True
    if s.dtype == object:
        order = np.array([sorted(range(n), key=lambda j: (mine[i, j], -s[i, j], j))[:k] for i in range(len(qid))]).reshape(len(qid), -1)
    else:
        rank = s * n - np.arange(n)           # unique: a better score first, then a smaller position
        rank[mine] = -np.inf
        order = np.argpartition(-rank, min(k, n) - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(qid)), order.shape[1])
    cols = order.ravel()
    keep = ~mine[rows, cols]
    rows, cols = rows[keep], cols[keep]
    return rows, s[rows, cols], cid[cols]


def _cell(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qids, keys, tops = [], [], []
        # a side without rows comes without columns
        dims = np.intersect1d(left["dim"].to_numpy(), right["dim"].to_numpy()) if len(left) and len(right) else []
        for dim in dims:
            qid, qkey, q = _matrix(left, int(dim))
            cid, _, c = _matrix(right, int(dim))
            found = [best_of_block(qid, q, cid[a:a + BLOCK], c[a:a + BLOCK], k) for a in range(0, len(cid), BLOCK)]
            row, score, ids = (np.concatenate([x[i] for x in found]) for i in range(3))
            minus = np.array([-int(x) for x in score], dtype=np.int64)
            order = np.lexsort((ids, minus, row))
            row, minus, ids = row[order], minus[order], ids[order]
            first = np.searchsorted(row, np.arange(len(qid)))
            last = np.searchsorted(row, np.arange(len(qid)), "right")
            for i in np.flatnonzero(last > first):
                a, b = first[i], min(last[i], first[i] + k)
                qids.append(int(qid[i]))
                keys.append(int(qkey[i]))
                tops.append([{"minus": int(m), "vec_id": int(v)} for m, v in zip(minus[a:b], ids[a:b])])
        kind = pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())]))
        return pa.table({"query_id": pa.array(qids, pa.int64()), "query_key": pa.array(keys, pa.int64()),
                         "shard": pa.array([key[1].as_py()] * len(qids), pa.int32()), "top": pa.array(tops, kind)})
    return run


def exact_topk(vectors: DataFrame, is_query, k: int = 10, cell_mb: int = 16, fan_in: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``vec_id, vec``; ``is_query`` is a condition on ``vec_id``.

    A query is compared with all vectors of its own length but those with its own id; ties go to the smaller id. Rows repeated
    in id and vector count once; an id with several vectors is several queries and candidates. Scores are exact integers, beyond
    a long clamped to it. A query with fewer than k others gets all of them; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select("vec_id", "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("key")).dropDuplicates(["vec_id", "key"]), "vectors")
    queries = rows.where(is_query)
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    nq = queries.count()
    most = max(256, (cell_mb << 20) // (8 * max(dim or 1, 1)))
    tiles = max(1, -(-nq // most))
    shards = max(1, -(-n // most), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // tiles))
    deal = F.xxhash64("vec_id", "key", F.lit("cell"))
    left = queries.select("*", F.pmod(deal, F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    # aliases: both sides of a cogroup come from one table, and must not share attributes
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns], F.pmod(deal, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    lists = left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard")).applyInArrow(_cell(k), TOP)
    while shards > 1:
        shards = -(-shards // fan_in)
        lists = lists.groupBy("query_id", "query_key", F.floor(F.col("shard") / fan_in).cast("int").alias("shard")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return lists.select("query_id", F.posexplode("top").alias("at", "best")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("best.vec_id").alias("vec_id"), (-F.col("best.minus")).alias("score"))

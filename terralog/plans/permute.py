"""Permutations whose values are computed, not sorted: a keyed bijection of the ranks 0..n-1 for every draw.

A rank is written as ``left * b + right`` and each half is shifted in turn by a keyed function of the other (a Feistel network over a x b >= n); a
result beyond n - 1 goes through again until it is below. Keys come from md5 of seed, draw and round, the function is arithmetic modulo a prime, so another engine
can compute the same permutation. The inverse runs the rounds backward.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import md5
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values of the bijection.
ROUNDS = 6
PRIME = 2_147_483_647
FACTOR = 48_271

LOOKUP_ROWS = 1 << 23              # values held by every task (64 MB at most); beyond it they go by a shuffle
CELLS = 1 << 18                    # ranks x draws computed at once
SLICE_ROWS = 500                   # rows whose draws leave a Python worker together


def round_keys(seed: int, draws: int) -> np.ndarray:
    """``draws x ROUNDS`` keys of 28 bits, for draws 1, 2, .."""
    return np.array([[int(md5(f"{seed}|{d}|{k}".encode()).hexdigest()[:7], 16) for k in range(ROUNDS)] for d in range(1, draws + 1)], dtype=np.int64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x % PRIME`` of numbers below 2^62; the prime is 2^31 - 1, so no division is needed."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


def _shift(half: np.ndarray, key: np.ndarray) -> np.ndarray:
    v = _reduced(half + key)
    return _reduced(_reduced(v * v) * FACTOR)


def _once(x: np.ndarray, keys: np.ndarray, a: int, b: int, inverse: bool) -> np.ndarray:
    left, right = x // b, x % b
    for k in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        sign = -1 if inverse else 1
        if k % 2:
            right = (right + sign * _shift(left, keys[:, k])) % b
        else:
            left = (left + sign * _shift(right, keys[:, k])) % a
    return left * b + right


def permute(ranks: np.ndarray, keys: np.ndarray, n: int, inverse: bool = False) -> np.ndarray:
    """``len(ranks) x len(keys)``: where every rank goes in every draw (or, inverse, which rank goes there)."""
    draws = len(keys)
    a = isqrt(n - 1) + 1 if n > 0 else 1
    b = -(-n // a)
    out = np.empty((len(ranks), draws), dtype=np.int64)
    step = max(1, CELLS // max(draws, 1))
    for at in range(0, len(ranks), step):
        part = np.repeat(ranks[at:at + step], draws)
        own = np.tile(np.arange(draws), len(part) // max(draws, 1))
        open_ = np.arange(len(part))
        while len(open_):
            part[open_] = _once(part[open_], keys[own[open_]], a, b, inverse)
            open_ = open_[part[open_] >= n]
        out[at:at + step] = part.reshape(-1, draws)
    return out


def in_slices(batches: Iterable[pa.RecordBatch], run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run`` over a few rows at a time, whatever the size of the batches, so that arrays of draws never pile up in a worker."""
    for b in batches:
        for at in range(0, len(b), SLICE_ROWS):
            yield run(b.slice(at, SLICE_ROWS))


def lists_of(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    n, wide = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * wide, wide) if wide else np.zeros(n + 1), pa.int32()), pa.array(values.ravel()))


def with_lists(rows: DataFrame, **named: tuple[T.DataType, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Add columns of lists, each a function of the ranks with a row per rank."""
    schema = T.StructType([*rows.schema, *[T.StructField(n, T.ArrayType(t)) for n, (t, _) in named.items()]])

    def add(b: pa.RecordBatch) -> pa.RecordBatch:
        rank = b.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, *[lists_of(f(rank)).cast(pa.list_(to_arrow_type(t))) for t, f in named.values()]], names=[*b.schema.names, *named])
    return rows.mapInArrow(lambda batches: in_slices(batches, add), schema)


def drawn_values(ranked: DataFrame, value: str, n: int, keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The values of all rows in order of rank, held by every task: a function of ranks that gives the value in every draw."""
    held = ranked.sparkSession.sparkContext.broadcast(ranked.orderBy("rank").select(value).toArrow()[value].to_numpy())
    return lambda rank: held.value[permute(rank, keys, n)]


def with_draws(ranked: DataFrame, value: str, n: int, keys: np.ndarray, name: str = "zs", lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Add ``name``: per row (``rank``, unique, 0..n-1) the ``value`` it has in every draw, which is that of the rank it is sent to.

    Up to ``lookup_rows`` rows every task holds the values in order of rank; beyond, each row sends its value to the ranks that ask for it, one row per rank and draw.
    """
    if n <= lookup_rows:
        return with_lists(ranked, **{name: (ranked.schema[value].dataType, drawn_values(ranked, value, n, keys))})
    asked = with_lists(ranked.select("rank", F.col(value).alias("v")), to=(T.LongType(), lambda rank: permute(rank, keys, n, inverse=True)))
    sent = asked.select("v", F.posexplode("to").alias("draw", "rank"))
    got = sent.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "v"))), lambda s: s["v"]).alias(name))
    return ranked.join(got, "rank").select(*ranked.columns, name)


def heads(spark, n: int, most: int, keys: np.ndarray) -> DataFrame:
    """``draw, pos, rank``: the ranks at positions 1..most of every draw (from 1 on)."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def standing(pos: pd.Series) -> pd.Series:
        return pd.Series(list(permute(pos.to_numpy(np.int64) - 1, keys, n, inverse=True)))
    placed = spark.range(1, most + 1).select(F.col("id").alias("pos"), F.posexplode(standing("id")).alias("draw", "rank"))
    return placed.select((F.col("draw") + 1).alias("draw"), "pos", "rank")


def permute_sql(seed: int, draws: int, source: str, values: str, order: str) -> str:
    """CTEs ending in ``dr(draw, <values>, pos)``, draw 0 being the base order by md5; ``order`` breaks ties. Needs WITH RECURSIVE."""
    keys = ", ".join(f"CAST('0x' || left(md5('{seed}|' || r || '|{k}'), 7) AS BIGINT) AS k{k}" for k in range(ROUNDS))
    shift = lambda half, k: f"((({half} + k{k}) % {PRIME})*(({half} + k{k}) % {PRIME}) % {PRIME}*{FACTOR} % {PRIME})"
    names = "draw, rk, a, b, n, " + ", ".join(f"k{k}" for k in range(ROUNDS))

    def once(x: str, source: str) -> str:
        text = f"(SELECT {names}, {x} // b AS l, {x} % b AS r FROM {source})"
        for k in range(ROUNDS):
            halves = f"l, (r + {shift('l', k)}) % b AS r" if k % 2 else f"(l + {shift('r', k)}) % a AS l, r"
            text = f"(SELECT {names}, {halves} FROM {text})"
        return f"SELECT draw, rk, l*b + r AS sent FROM {text}"
    return f"""bs AS (SELECT {values}, row_number() OVER (ORDER BY md5('{seed}|0|' || {order}), {order}) - 1 AS rk FROM {source}),
sz AS (SELECT n, a, CAST(ceil(n/a::DOUBLE) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM bs)),
kc AS (SELECT r AS draw, {keys} FROM range(1, {draws + 1}) p(r)),
wk AS ({once('rk', 'bs, kc, sz')} UNION ALL {once('sent', '(SELECT * FROM wk WHERE sent >= (SELECT n FROM sz)) JOIN kc USING (draw), sz')}),
dr AS (SELECT 0 AS draw, {values}, rk + 1 AS pos FROM bs UNION ALL SELECT draw, {values}, sent + 1 AS pos FROM wk JOIN bs USING (rk) WHERE sent < (SELECT n FROM sz))"""

"""Ordered running aggregates that never put one key into one task.

A plain ``Window.partitionBy(key)`` sends a whole key to a single task; one session
or entity may hold a third of all rows. Here each key is cut into ordered blocks:

1. partial aggregate per (key, block)         -- map-side combined
2. exclusive running aggregate over blocks    -- one row per block
3. window inside (key, block), plus the carry -- tasks are bounded by the block

Everything order-dependent in this package is a running sum, min or max: a lag is the
running maximum of ``struct(order, value)`` over the earlier rows, "last non-null" is the
same over the rows where the value is set, and lead is the mirrored minimum.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Run:
    """One running aggregate: op over the rows before (or after) each row."""

    name: str
    op: str
    value: Column
    inclusive: bool = True
    backward: bool = False


def last_seen(name: str, order: list[str], value: Column, when: Column | None = None,
              inclusive: bool = True) -> Run:
    """Latest row (by order) at or before each row for which ``when`` holds."""
    packed = F.struct(*[F.col(c) for c in order], value.alias("v"))
    return Run(name, "max", packed if when is None else F.when(when, packed), inclusive)


def next_seen(name: str, order: list[str], value: Column, when: Column | None = None,
              inclusive: bool = False) -> Run:
    """Earliest row (by order) after each row for which ``when`` holds."""
    packed = F.struct(*[F.col(c) for c in order], value.alias("v"))
    return Run(name, "min", packed if when is None else F.when(when, packed), inclusive, True)


def int_block(col: str, rows: int = BLOCK_ROWS) -> Column:
    """Block id for an integer order column."""
    return F.floor(F.col(col) / F.lit(rows)).cast("long")


def _combine(op: str, carry: Column, inner: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
    both = F.greatest(carry, inner) if op == "max" else F.least(carry, inner)
    return both


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, runs: list[Run],
            keep: Column | None = None) -> DataFrame:
    """Add one column per run. ``block`` must not decrease along ``order`` inside a key.

    Order columns must not be null. ``keep`` may drop whole blocks by their carry columns ``_c0, _c1, ...`` before the inner sort,
    for callers that only need the head of each key.
    """
    values = {f"_v{i}": r.value for i, r in enumerate(runs)}
    base = df.withColumn("_blk", block).withColumns(values)
    # A key that may be null travels inside a struct, where nulls compare equal: the join below and
    # the inner window then share one hash partitioning, which a null-safe comparison would not give.
    part = [*keys, "_blk"]
    if any(df.schema[k].nullable for k in keys):
        base = base.withColumn("_part", F.struct(*part))
        part = ["_part"]
        keyed = {k: F.col(f"_part.{k}") for k in [*keys, "_blk"]}
    else:
        keyed = {k: F.col(k) for k in part}

    per_block = base.groupBy(*part).agg(*[_AGG[r.op](f"_v{i}").alias(f"_b{i}") for i, r in enumerate(runs)])
    by_key = [keyed[k] for k in keys] or [F.lit(0)]
    fwd = Window.partitionBy(*by_key).orderBy(keyed["_blk"].asc()).rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*by_key).orderBy(keyed["_blk"].desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *[F.col(c).alias(f"_k_{c}") for c in part],
        *[_AGG[r.op](f"_b{i}").over(bwd if r.backward else fwd).alias(f"_c{i}") for i, r in enumerate(runs)])

    # Keys that fit one block carry nothing; without them the carry table is small enough to broadcast.
    carry = carry.where(reduce(lambda a, b: a | b, [F.col(f"_c{i}").isNotNull() for i in range(len(runs))]))
    on = reduce(lambda a, b: a & b, [base[c] == carry[f"_k_{c}"] for c in part])
    joined = base.join(carry, on, "left").drop(*[f"_k_{c}" for c in part])

    if keep is not None:
        joined = joined.where(keep)
    asc = [F.col(c).asc() for c in order]
    desc = [F.col(c).desc() for c in order]
    out = {}
    for i, r in enumerate(runs):
        w = Window.partitionBy(*part).orderBy(*(desc if r.backward else asc))
        w = w.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        out[r.name] = _combine(r.op, F.col(f"_c{i}"), _AGG[r.op](f"_v{i}").over(w))
    keep = [*df.columns, *out]
    return joined.withColumns(out).select(*keep)

"""Global ordering without a single-task sort.

Ranks over a whole table are taken over *distinct* values (a value shared by a third of the
rows is one row by then), cut into ranges at approximate percentiles and numbered inside each
range; the range offsets come from one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.plans.running import Run, running

HASH_BITS = 60
MIN_BITS, MAX_BITS = 7, 13


def block_bits(df: DataFrame) -> int:
    """log2 of the number of ranges: about four per shuffle partition, so ranges shrink as the cluster grows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BITS, min(MAX_BITS, (4 * parts - 1).bit_length()))


def with_range(df: DataFrame, col: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``, a monotone bucket id of a numeric column; the splits are one scalar subquery.

    ``ranges`` is a power of two.
    """
    ranges = ranges or 1 << block_bits(df)
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    splits = df.select(F.percentile_approx(F.col(col).cast("double"), probs, F.lit(max(20_000, 4 * ranges))).alias("s")).scalar()
    bound = df.withColumn("_splits", splits)
    # binary search over 2^k - 1 sorted splits
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length() - 1))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_splits", at + step - 1) <= F.col(col).cast("double"), at + step).otherwise(at)).cast("long")
    return bound.withColumn("_range", bucket).drop("_splits")


def value_ranks(df: DataFrame, col: str, ranges: int | None = None) -> DataFrame:
    """Per distinct value: ``n`` rows, ``below`` rows strictly smaller, ``dense`` 1-based rank."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return running(with_range(counts, col, ranges), [], [col], F.col("_range"), [
        Run("below", "sum", F.col("n"), inclusive=False),
        Run("dense", "sum", F.lit(1).cast("long")),
    ]).drop("_range")


def hash60(text: Column) -> Column:
    """First 60 bits of the md5 of a text, as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_block(df: DataFrame, digest: str) -> Column:
    """Digests are uniform, so their leading bits cut any key into even, ordered blocks."""
    return F.shiftright(digest, HASH_BITS - block_bits(df))


def hash_positions(df: DataFrame, keys: list[str], digest: str, tie: str, name: str) -> DataFrame:
    """1-based position by (digest, tie) inside each key; ``digest`` comes from ``hash60``."""
    block = hash_block(df, digest)
    return running(df, keys, [digest, tie], block, [Run(name, "sum", F.lit(1).cast("long"))])


def dense_ids(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """1-based position over unique rows, ordered by the sha of ``cols`` (stable, not sorted by value)."""
    keyed = df.withColumn("_h", hash60(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])))
    return hash_positions(keyed, [], "_h", cols[0], name).drop("_h")


def group_order_stats(df: DataFrame, keys: list[str], col: str, picks: dict[str, "callable"]) -> DataFrame:
    """Exact order statistics per group. ``picks`` maps a name to a function of the group size
    giving the 1-based rank wanted. Values are counted first, so ties and hot groups stay small."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(with_range(counts, col), keys, [col], F.col("_range"), [Run("_upto", "sum", F.col("_n"))])
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    joined = ranked.join(sizes, keys)
    hit = {k: (F.col("_upto") >= f(F.col("_size"))) & (F.col("_upto") - F.col("_n") < f(F.col("_size"))) for k, f in picks.items()}
    return joined.groupBy(*keys).agg(*[F.max(F.when(c, F.col(col))).alias(k) for k, c in hit.items()])

"""Immutable chunked versions: fixed rows per chunk, a manifest with bounds, pruned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.functions.geo import tile_bounds
from terralog.operators.records import canonical_digest
from terralog.plans.running import BLOCK_ROWS, Run, int_block, running
from terralog.session import cut

OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def _digest(row: Column) -> Column:
    """Order-free digest of a group of rows: four lanes of summed row-digest digits."""
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return F.sha2(F.concat_ws("|", *lanes), 256)


def ingest(df: DataFrame, order: str, chunk_rows: int, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write the version and return its manifest. ``order`` is a unique integer column."""
    numbered = running(df, [], [order], int_block(order, block_rows), [Run("_row", "sum", F.lit(1).cast("long"))])
    chunked = numbered.withColumn("chunk", F.floor((F.col("_row") - 1) / chunk_rows).cast("long")).drop("_row")
    chunked.repartitionByRange("chunk", order).sortWithinPartitions("chunk", order).write.partitionBy("chunk").parquet(f"{path}/rows")
    stored = rows(df.sparkSession, path, df)
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    manifest = stored.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes"), _digest(canonical_digest({c: F.col(c) for c in df.columns})).alias("digest"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    manifest.write.parquet(f"{path}/manifest")
    return df.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")


def rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = like.select(*like.columns, F.lit(0).cast("long").alias("chunk")).schema
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_range(stored: DataFrame, from_chunk: int, chunks: int) -> DataFrame:
    return stored.where((F.col("chunk") >= from_chunk) & (F.col("chunk") < from_chunk + chunks))


def read_tile(stored: DataFrame, manifest: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """Rows of a tile; chunks whose bounds miss it are pruned (the join prunes partitions at run time)."""
    west, south, east, north = tile_bounds(z, x, y)
    near = manifest.where((F.col("west") < east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") > south)).select("chunk")
    return stored.join(near, "chunk", "left_semi").where((F.col("lon") >= west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") <= north))


def predicate(field: str, op: str, value: float) -> Column:
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    return getattr(F.col(field), OPS[op])(F.lit(float(value)))


def read_query(stored: DataFrame, field: str, op: str, value: float) -> DataFrame:
    return stored.where(predicate(field, op, value))


def scan(stored: DataFrame, manifest: DataFrame, order: str, field: str, op: str, value: float, sample_rows: int) -> DataFrame:
    """One record: chunks, rows and bytes scanned, matches, a bounded sample, and a digest of its parts."""
    hit = predicate(field, op, value)
    total = stored.agg(F.count(F.lit(1)).alias("rows_scanned"), F.count_if(hit).alias("matched"))
    parts = manifest.agg(F.struct(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("b"), _digest(F.sha2(F.concat_ws(":", "chunk", "digest"), 256)).alias("d")).alias("m")).scalar()
    head = cut(stored.where(hit).orderBy(order).limit(sample_rows).select(F.col(order).alias("o")), "sample")
    sample = head.agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda v: v.cast("string")), ",").alias("s")).scalar()
    d = total.withColumn("_m", parts).withColumn("sample", sample)
    return d.select(F.col("_m.c").alias("chunks_done"), "rows_scanned", F.col("_m.b").alias("bytes_scanned"), "matched", "sample",
                    F.sha2(F.concat_ws("|", F.col("_m.d"), F.lit(f"{field}{op}{value}"), "rows_scanned", "matched", "sample"), 256).alias("digest"))

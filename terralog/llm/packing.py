"""Pack documents into sequences of at most ``capacity`` tokens by cutting stock over the histogram of piece lengths.

A document is cut at every ``capacity`` tokens; its last piece is shorter. Widths are lengths rounded up to ``unit`` tokens, which bounds the
histogram and with it the linear program on the driver (``capacity / unit`` rows), and wastes under ``unit`` tokens a piece.
Pieces are ranked inside their width; a pattern used t times with a pieces of a width takes the next a * t ranks. Ranks are a
number inside the scan task plus the counts of the tasks before, so no width, however common, is sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralog.llm.cutting_stock import patterns
from terralog.llm.tokens import memo, wide
from terralog.llm.worker_memory import small_batches, tidy
from terralog.session import cut, scratch_path

PIECES = "part int, row long, doc_id long, start long, length int, doc_tokens long, width int, nth long, ids binary"
TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
NAMES = [x.split()[0] for x in PIECES.split(", ")]
BATCH_BYTES = 8 << 20
WIDE_ROWS = 1000


def _cutter(tokenizer: str, capacity: int, unit: int):
    def run(batches):
        words, part, row = memo(tokenizer), TaskContext.get().partitionId(), 0
        size_of = np.dtype(words.kind).itemsize
        seen = np.zeros(-(-capacity // unit) + 1, dtype=np.int64)
        out, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.encode(text.as_py())
                n = len(ids) // size_of
                for a in range(0, n, capacity):
                    length = min(capacity, n - a)
                    width = -(-length // unit)
                    out.append((part, row, doc, a, length, n, width, int(seen[width]), ids[size_of * a:size_of * (a + length)]))
                    seen[width] += 1
                    row += 1
                    size += size_of * length
                if size >= BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)
    return run


def _widen(batches):
    """Ids from the stored width to 32 bits."""
    for b in batches:
        at, ids, n = b.schema.get_field_index("ids"), b.column("ids"), b.column("length").to_pylist()
        for a in range(0, len(b), WIDE_ROWS):
            out = [wide(x.as_py(), f"<u{len(x.as_py()) // k}") for x, k in zip(ids[a:a + WIDE_ROWS], n[a:a + WIDE_ROWS])]
            yield b.slice(a, WIDE_ROWS).set_column(at, "ids", pa.array(out, pa.binary()))


def plan_table(spark: SparkSession, demand: dict[int, int], slots: int) -> DataFrame:
    """``width, low, high, first_sequence, per``: ranks low..high-1 of a width go to sequences from the first on, ``per`` in each."""
    rows, taken, sequence = [], dict.fromkeys(demand, 0), 0
    for pattern, times in patterns(demand, slots):
        for width, per in pattern.items():
            rows.append((width, taken[width], taken[width] + per * times, sequence, per))
            taken[width] += per * times
        sequence += times
    return spark.createDataFrame(rows, "width int, low long, high long, first_sequence long, per int")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, unit: int = 8) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``, one row per piece; ``ids`` are unsigned 32-bit little-endian.

    Null and empty texts are one piece, the end id. Rows that share an id, and rows without one, are documents of their own. Pieces of a
    sequence are gapless from offset 0, longest first. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path = scratch_path(spark, "pieces")
    # token ids are most of what this operator keeps on disk, and shrink well
    with small_batches(spark):
        rows.mapInArrow(tidy(_cutter(tokenizer, capacity, unit)), PIECES).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    counts = cut(pieces.groupBy("part", "width").count(), "counts")
    # the histogram: one row per width, capacity / unit at most
    demand = {r["width"]: r["n"] for r in counts.groupBy("width").agg(F.sum("count").alias("n")).collect()}
    if not demand:
        return pieces.select("doc_id", "start", F.col("length").cast("long"), "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    before = Window.partitionBy("width").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "width", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # a few rows per basic pattern and one basic pattern per width, so its size is bounded by capacity / unit
    plan = F.broadcast(plan_table(spark, demand, capacity // unit))
    ranked = pieces.drop("ids", "doc_id", "start", "doc_tokens").join(base, ["part", "width"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(plan, (ranked["width"] == plan["width"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "part", "row", "length", ranked["width"], "rank", (F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("per"))).cast("long").alias("sequence_id"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("width"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("part", "row", "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"))
    whole = pieces.join(placed, ["part", "row"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "sequence_id", "offset", "ids")
    return whole.mapInArrow(tidy(_widen), whole.schema)

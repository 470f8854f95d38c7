"""Repeated lines across documents, in DataFrame functions only.

Lines are range-partitioned by a 128-bit hash of their key and sorted by document and position; streaming over that order,
every line whose document is not the first of its key is marked. Text is not shuffled for this: only hashes, and the result per document
is a sparse bitmap (64 lines a word, words without a dropped line left out).

A line may be in a third of all documents. So there are two passes: the first sorts by (key, salt), the salt being a hash of the document,
and marks every line whose document is not the first of its salt (it cannot be the first of all); the second sees at most one document per key and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog.session import cut

#: The ASCII white space that is stripped, and the letters that are lowered; other letters stay as they are.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """Null and empty texts have one empty line; trailing empty lines count."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _identity(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_size")]


DOC = ["doc_id", "text_hash", "text_size"]


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``doc_id, text_hash, text_size, pos``: lines that another document with a smaller id holds already."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.select(*_identity(id_col, text_col), F.posexplode(lines_of(F.col(f"`{text_col}`"))).alias("pos", "line")).select(
        *DOC, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars).select(
        *DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    lines = cut(lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")), "lines")

    def mark(rows: DataFrame, keys: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.repartitionByRange(parts, *keys).withColumn("late", ~F.col("doc_id").eqNullSafe(F.first("doc_id").over(ordered)))

    near = cut(mark(lines, [*HASH, "salt"]), "lines")
    far = mark(near.where(~F.col("late")).drop("late"), HASH)
    return near.where("late").select(*DOC, "pos").unionByName(far.where("late").select(*DOC, "pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text_size, bitmap, n_dropped``: a map from word number to 64 bits, one bit per dropped line."""
    words = dropped.groupBy(*DOC, F.shiftright("pos", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy(*DOC).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap"),
                                   F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, bitmap, kept_text``, one row per input row.

    Keys of at least ``min_chars`` code points held by two or more documents stay only in the smallest id that holds them.
    A document is its id: rows that share an id never drop each other's lines, and a null id is one document that sorts last.
    Null text is one empty line. ``bitmap`` is null where nothing is dropped. An empty table gives no rows.
    """
    maps = drop_bitmaps(dropped_lines(docs, id_col, text_col, min_chars))
    rows = docs.select(*_identity(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    on = [rows["doc_id"].eqNullSafe(maps["doc_id"]), rows["text_hash"] == maps["text_hash"], rows["text_size"] == maps["text_size"]]
    both = rows.join(maps, on, "left").select(rows["doc_id"], "text", "bitmap", "n_dropped")
    kept = F.expr("""filter(split(coalesce(text, ''), '\\n', -1),
        (line, i) -> bitmap IS NULL OR (coalesce(bitmap[shiftright(i, 6)], 0L) & shiftleft(1L, i % 64)) = 0L)""")
    return both.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                       "bitmap", F.when(F.col("bitmap").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"))

"""Exact duplicate documents by a tree merge of sorted digest runs, in DataFrame functions only.

Every scan task makes a *run*: its distinct digests with the smallest identifier and a count. Runs then meet in binomial
rounds: in each round ``fan_in`` neighbouring runs merge into one, keyed by (run, digest), and the smallest identifier
is kept. A digest therefore contributes at most ``fan_in`` rows to any group of a round, however often its text occurs,
and the root holds one row per distinct text. Equality is verified at every level: groups are keyed by SHA-256, byte
length and an independent 64-bit hash together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.session import cut

#: Runs of white space that differ from one plain space; replacing these by a space equals replacing every run.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
KEY = ["digest", "size", "probe"]
SIEVE_WORDS = 1 << 17               # one megabyte


def normalise(text: Column) -> Column:
    """Null is empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, size, probe``: identity of each row's normalised text."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), normalise(F.col(f"`{text_col}`")).alias("norm")).select(
        "id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("size"), F.xxhash64("norm").alias("probe"))


def merge_runs(leaves: DataFrame, runs: int, fan_in: int = 8) -> DataFrame:
    """One row per text from ``run, digest, size, probe, first, n``; ``first`` is the least (null flag, id, row)."""
    level = leaves
    while runs > 1:
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy("run", *KEY).agg(
            F.min("first").alias("first"), F.sum("n").alias("n"))
        runs = -(-runs // fan_in)
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per input row.

    A null text is an empty one, and all empty texts form a group. Of equal texts the row with the smallest id stays; null
    ids come last, and of repeated rows with the same id exactly one stays. An empty table gives no rows. Columns beside
    id and text are not read, so their names cannot clash.
    """
    # frozen in a table: run and row numbers must not change when a lost task is run again
    rows = cut(fingerprints(docs, id_col, text_col).withColumns({"run": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    leaves = rows.groupBy("run", *KEY).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count("*").alias("n"))
    root = merge_runs(leaves, runs, fan_in)
    # down again over the runs: a text has one row per run here, so that no copy meets all others in one task
    told = leaves.select("run", *KEY).join(root, KEY)
    return rows.join(told, ["run", *KEY]).select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def sieve(keys: DataFrame, key: str) -> Column:
    """A bit set of the long column ``key`` as one scalar, ``SIEVE_WORDS`` longs whatever the number of keys."""
    at = keys.select(F.pmod(F.col(key), F.lit(64 * SIEVE_WORDS)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
    every = keys.sparkSession.range(SIEVE_WORDS).join(words, F.col("id") == F.col("word"), "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda w: w["bits"]).alias("sieve")).scalar()


def in_sieve(bits: Column, key: Column) -> Column:
    """False only for keys that are surely not in the set."""
    at = F.pmod(key, F.lit(64 * SIEVE_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    return F.get(bits, F.shiftright(at, 6).cast("int")).bitwiseAND(bit) != 0


def without(docs: DataFrame, digest: Column, members: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``members`` (``id, digest, stays``, one row per row of a group) does not let stay.

    A bit set of bounded size tells most rows that they are in no group: these stay as they are, so their texts are not shuffled. The others are
    joined. Rows equal in id and digest cannot be told apart by either; those that stay are made one row.
    """
    pairs = cut(members.groupBy("id", "digest").agg(F.max("stays").alias("stays"), F.count("*").alias("same")).where("NOT stays OR same > 1")
                .select(F.col("id").alias("_id"), F.col("digest").alias("_of"), "stays", F.xxhash64("id", "digest").alias("_key")), "listed")
    marked = docs.withColumn("_digest", digest)
    known = in_sieve(sieve(pairs, "_key"), F.xxhash64(F.col(f"`{id_col}`"), "_digest"))
    free, held = marked.where(~known).drop("_digest"), marked.where(known)
    on = [held["_digest"] == pairs["_of"], held[id_col].eqNullSafe(pairs["_id"])]
    kept = free.unionByName(held.join(pairs, on, "left_anti").drop("_digest"))
    repeated = pairs.where("stays")
    if not repeated.limit(1).count():
        return kept
    return kept.unionByName(held.join(repeated, on, "left_semi").dropDuplicates(["_digest", id_col]).drop("_digest"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; repeated rows with one id and text give one row.

    Columns named ``_digest`` would clash and are refused by name.
    """
    if "_digest" in docs.columns:
        raise ValueError("rename the column _digest")
    told = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    members = told.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
    return without(docs, F.unhex(F.sha2(normalise(F.col(f"`{text_col}`")), 256)), members, id_col)

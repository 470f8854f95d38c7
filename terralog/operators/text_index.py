"""A kept index of session logs: postings in folders by term, block maxima to skip what cannot rank, lengths by session.

``postings/bucket=..`` holds ``term, scope, block, session, seq, tf, length`` in order of term, so a query reads the folders of its terms and in them the
row groups of its terms. A block is a fixed share of a scope's sessions; ``blocks/bucket=..`` has for each term and block the number of events, the
largest count and the least length, which bound any score in it. Folders are cut by ranges, so a common term is spread over many files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terralog.operators.search import K1, MAX_SESSIONS, B, bm25, documents, lengths, postings, top_match
from terralog.operators.sessions import KEY, SEQ
from terralog.session import cut

BUCKETS, BLOCKS = 64, 64
FIRST_BLOCKS = 8                   # blocks of the highest bounds, read before the others are judged


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, folder: str, order: list[str]) -> None:
    df.repartitionByRange(folder, *order).sortWithinPartitions(folder, *order).write.partitionBy(folder).mode("append").parquet(path)


def write_index(events: DataFrame, scopes: DataFrame, path: str, buckets: int = BUCKETS, blocks: int = BLOCKS) -> "KeptIndex":
    """Index the searchable events of the sessions in ``scopes`` (session, ``scope``: one row per session) under ``path``.

    More events may be added to the folder by another call with other sessions; a session is written once.
    """
    spark = events.sparkSession
    docs = documents(events.join(scopes.select(KEY), KEY, "left_semi"))
    rows = postings(docs).join(scopes.select(KEY, F.col("scope").cast("string").alias("scope")), KEY)
    rows = rows.withColumn("block", _bucket(F.col(KEY).cast("string"), blocks)).withColumn("bucket", _bucket(F.col("term"), buckets))
    rows = cut(rows, "postings")
    _write(rows.select("term", "scope", "block", KEY, SEQ, "tf", "length", "bucket"), f"{path}/postings", "bucket", ["term", "scope", "block", KEY])
    most = rows.groupBy("bucket", "term", "scope", "block").agg(F.count(F.lit(1)).alias("events"), F.max("tf").alias("tf"), F.min("length").alias("length"))
    _write(most, f"{path}/blocks", "bucket", ["term", "scope", "block"])
    sizes = lengths(docs).join(scopes.select(KEY, F.col("scope").cast("string").alias("scope")), KEY).withColumn("part", _bucket(F.col(KEY).cast("string"), buckets))
    _write(sizes.select(KEY, SEQ, "scope", "length", "part"), f"{path}/lengths", "part", [KEY, SEQ])
    return KeptIndex(spark, path, _schema(rows), buckets)


def _schema(rows: DataFrame) -> StructType:
    names = ["term", "scope", "block", KEY, SEQ, "tf", "length", "bucket"]
    return StructType([rows.schema[n] for n in names])


@dataclass
class KeptIndex:
    spark: SparkSession
    path: str
    schema: StructType
    buckets: int = BUCKETS

    def _of(self, words: Sequence[str]) -> Column:
        """The folders and row groups of the words."""
        spark_hash = self.spark.range(1).select(*[_bucket(F.lit(w), self.buckets).alias(f"b{k}") for k, w in enumerate(words)]).first()
        return F.col("bucket").isin(sorted(set(spark_hash))) & F.col("term").isin(list(words))

    def postings(self, words: Sequence[str]) -> DataFrame:
        words = _words(words)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/postings").where(self._of(words))

    def lengths(self, session=None) -> DataFrame:
        kind, seq = self.schema[KEY].dataType.simpleString(), self.schema[SEQ].dataType.simpleString()
        rows = self.spark.read.schema(f"{KEY} {kind}, {SEQ} {seq}, scope string, length int, part int").parquet(f"{self.path}/lengths")
        if session is None:
            return rows
        part = self.spark.range(1).select(_bucket(F.lit(session).cast("string"), self.buckets)).first()[0]
        return rows.where((F.col("part") == part) & (F.col(KEY) == session))

    def bounds(self, words: Sequence[str], scope) -> tuple[list[tuple[int, float]], DataFrame]:
        """``(block, bound)`` from the highest bound on, and ``term, df, n, avg`` of the scope."""
        words, scope = _words(words), str(scope)
        blocks = self.spark.read.schema("term string, scope string, block int, events long, tf int, length int, bucket int").parquet(f"{self.path}/blocks")
        blocks = blocks.where(self._of(words) & (F.col("scope") == scope)).groupBy("term", "block").agg(F.sum("events").alias("events"), F.max("tf").alias("tf"), F.min("length").alias("length"))
        size = self.lengths().where(F.col("scope") == scope).agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).alias("g")).scalar()
        df = blocks.groupBy("term").agg(F.sum("events").alias("df")).withColumn("_g", size).select("term", "df", "_g.n", "_g.avg")
        upper = blocks.join(F.broadcast(df), "term").groupBy("block").agg(F.sum(_part(F.col("tf"), F.col("length"))).alias("bound"))
        # one row per block, of which there is a fixed number
        return [tuple(r) for r in upper.orderBy(F.desc("bound"), "block").collect()], df

    def session_search(self, words: Sequence[str], scope, n: int = MAX_SESSIONS, first: int = FIRST_BLOCKS) -> DataFrame:
        """As ``search.session_search`` over the scope: strongest event per session, then the top ``n`` sessions.

        The blocks of the highest bounds are scored first; of the others only those are read whose bound reaches the n-th score found.
        """
        words = _words(words)
        order, df = self.bounds(words, scope)

        def scored(blocks: list[int]) -> DataFrame:
            hits = self.postings(words).where((F.col("scope") == str(scope)) & F.col("block").isin(blocks))
            # one row per query term
            return hits.join(F.broadcast(df), "term").groupBy(KEY, SEQ).agg(F.sum(_part(F.col("tf"), F.col("length"))).alias("score"))
        head = [b for b, _ in order[:first]]
        if len(order) > first:
            known = top_match(scored(head), n).agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("least")).first()
            # sums of doubles may differ in the last place
            head += [b for b, bound in order[first:] if known["k"] < n or bound * (1 + 1e-9) >= known["least"]]
        return top_match(scored(head), n)

    def event_search(self, words: Sequence[str], session, n: int, skip: Column | None = None) -> DataFrame:
        """As ``search.event_search``: ranked events of one session, of which ``skip`` takes some out; counts are those of the events left."""
        hits, sizes = self.postings(words).where(F.col(KEY) == session), self.lengths(session)
        if skip is not None:
            hits, sizes = hits.where(~skip), sizes.where(~skip)
        return bm25(hits, sizes, words).orderBy(F.desc("score"), SEQ).limit(n)


def _words(words: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in words))


def _part(tf: Column, length: Column) -> Column:
    """A term's share of a score; it grows with ``tf`` and falls with ``length``."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg")))

"""The registered queries of the dealt operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.llm import language_id, toxicity
from terralog.llm.exact_dedup import exact_dedup
from terralog.llm.html_extract import extract_pages
from terralog.llm.license_scan import licenses
from terralog.llm.line_dedup import line_dedup
from terralog.llm.packing import pack
from terralog.llm.periodic_runs import periodic_runs, run_digests
from terralog.llm.sentencepiece_codec import decode_documents, encode_documents
from terralog.llm.simhash import simhash_groups
from terralog.llm.token_alignment import align_documents, score_links
from terralog.llm.token_store import crc, read_store, write_store
from terralog.llm.tokens import tokenizer_path
from terralog.llm.topk import exact_topk, integer_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    path = tokenizer_path("piece_bpe_32k.model")
    both = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_pieces", crc(F.col("ids")).alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op2_exact_topk", r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""")
def op2_exact_topk(spark, sf_dir):
    return exact_topk(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, k=10)


@query("op3_token_store")
def op3_token_store(spark, sf_dir):
    manifest = write_store(table(spark, sf_dir, "documents"), tokenizer_path())
    return read_store(manifest).select("doc_id", "start", "n_tokens", crc(F.col("ids")).alias("ids_crc32"))


@query("op4_packing")
def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumn("ids_crc32", crc(F.col("ids"))).drop("ids")


@query("op5_html_extract")
def op5_html_extract(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))


@query("op10_line_dedup", r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM s),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""")
def op10_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned, counts = align_documents(table(spark, sf_dir, "documents"), *paths)
    return score_links(aligned, counts, *paths)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), rewritten=True))

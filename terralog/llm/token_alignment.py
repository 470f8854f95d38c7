"""Alignment of two tokenisations of whole documents: a byte-level BPE (A) and a SentencePiece file (B).

Byte offsets where tokens of both end cut a document into groups; a link is the A and the B token that end at such an offset. Neither tokenizer
merges across a space or line feed between two other characters, so texts are split there, each distinct unit goes through the libraries
once per worker, and long documents are encoded stretch by stretch. The merge itself runs over documents, by ``lockstep``.

Link counts are corpus-wide. Each task adds up its own pairs and Spark sums them. Most links hold one of few common pairs: those
(``HEAD_ROWS`` at most, chosen by a histogram of counts) are looked up in a broadcast table of that bounded size, all others are joined by a shuffle.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.lockstep import Decimals, groups_text, lanes, lockstep
from terralog.llm.worker_memory import small_batches, tidy
from terralog.session import cut, scratch_path

MARK = "▁"                                   # fixed value: the sign that stands for a space in B
UNIT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")
BORDER = re.compile(r"(?<=\S)[ \n](?=\S)")
STRETCH = 1 << 20                            # characters of one text, or of several, that are aligned together
MEMO_TOKENS = 1 << 20                        # bounds of the memo, in tokens and in units
MEMO_UNITS = 1 << 18
LEARN_UNITS = 1 << 13                        # units that go through the libraries together
ROW_GROUP = 16 << 20                         # bytes a task's writer holds
COUNT_LINKS = 1 << 21                        # links a task adds up before it passes counts on
COUNT_ROW = 1 << 15                          # pairs in one row of counts
HEAD_ROWS = 1 << 19

ALIGNED = "row long, doc_id long, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary, pairs array<long>, times array<long>"
SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, rare array<long>"


def _byte_of() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``start, size`` of ``flat`` one after another."""
    return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


class TokenPair:
    """Both tokenizers and a memo of units."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_of()
        self.a_vocab, self.b_vocab = self.a.get_vocab_size(), self.b.vocab_size()
        raw_a = [self.a.id_to_token(i) or "" for i in range(self.a_vocab)]
        self.raw_a = [bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in raw_a]
        names = [self.b.id_to_piece(i) for i in range(self.b_vocab)]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        if any(MARK in p.lstrip(MARK) or "\n" in p[1:] or "\n" in p[:-1] for p in names):
            raise ValueError("pieces across a space or line feed are not supported")
        self.a_len, self.b_len = (np.fromiter(map(len, raw), np.int64, len(raw)) for raw in (self.raw_a, self.raw_b))
        self.kinds = ["<u2" if v <= 1 << 16 else "<u4" for v in (self.a_vocab, self.b_vocab)]
        self.decimals = Decimals(max(self.a_vocab, self.b_vocab))
        self._clear()

    def _clear(self):
        self.slot: dict[str, int] = {}
        self.flat = [np.zeros(0, dtype=np.int32) for _ in "ab"]
        self.count = [np.zeros(0, dtype=np.int64) for _ in "ab"]
        self.bytes, self.good = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def _learn(self, units: list[str]) -> None:
        """Encode units that are not known yet. A space before a word is B's own, a line feed has its piece of a space taken off."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        b = [ids if u[0] == " " else ids[1:] for u, ids in zip(units, b)]
        raw = [u.encode() for u in units]
        good = [r == b"".join(map(self.raw_a.__getitem__, x)) == b"".join(map(self.raw_b.__getitem__, y)) for r, x, y in zip(raw, a, b)]
        self.slot.update(zip(units, range(len(self.slot), len(self.slot) + len(units))))
        for k, ids in enumerate((a, b)):
            self.flat[k] = np.concatenate([self.flat[k], np.fromiter((i for x in ids for i in x), np.int32)])
            self.count[k] = np.concatenate([self.count[k], np.fromiter(map(len, ids), np.int64, len(ids))])
        self.bytes = np.concatenate([self.bytes, np.fromiter(map(len, raw), np.int64, len(raw))])
        self.good = np.concatenate([self.good, np.asarray(good, dtype=bool)])

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """A ids, B ids, and the numbers of A and B tokens of each group, of stretches that begin with a space or line feed; None where the joined bytes differ."""
        units = [UNIT.findall(t) for t in texts]
        if max(map(len, self.flat)) > MEMO_TOKENS or len(self.slot) > MEMO_UNITS:
            self._clear()
        fresh = list({u for us in units for u in us} - self.slot.keys())
        for k in range(0, len(fresh), LEARN_UNITS):
            self._learn(fresh[k:k + LEARN_UNITS])
        slots = [np.fromiter(map(self.slot.__getitem__, us), np.int64, len(us)) for us in units]
        good = [bool(self.good[s].all()) for s in slots]
        kept = [s for s, g in zip(slots, good) if g]
        if not kept:
            return [None] * len(texts)
        every = np.concatenate(kept)
        owner = np.cumsum([0, *map(len, kept)])[:-1]
        (ids_a, n_a), (ids_b, n_b) = ((_ragged(f, (np.cumsum(c) - c)[every], c[every]), np.add.reduceat(c[every], owner)) for f, c in zip(self.flat, self.count))
        sizes = np.add.reduceat(self.bytes[every], owner)
        partner = lockstep(np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b]), lanes(sizes))
        a_last = np.flatnonzero(partner >= 0)
        b_last = partner[a_last]
        # a stretch ends where tokens of both end, so groups lie in one stretch
        a_size, b_size = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        ends_g = np.searchsorted(a_last, ends_a)
        out = iter([(ids_a[a0:a1], ids_b[b0:b1], a_size[g0:g1], b_size[g0:g1])
                    for a0, a1, b0, b1, g0, g1 in zip(ends_a - n_a, ends_a, ends_b - n_b, ends_b, np.append(0, ends_g[:-1]), ends_g)])
        return [next(out) if g else None for g in good]


def stretches(text: str) -> list[str]:
    """A space and the text, cut at a space or line feed between other characters about every ``STRETCH`` characters."""
    text, out, at = " " + text, [], 0
    while len(text) - at > STRETCH and (border := BORDER.search(text, at + STRETCH)):
        out.append(text[at:border.start()])
        at = border.start()
    return [*out, text[at:]]


def aligned_texts(pair: TokenPair, texts: list[str | None]):
    """What ``TokenPair.align`` gives for each whole text, in order; None for null, empty and differing texts."""
    parts, waiting, chars = [], [], 0           # parts: results of the stretches of the current text

    def done():
        for (_, last), found in zip(waiting, pair.align([s for s, _ in waiting])):
            parts.append(found)
            if last:
                yield None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))
                parts.clear()

    for text in texts:
        for k, s in enumerate(cuts := stretches(text) if text else [""]):
            # an empty text has no bytes to compare; a unit that no tokenizer can join stands for it
            waiting.append((s or MARK, k + 1 == len(cuts)))
            chars += len(s)
            if chars >= STRETCH:
                yield from done()
                waiting, chars = [], 0
    yield from done()


@lru_cache(maxsize=2)
def token_pair(a_path: str, b_path: str) -> TokenPair:
    return TokenPair(a_path, b_path)


def last_pairs(a_ids, b_ids, a_sizes, b_sizes, b_vocab: int) -> np.ndarray:
    """A link for each group: its last A id and last B id as one number."""
    return a_ids[np.cumsum(a_sizes) - 1].astype(np.int64) * b_vocab + b_ids[np.cumsum(b_sizes) - 1]


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    named = [f.split() for f in fields.split(", ")]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), named)], names=[n for n, _ in named])


def _aligner(a_path: str, b_path: str):
    def run(batches):
        pair, part, row = token_pair(a_path, b_path), TaskContext.get().partitionId(), 0
        links, held = [], 0

        def counts():
            pairs, times = np.unique(np.concatenate(links), return_counts=True)
            for k in range(0, len(pairs), COUNT_ROW):
                yield _batch([(None, None, None, None, None, None, pairs[k:k + COUNT_ROW], times[k:k + COUNT_ROW])], ALIGNED)

        for b in batches:
            out, size = [], 0
            for doc, found in zip(b.column(0).to_pylist(), aligned_texts(pair, (x.as_py() for x in b.column(1)))):
                if found is None:
                    held_row = (b"",) * 4
                else:
                    links.append(last_pairs(*found, pair.b_vocab))
                    held += len(links[-1])
                    held_row = (*(x.astype(k).tobytes() for x, k in zip(found[:2], pair.kinds)), *(x.astype("<u4").tobytes() for x in found[2:]))
                out.append(((part << 33) + row, doc, *held_row, None, None))
                row, size = row + 1, size + sum(map(len, held_row))
                if size >= 8 << 20:
                    yield _batch(out, ALIGNED)
                    out, size = [], 0
                if held >= COUNT_LINKS:
                    yield from counts()
                    links, held = [], 0
            if out:
                yield _batch(out, ALIGNED)
        if held:
            yield from counts()
    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The alignment of every row as a written table, and corpus-wide ``pair, n``: how many links hold the pair ``a_id * size of B + b_id``.

    The table has ``row`` (unique), ``doc_id``, ``a_ids`` and ``b_ids`` (little-endian, two bytes an id if the vocabulary allows, else four) and
    ``a_sizes`` and ``b_sizes`` (four bytes): tokens of each in every group. Texts that are null or empty, and those whose joined bytes differ from a
    space and the text, have empty lists. Ids may be null or repeated; each row is a document of its own. Other columns are not read. Long texts
    are encoded in stretches; only a text without any space or line feed goes through the libraries whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path = scratch_path(spark, "alignment")
    with small_batches(spark):
        rows.mapInArrow(tidy(_aligner(a_path, b_path)), ALIGNED).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    table = spark.read.schema(ALIGNED).parquet(path)
    each = table.where("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    return table.where("row IS NOT NULL").drop("pairs", "times"), cut(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def _scorer(a_path: str, b_path: str, head):
    def run(batches):
        pair = token_pair(a_path, b_path)
        known, n, best = head.value
        for b in batches:
            out, size = [], 0
            for row in b.to_pylist():
                a, bb = (np.frombuffer(row[c], k) for c, k in zip(("a_ids", "b_ids"), pair.kinds))
                sa, sb = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("a_sizes", "b_sizes"))
                links = last_pairs(a, bb, sa, sb, pair.b_vocab) if len(sa) else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
                hit = known[at] == links if len(known) else np.zeros(len(links), dtype=bool)
                text = groups_text(a, bb, sa, sb, pair.decimals)
                rare = links[~hit]
                out.append((row["row"], row["doc_id"], len(a), len(bb), len(sa), int(best[at[hit]].sum()), int(n[at[hit]].sum()), sha256(text).hexdigest() if text else "", rare if len(rare) else None))
                size += len(rare)
                if size >= 1 << 18:
                    yield _batch(out, SCORED)
                    out, size = [], 0
            if out:
                yield _batch(out, SCORED)
    return run


def score_links(aligned: DataFrame, counts: DataFrame, a_path: str, b_path: str, head_rows: int = HEAD_ROWS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every aligned row.

    ``n_best`` links hold a pair that occurs as often as any pair of its B id (ties included); ``count_sum`` adds the pairs' counts. Rows without tokens
    have zeros and an empty text as digest.
    """
    spark, b_vocab = aligned.sparkSession, token_pair(a_path, b_path).b_vocab
    counts = counts.withColumn("b", F.col("pair") % b_vocab)
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    counts = cut(counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    # rows by power of two of the count, 64 at most
    sizes = {r["p"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("k")).collect()}
    least, room = 63, head_rows
    for p in sorted(sizes, reverse=True):
        room -= sizes[p]
        if room < 0:
            break
        least = p
    head = counts.where(F.floor(F.log2("n")) >= least).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("pair", "n", "best")))
    with small_batches(spark):
        scored = cut(aligned.mapInArrow(tidy(_scorer(a_path, b_path, held)), SCORED), "scored")
    rare = scored.where("rare IS NOT NULL").select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    more = rare.join(counts.where(F.floor(F.log2("n")) < least), "pair").groupBy("row").agg(
        F.sum("times").alias("_times"), F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    zero = F.lit(0).cast("long")
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"), "groups_sha256")

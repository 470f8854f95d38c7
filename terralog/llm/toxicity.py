"""Toxicity by weak supervision: voters, a generative label model over them, a linear classifier on its posterior labels.

The lexicon is mined with Spark from all labelled rows outside the held-out fold: words, and word beginnings, that toxic rows hold far more often than others.
Each entry is a voter, and so are patterns of writing (shouting, exclamation marks, symbols, no entry at all). The label model estimates the
accuracy of every voter and their correlations, the given label being one voter among them; a logistic regression learns its posteriors. Scoring is one
pass over the texts with one automaton. Only the label model and the regression use a bounded sample: ``fit_rows`` labelled texts, the least by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.exact_dedup import in_sieve, sieve
from terralog.llm.label_model import label_model, logistic, sigmoid
from terralog.llm.worker_memory import tidy
from terralog.session import cut

UPPER = bytes(range(65, 91))
SIGNS = b"!#$%&*@^~"
STEMS = (4, 5, 6)                  # lengths of word beginnings


@dataclass(frozen=True)
class ToxicityModel:
    """``terms`` (a beginning ends in ``*``), their weights, then those of the patterns and the constant; ``base`` is the score without a model."""
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    base: float
    accuracies: tuple[tuple[str, float, float], ...] = ()


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from; a row without an id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=2)
def automaton(terms: tuple[str, ...]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        stem = term.rstrip("*")
        _, entry = a.get(stem, (stem, []))
        a.add_word(stem, (stem, [*entry, (i, term.endswith("*"))]))
    if terms:
        a.make_automaton()
    return a


def hits(text: str, terms: tuple[str, ...]) -> set[int]:
    """Numbers of the terms in the lower-case text: whole words, or beginnings of longer ones."""
    found: set[int] = set()
    if not terms:
        return found
    n = len(text)
    for end, (stem, entries) in automaton(terms).iter(text):
        start = end - len(stem)
        if start >= 0 and text[start].isalnum():
            continue
        closed = end + 1 == n or not text[end + 1].isalnum()
        found.update(i for i, begins in entries if begins or closed)
    return found


PATTERNS = ("shouting", "exclaiming", "symbols", "no entry")


def patterns(raw: bytes, any_hit: bool) -> tuple[bool, bool, bool, bool]:
    n = max(len(raw), 1)
    return (2 * (len(raw) - len(raw.translate(None, UPPER))) > n, raw.count(b"!") * 50 > n, 20 * (len(raw) - len(raw.translate(None, SIGNS))) > n, not any_hit)


def features(raw: bytes | None, terms: tuple[str, ...]) -> tuple[set[int], tuple[bool, ...]]:
    """Null is an empty text."""
    raw = raw or b""
    found = hits(raw.decode("utf-8", "replace").lower(), terms)
    return found, patterns(raw, bool(found))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, toxic, rank`` of every labelled text outside the held-out fold; ``rank`` is the least hash of the ids of its rows.

    A text counts once, however many copies it has, and is toxic if any of them is: digests and labels meet first, and only one row of each text sends it. A bit set of bounded
    size tells most rows beforehand that theirs is not asked for.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    first = rows.select("id", "digest").join(known, "id").groupBy("digest").agg(F.min(F.struct(F.xxhash64("id").alias("rank"), "id")).alias("f"), F.max("toxic").alias("toxic"))
    first = cut(first.select("digest", "toxic", F.col("f.rank").alias("rank"), F.col("f.id").alias("id"), F.xxhash64("f.id", "digest").alias("key")), "texts")
    held = rows.where(in_sieve(sieve(first, "key"), F.xxhash64("id", "digest")))
    # rows of one id and text are the same
    return held.join(first, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("text", "toxic", "rank")


def mine(rows: DataFrame, bad: int, good: int, most: int, least: int = 3, z: float = 3.0, purity: float = 0.5) -> list[str]:
    """Terms that occur in toxic rows for the larger part, by the z-score of their log-odds between the classes, at most ``most``; counted over all ``bad`` and ``good`` rows."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) > 1))
    stems = [F.transform(F.filter("words", lambda w, k=k: F.char_length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    terms = rows.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good - F.col("good") + 0.5))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = counts.where(F.col("bad") >= least).withColumn("z", odds / spread).where(F.col("z") >= z).where(F.col("bad") >= purity * (F.col("bad") + F.col("good"))).orderBy(F.desc("z"), "term").limit(most)
    return [r["term"] for r in top.select("term").collect()]


def _bits(terms: tuple[str, ...]):
    def run(batches):
        for b in batches:
            packed = []
            for raw in b.column(0):
                found, pattern = features(raw.as_py(), terms)
                row = np.zeros(len(terms) + len(PATTERNS), dtype=np.uint8)
                row[sorted(found)] = 1
                row[len(terms):] = pattern
                packed.append(np.packbits(row).tobytes())
            yield pa.record_batch([pa.array(packed, pa.binary()), b.column(1).cast(pa.int32())], names=["votes", "toxic"])
    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, most_terms: int = 384, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from ``docs`` and ``labels`` (``doc_id, toxic``). Without rows of both classes it scores every text by their share."""
    every = cut(labelled_rows(docs, labels, id_col, text_col), "labelled")
    n, bad = every.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        return ToxicityModel((), (), bad / n if n else 0.0)
    terms = tuple(mine(every, bad, n - bad, most_terms))
    last = every.select("rank").orderBy("rank").limit(fit_rows).agg(F.max("rank").alias("last")).scalar()
    rows = cut(every.where(F.col("rank") <= last).select("text", "toxic"), "sample")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        # a sample without toxic rows teaches nothing: the rarer class has too few
        return ToxicityModel((), (), bad / n)
    # bits of a bounded sample: fit_rows x (most_terms + patterns)
    votes = rows.select(F.col("text").cast("binary").alias("text"), "toxic").mapInArrow(_bits(terms), "votes binary, toxic int").collect()
    width = len(terms) + len(PATTERNS)
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["votes"]) for r in votes), np.uint8).reshape(len(votes), -1), axis=1)[:, :width].astype(np.float32)
    # a voter says toxic or abstains; "no entry" repeats the others' silence and is left to the classifier
    posterior, hit, _ = label_model(x[:, :-1], bad / n, np.asarray([r["toxic"] for r in votes]))
    w = logistic(x.astype(float), posterior)
    names = (*terms, *PATTERNS[:-1])
    return ToxicityModel(terms, tuple(map(float, w)), bad / n, tuple((a, float(b), float(c)) for a, b, c in zip(names, hit[1], hit[0])))


def score_text(raw: bytes | None, model: ToxicityModel) -> float:
    if not model.weights:
        return model.base
    found, pattern = features(raw, model.terms)
    w, t = model.weights, len(model.terms)
    return float(sigmoid(np.float64(w[-1] + sum(w[i] for i in sorted(found)) + sum(w[t + i] for i, p in enumerate(pattern) if p))))


def _scores(model: ToxicityModel):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([score_text(x.as_py(), model) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: null text as empty, null and repeated ids as they are; an empty table gives no rows."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double")


def _clean(model: ToxicityModel, at: int, threshold: float):
    def run(batches):
        for b in batches:
            texts = b.column(at)
            yield b.filter(pa.array([score_text(x.encode() if (x := t.as_py()) else None, model) < threshold for t in texts], pa.bool_()))
    return run


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns as they are: nulls, repeated rows and other columns too.

    A null or empty text is scored as an empty one. An empty table gives no rows.
    """
    return docs.mapInArrow(tidy(_clean(model, docs.columns.index(text_col), threshold)), docs.schema)

"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with one space for everything between them; n-grams of one to four characters that do not begin and end outside letters
are hashed into buckets. The fit counts them in Spark over ``fit_texts`` distinct texts a language, those with the least hash; the matrix of
log-probabilities (buckets x languages) is broadcast, and a batch of texts is scored as a sparse product: the rows of the matrix at its n-grams, summed by text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.toxicity import held_out
from terralog.session import cut

UNKNOWN = "und"                     # fixed value: no letters
SIZES = (1, 2, 3, 4)                # characters of the n-grams
BUCKET_BITS = 16
CELLS = 1 << 24                     # bound of buckets x languages
CHARS = 1 << 18                     # characters scored at once
SPACE = 32


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` in order and ``weights``, float32 of buckets x languages; without languages every text is ``und``."""
    languages: tuple[str, ...]
    weights: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space if it is none. Marks that combine stay out, as spaces do."""
    table = np.full(0x110000, SPACE, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(text: str) -> np.ndarray:
    """Lower-case letters, with one space before, between and after words; a single space if there are none."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    codes = np.concatenate([[SPACE], codes, [SPACE]]).astype(np.uint64)
    return codes[np.append(True, (codes[1:] != SPACE) | (codes[:-1] != SPACE))]


def grams(codes: np.ndarray, owner: np.ndarray, fresh: np.ndarray, bits: int = BUCKET_BITS):
    """``bucket, owner`` of the n-grams that lie in one text and end in a ``fresh`` character; a space by itself is no n-gram."""
    h = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            if len(codes) < n:
                return
            h = h[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            if n in SIZES:
                inside = (owner[:len(h)] == owner[n - 1:]) & fresh[n - 1:]
                if n == 1:
                    inside &= codes != SPACE
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed[inside] >> np.uint64(64 - bits)).astype(np.int64), owner[:len(h)][inside]


def blocks(texts, chars: int = CHARS):
    """``codes, owner, fresh`` of the texts in blocks of about ``chars`` characters. A long text goes on in the next block, after a repetition of its last characters that are not fresh."""
    held, size, lead = [], 0, max(SIZES) - 1
    for k, text in enumerate(texts):
        codes = folded(text or "")
        for at in range(0, len(codes), chars):
            lo = max(0, at - lead)
            part = codes[lo:at + chars]
            held.append((part, np.full(len(part), k, dtype=np.int64), np.arange(lo, lo + len(part)) >= at))
            size += len(part)
            if size >= chars:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text (-1 without letters) and its posterior under equal priors; ties go to the first language."""
    n, k, bits = len(texts), len(model.languages), len(model.weights).bit_length() - 1
    total, seen = np.zeros((n, max(k, 1))), np.zeros(n, dtype=np.int64)
    for block in blocks(texts):
        for bucket, of in grams(*block, bits):
            seen += np.bincount(of, minlength=n)
            for j in range(k):
                total[:, j] += np.bincount(of, model.weights[bucket, j], minlength=n)
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    none = (seen == 0) | (k == 0)
    return np.where(none, -1, best), np.where(none, 0.0, 1.0 / odds.sum(axis=1))


def _counter(languages: tuple[str, ...], bits: int):
    def run(batches):
        count = np.zeros((len(languages), 1 << bits), dtype=np.int64)
        at = {x: k for k, x in enumerate(languages)}
        for b in batches:
            lang = np.asarray([at[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            for block in blocks(x.as_py() for x in b.column(1)):
                for bucket, of in grams(*block, bits):
                    np.add.at(count, (lang[of], bucket), 1)
        rows, cols = np.nonzero(count)
        for k in range(0, len(rows), 1 << 16):
            r, c = rows[k:k + (1 << 16)], cols[k:k + (1 << 16)]
            yield pa.record_batch([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(count[r, c])], names=["lang", "bucket", "n"])
    return run


def training_texts(docs: DataFrame, fit_texts: int, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """The languages, and ``lang, text``: of each language at most ``fit_texts`` distinct texts, the least by hash, of rows outside the held-out fold."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out(F.col(f"`{id_col}`")).alias("out"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND NOT out").select("lang", "text", F.xxhash64("text").alias("hash"))
    keys = cut(rows.groupBy("lang", "hash").agg(F.count("*").alias("n")).select("lang", "hash"), "keys")
    # one row per language
    languages = sorted(r["lang"] for r in keys.select("lang").distinct().collect())
    if len(languages) << bits > CELLS:
        raise ValueError(f"{len(languages)} languages with {1 << bits} buckets each exceed {CELLS} cells")
    if not languages:
        return [], rows.select("lang", "text")
    # fit_texts rows of a long each, per language
    chosen = None
    for lang in languages:
        part = keys.where(F.col("lang") == lang).orderBy("hash").limit(fit_texts)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    return languages, picked.select("lang", "text")


def fit(docs: DataFrame, fit_texts: int = 4096, smoothing: float = 0.5, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the rows with a language; rows of the held-out fold are never learnt from. Without any it knows no language.

    Equal texts of a language count once, so a text with many copies does not shift its language. Texts are whole.
    """
    languages, rows = training_texts(docs, fit_texts, bits, id_col, text_col, lang_col)
    if not languages:
        return LanguageModel((), np.zeros((1 << bits, 0), dtype=np.float32))
    found = rows.mapInArrow(_counter(tuple(languages), bits), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((1 << bits, len(languages)))
    count[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    count += smoothing
    return LanguageModel(tuple(languages), (np.log(count) - np.log(count.sum(axis=0))).astype(np.float32))


def _predictor(model):
    def run(batches):
        m = model.value
        for b in batches:
            best, score = score_texts(b.column(1).to_pylist(), m)
            yield pa.record_batch([b.column(0), pa.array([m.languages[k] if k >= 0 else UNKNOWN for k in best.tolist()], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, in one pass without a shuffle.

    Null, empty and letterless texts are ``und`` with score 0, and so is every text if the model knows no language. Ids may be null or repeated; an empty table gives no
    rows; other columns are not read. Texts are scored whole, in blocks of bounded size, however long. The matrix is broadcast: at most ``CELLS`` floats.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_predictor(held), "doc_id long, lang_pred string, score double")

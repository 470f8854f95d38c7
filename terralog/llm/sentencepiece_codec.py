"""SentencePiece encoding and decoding of whole documents with a model file.

A text is split where no piece of the vocabulary can reach across: before a run of word marks, and around characters that are in no longer piece. The
distinct words of a batch that are not known yet go through one batched Viterbi, grouped by length; the ids of a word are kept as
bytes, so a text is one join. ``algorithm="viterbi"`` gives the best-scoring segmentation, which is what a unigram model means. A model that was
built by merges segments by its merge order instead; ``algorithm="model"`` asks the library for that.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terralog.llm.viterbi import PieceTable

MARK = "▁"                    # fixed value: the sign that stands for a space
KEPT, LONGEST = 500_000, 64        # bound of the memo: words, and characters a word
ROWS = 256                         # texts whose new words advance together


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = m = SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        normal = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        pieces = [m.id_to_piece(i) for i in normal]
        self.table = PieceTable(pieces, normal, [m.get_score(i) for i in normal])
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.raw = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        joined = "".join(map(re.escape, sorted({c for p in pieces if len(p) > 1 for c in p} - {MARK})))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces with a mark inside are not supported")
        self.word = re.compile(f"{MARK}*[{joined}]+|{MARK}+|[^{joined}{MARK}]")
        self.memo: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def _ids(self, word: str, pieces: list[tuple[int, int]]) -> bytes:
        ids, at = [], 0
        for piece, length in pieces:
            ids += [piece] if piece >= 0 else [self.bytes.get(b, self.model.unk_id()) for b in word[at:at + length].encode()]
            at += length
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit little-endian integers; null is empty."""
        split = [self.words(t or "") for t in texts]
        new = list({w for ws in split for w in ws} - self.memo.keys())
        fresh = {w: self._ids(w, p) for w, p in zip(new, self.table.segment(new))}
        both = (fresh.get if len(self.memo) == 0 else lambda w: self.memo.get(w) or fresh[w])
        out = [b"".join(map(both, ws)) for ws in split]
        if len(self.memo) + len(fresh) > KEPT:
            self.memo.clear()
        self.memo.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
        return out

    def encode_by_model(self, texts: list[str | None]) -> list[bytes]:
        return [np.asarray(self.model.encode(t or ""), dtype="<u4").tobytes() for t in texts]

    def decode(self, ids: bytes | None) -> str:
        """Text of the ids; the space before the first word is dropped. Bytes that form no character become the replacement sign."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str, algorithm: str):
    def run(batches):
        c = codec(path)
        encode = {"viterbi": c.encode, "model": c.encode_by_model}[algorithm]
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                ids = encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "text", "n_pieces", "ids"])
    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", algorithm: str = "viterbi") -> DataFrame:
    """``doc_id, text, n_pieces, ids``, one row per input row. Null and empty texts have no pieces; ids may be null or repeated."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(path, algorithm), "doc_id long, text string, n_pieces long, ids binary")


def _decoder(path: str, at: int):
    def run(batches):
        decode = codec(path).decode
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.slice(k, ROWS)
                yield part.append_column("decoded", pa.array([decode(x.as_py()) for x in part.column(at)], pa.string()))
    return run


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``; null ids give the empty text. The input must not have a column of that name."""
    return encoded.mapInArrow(_decoder(path, encoded.columns.index(ids_col)), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))

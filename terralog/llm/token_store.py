"""Token ids of documents in shard files, in ascending document order, each with a minimal perfect hash index.

A shard file (little-endian): header, raw ids, document table (id, null flag, first token of each), index. The index gives a
document id its slot; a slot holds a fingerprint of the id, the first row with that id and how many rows share it. A key is
answered by one probe, one fingerprint comparison and one read of the payload. Files lie in the shared folder; names hold the
attempt, and only those that the manifest table lists count, so a task that is run again leaves no doubt.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog.llm import perfect_hash as mph
from terralog.llm.tokens import memo, wide
from terralog.session import cut, scratch_path

MAGIC, VERSION = b"TLTS", 1
HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("width", "<u4"), ("levels", "<u4"), ("docs", "<u8"), ("tokens", "<u8"), ("keys", "<u8"), ("words", "<u8")])
SLOT = np.dtype([("print", "<u4"), ("count", "<u4"), ("row", "<u8")])
PRINT_SEED = 1 << 20
MANIFEST = "part int, seq int, path string, first_id long, last_id long, docs long, tokens long"
BATCH_BYTES = 8 << 20


def open_fs(uri: str):
    """Filesystem and path of a shared location."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def shard_bytes(ids: list[int | None], payload: bytes, firsts: np.ndarray, width: int) -> bytes:
    """One file; ``ids`` ascend with nulls last, ``firsts`` has one token position more than documents."""
    null = np.asarray([i is None for i in ids], dtype=np.uint8)
    doc = np.asarray([0 if i is None else i for i in ids], dtype="<i8")
    known = doc[null == 0]
    keys, row, count = np.unique(known, return_index=True, return_counts=True)
    hashed = keys.astype(np.int64).view(np.uint64)
    sizes, words = mph.build(hashed)
    slots = np.zeros(len(keys), dtype=SLOT)
    at = mph.probe(hashed, sizes, words, mph.ranks(words))
    slots["print"][at] = mph.mix(hashed, PRINT_SEED) >> np.uint64(32)
    slots["count"][at], slots["row"][at] = count, row
    head = np.zeros(1, dtype=HEAD)
    head[0] = (MAGIC, VERSION, width, len(sizes), len(doc), len(payload) // width, len(keys), len(words))
    return b"".join([head.tobytes(), payload, doc.tobytes(), null.tobytes(), np.asarray(firsts, dtype="<u8").tobytes(), sizes.tobytes(), words.tobytes(), slots.tobytes()])


class Shard:
    """A shard file opened for reading: tables in memory, payload read as asked."""

    def __init__(self, file):
        self.file = file
        h = np.frombuffer(file.read(HEAD.itemsize), dtype=HEAD)[0]
        if h["magic"] != MAGIC or h["version"] != VERSION:
            raise ValueError("not a token shard of this version")
        self.docs, self.tokens, self.width = int(h["docs"]), int(h["tokens"]), int(h["width"])
        file.seek(HEAD.itemsize + self.tokens * self.width)
        rest = io.BytesIO(file.read())
        take = lambda kind, n: np.frombuffer(rest.read(np.dtype(kind).itemsize * int(n)), dtype=kind)
        self.ids, self.null, self.firsts = take("<i8", self.docs), take(np.uint8, self.docs), take("<u8", self.docs + 1).astype(np.int64)
        self.sizes, self.words, self.slots = take("<u8", h["levels"]), take("<u8", h["words"]), take(SLOT, h["keys"])
        self.before = mph.ranks(self.words)

    def payload(self, first: int, last: int) -> bytes:
        """Ids of the rows first..last-1, as unsigned 32-bit integers."""
        a, b = int(self.firsts[first]), int(self.firsts[last])
        self.file.seek(HEAD.itemsize + a * self.width)
        return wide(self.file.read((b - a) * self.width), f"<u{self.width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; none where the fingerprint or the stored id differs."""
        hashed = np.asarray(keys, dtype=np.int64).view(np.uint64)
        at = mph.probe(hashed, self.sizes, self.words, self.before)
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.slots[np.maximum(at, 0)]
        row = slot["row"].astype(np.int64)
        right = (at >= 0) & (slot["print"] == mph.mix(hashed, PRINT_SEED) >> np.uint64(32)) & (self.ids[row] == keys)
        return row, np.where(right, slot["count"], 0).astype(np.int64)


def _writer(root: str, tokenizer: str, shard_mb: int):
    def run(batches):
        part, seq, words = TaskContext.get().partitionId(), 0, memo(tokenizer)
        width = np.dtype(words.kind).itemsize
        fs, base = open_fs(root)
        ids, texts, size = [], [], 0

        def flush():
            nonlocal ids, texts, size, seq
            firsts = np.concatenate([[0], np.cumsum([len(x) // width for x in texts])])
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(shard_bytes(ids, b"".join(texts), firsts, width))
            known = [i for i in ids if i is not None]
            row = {"part": [part], "seq": [seq], "path": [f"{root}/{name}"], "first_id": [min(known, default=None)], "last_id": [max(known, default=None)], "docs": [len(ids)], "tokens": [int(firsts[-1])]}
            ids, texts, size, seq = [], [], 0, seq + 1
            return pa.record_batch([pa.array(row[k], t) for k, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4))], names=list(row))

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                data = words.encode(raw.as_py())
                ids.append(i)
                texts.append(data)
                size += len(data)
                if size >= shard_mb << 20:
                    yield flush()
        if ids:
            yield flush()
    return run


def write_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_mb: int = 32, parts: int | None = None) -> DataFrame:
    """Write the shard files; returns the manifest table ``part, seq, path, first_id, last_id, docs, tokens, start``.

    Null text is an empty document (its end id only), null ids come last, rows that share an id follow each other. An empty table writes no file.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "tokens")
    fs, base = open_fs(root)
    fs.create_dir(base, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row number after the id: an id that a third of the rows share is still cut into ranges
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("row").asc()]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    shards = cut(ranged.mapInArrow(_writer(root, tokenizer, shard_mb), MANIFEST), "manifest")
    # starts in two levels: over partitions, then over the shards of each
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before.orderBy("part")), F.lit(0)))
    inner = F.coalesce(F.sum("tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return cut(shards.withColumn("inner", inner).join(sums.select("part", "base"), "part").select(*shards.columns, (F.col("base") + F.col("inner")).alias("start")), "manifest")


ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])


def _places(shard: Shard) -> np.ndarray:
    """Rows of a shard in order of place, each found by its key through the index; rows without a key follow from the document table."""
    keys = np.unique(shard.ids[shard.null == 0])
    first, count = shard.find(keys)
    if not count.all():
        raise ValueError("the index does not know a document of its shard")
    known = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.sort(np.concatenate([known, np.flatnonzero(shard.null)]))


def _reader(batches):
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, name = open_fs(path)
            with fs.open_input_file(name) as file:
                shard, k = Shard(file), 0
                rows = _places(shard)
                while k < len(rows):
                    # neighbours in the payload, as many as fill a batch, one at least, are one read
                    row = int(rows[k])
                    last = max(row + 1, int(np.searchsorted(shard.firsts, shard.firsts[row] + BATCH_BYTES // 4, "right")) - 1)
                    n = int(np.argmin(np.append(rows[k:k + last - row] == np.arange(row, row + len(rows[k:k + last - row])), False)))
                    data, at = shard.payload(row, row + n), shard.firsts[row:row + n + 1] - shard.firsts[row]
                    yield _batch([(None if shard.null[row + i] else int(shard.ids[row + i]), start + int(shard.firsts[row + i]), int(at[i + 1] - at[i]),
                                   data[4 * at[i]:4 * at[i + 1]]) for i in range(n)])
                    k += n


def read_store(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files: every key is asked for through its shard's index and read at the place that it gives."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(_reader, ROWS)


def _lookup(batches):
    name, shard, file = None, None, None
    for b in batches:
        paths, starts, keys = (b.column(i).to_pylist() for i in range(3))
        rows, at = [], 0
        while at < len(paths):
            to = at
            while to < len(paths) and paths[to] == paths[at]:
                to += 1
            if name != paths[at]:
                if file:
                    file.close()
                name = paths[at]
                fs, inner = open_fs(name)
                file = fs.open_input_file(inner)
                shard = Shard(file)
            for key, row, n in zip(keys[at:to], *shard.find(np.asarray(keys[at:to]))):
                rows += [(key, starts[at] + int(shard.firsts[r]), int(shard.firsts[r + 1] - shard.firsts[r]), shard.payload(r, r + 1)) for r in range(row, row + n)]
            at = to
        yield _batch(rows)


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the asked documents by the index; unknown and null keys give no row."""
    wanted = keys.select(F.col(f"`{key_col}`").cast("long").alias("key")).where("key IS NOT NULL").distinct()
    # one row per range partition of the writer: as many as its partition count, whatever the data
    parts = F.broadcast(manifest.groupBy("part").agg(F.min("first_id").alias("low"), F.max("last_id").alias("high")))
    found = wanted.join(parts, F.col("key").between(F.col("low"), F.col("high"))).select("key", "part")
    shards = found.join(manifest.select("part", "path", "start", "first_id", "last_id"), "part").where(F.col("key").between(F.col("first_id"), F.col("last_id")))
    return shards.select("path", "start", "key").repartition("path").sortWithinPartitions("path", "key").mapInArrow(_lookup, ROWS)


def crc(ids: Column) -> Column:
    return F.crc32(ids).cast("long")

"""SimHash near duplicates: fingerprints of word shingles, linked within a Hamming radius, as connected components.

Distinct fingerprints only are searched, in BK-trees. One tree over all would be as large as the corpus and a radius of 4 would visit most of
it, so the trees are sharded so that no link is lost: two prints that differ in at most r bits agree on one of r + 1 groups of bits, so
each print goes to r + 1 buckets, and each bucket is a tree. A bucket with more than ``bucket_rows`` distinct prints is dealt
again by r + 1 groups of its other bits, and so on; buckets of few remaining bits cannot be large. Each tree is searched by its own
members and gives a spanning star of every group it finds, never its pairs.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from terralog.llm.bk_tree import links
from terralog.llm.exact_dedup import in_sieve, sieve, without
from terralog.llm.perfect_hash import mix
from terralog.llm.worker_memory import give_back, small_batches, tidy
from terralog.plans.iterate import components
from terralog.session import cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
COUNT_ROWS = 1 << 16
BITS = 64
BANDS, BAND_ROWS = 20, 5          # a similarity of 0.8 shares no band with a chance of 0.0004
DEPTH = 16                         # levels of buckets; the last is searched whatever its size


def shingle_hashes(raw: bytes | None, words: int):
    """Arrays of the XXH64 hashes of the word shingles, ``COUNT_ROWS`` at a time; none without words."""
    from xxhash import xxh64_intdigest
    text = b" ".join((raw or b"").translate(LOWER).split())
    if not text:
        return
    # the words' ends, without an object for each word
    ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(ends) - words + 1)
    last = ends[words - 1:] if len(ends) >= words else ends[-1:]
    for at in range(0, n, COUNT_ROWS):
        spans = zip(starts[at:min(at + COUNT_ROWS, n)].tolist(), last[at:at + COUNT_ROWS].tolist())
        yield np.fromiter((xxh64_intdigest(text[a:b], SEED) for a, b in spans), np.uint64)


def fingerprints_of(chunks, count: int) -> list[int]:
    """``count`` independent fingerprints of arrays of hashes: bits set in more than half, mixed anew for each but the first; 0 without any."""
    votes, n = np.zeros((count, BITS), dtype=np.int64), 0
    for hashes in chunks:
        n += len(hashes)
        for k in range(count):
            mixed = mix(hashes, k) if k else hashes
            votes[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int(x) for x in np.packbits(votes * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]]


def fingerprint(raw: bytes | None, words: int = 4) -> int:
    """Bits set in more than half of the XXH64 hashes of the word shingles, as an unsigned integer; 0 without words."""
    return fingerprints_of(shingle_hashes(raw, words), 1)[0]


def _prints(words: int):
    def run(batches):
        for b in batches:
            prints = np.asarray([fingerprint(x.as_py(), words) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"])
    return run


def band_keys(hashes: np.ndarray, bands: int) -> list[int]:
    """A key for each band of ``BAND_ROWS`` minima of the hashes under fixed multipliers; sets of similarity s share one with s ** ``BAND_ROWS``."""
    low = np.full(bands * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    factors = np.random.default_rng(SEED).integers(1 << 63, size=(len(low), 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for at in range(0, len(hashes), COUNT_ROWS >> 4):
        low = np.minimum(low, (hashes[None, at:at + (COUNT_ROWS >> 4)] * factors[:, :1] + factors[:, 1:]).min(axis=1))
    keys = np.zeros(bands, dtype=np.uint64)
    for k, column in enumerate(low.reshape(bands, BAND_ROWS).T):
        keys = mix(keys ^ column, k)
    return keys.tolist()


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """The distinct hashes of the shingles in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(raw, words)]))


def _sketch(raw: bytes | None, words: int, count: int, bands: int) -> tuple[bytes, list[int]]:
    """Digest of the shingle set, and the fingerprints and band keys of a text."""
    chunks = list(shingle_hashes(raw, words))
    whole = np.unique(np.concatenate([np.zeros(0, np.uint64), *chunks]))
    return md5(whole.tobytes()).digest(), fingerprints_of(chunks, count) + band_keys(whole, bands)


def _sketches(words: int, count: int, bands: int):
    def run(batches):
        for b in batches:
            found = [_sketch(x.as_py(), words, count, bands) for x in b.column(2)]
            prints = np.asarray([k for _, k in found], dtype=np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * (count + bands), pa.int32()), pa.array(prints, pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([d for d, _ in found], pa.binary()), lists], names=["id", "digest", "alike", "prints"])
    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(x.as_py(), words).view(np.int64) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["base", "shingles"])
    return run


def set_links(sets: list[np.ndarray], label: np.ndarray, alike: float) -> list[tuple[int, int]]:
    """Pairs of positions that join the groups ``label`` of all sets with a Jaccard similarity of at least ``alike``; pairs inside a group are not needed."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True)
    order = np.argsort(token, kind="stable")
    post, held = owner[order], np.bincount(token)
    start, at, out = np.cumsum(held) - held, np.cumsum(size) - size, []
    label = np.unique(label, return_inverse=True)[1]
    for i in range(len(sets)):
        mine = token[at[i]:at[i] + size[i]]
        n = held[mine]
        both = np.bincount(post[np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero((both >= alike * (size + size[i] - both)) & (label != label[i])):
            if label[i] != label[j]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _block_links(alike: float):
    def run(table: pa.Table) -> pa.Table:
        base, _, cluster = (table[c].to_numpy() for c in ("base", "block", "cluster"))
        found = set_links([np.asarray(x.values) for x in table["shingles"].combine_chunks()], cluster, alike)
        give_back()
        return pa.table({c: pa.array([int(base[p[k]]) for p in found], pa.int64()) for k, c in enumerate("ab")})
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, print``; the print is the unsigned fingerprint's bits as a long."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(_prints(words)), "doc_id long, print long")


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _partition(level: int, groups: int) -> list[int]:
    """Masks of ``groups`` parts of the bits: neighbours at level 0, then shuffled differently at each level."""
    bits = np.arange(BITS) if level == 0 else np.random.default_rng(level).permutation(BITS)
    return [_signed(part.tolist()) for part in np.array_split(bits, groups)]


def _deal(rows: DataFrame, level: int, groups: int) -> DataFrame:
    """Each row into ``groups`` buckets, by the bits of a part that its bucket has not fixed yet."""
    parts = F.array(*[F.lit(m) for m in _partition(level, groups)])
    split = rows.select("kind", "print", "free", F.col("key").alias("above"), F.posexplode(parts).alias("part", "mask"))
    fixed = F.col("free").bitwiseAND(F.col("mask"))
    return split.select("kind", "print", F.col("free").bitwiseXOR(fixed).alias("free"), F.xxhash64("above", "part", F.col("print").bitwiseAND(fixed)).alias("key"))


def _shard_links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        prints, kind = table["print"].to_numpy(), table["kind"].to_numpy()
        a, b = links(prints.view(np.uint64), table["key"].to_numpy(), radius)
        return pa.table({"kind": pa.array(kind[a], pa.int32()), "a": pa.array(prints[a], pa.int64()), "b": pa.array(prints[b], pa.int64())})
    return run


def near_links(prints: DataFrame, radius: int = 4, bucket_rows: int = 2048, shard_rows: int = 8192) -> DataFrame:
    """``kind, a, b``: edges between the distinct ``kind, print`` rows that span every group of a kind linked within ``radius`` bits."""
    level, done = prints.select("kind", "print", F.lit(-1).cast("long").alias("free"), F.col("kind").cast("long").alias("key")), []
    for depth in range(DEPTH):
        level = cut(_deal(level, depth, radius + 1), "buckets")
        hot = level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key")
        if depth + 1 == DEPTH or not (hot := cut(hot, "hot")).limit(1).count():
            done.append(level)
            break
        # the prints of a bucket differ in its free bits only, so a bucket of few free bits is small by itself
        done.append(level.join(hot, "key", "left_anti").select(*level.columns))
        level = level.join(hot, "key", "left_semi").select(*level.columns)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    shards = max(1, -(-rows.count() // shard_rows))
    found = rows.select("kind", "print", "key", F.pmod("key", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(_shard_links(radius), "kind int, a long, b long")
    return cut(found.distinct(), "links")


def _heads(nodes: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """``print, head`` for prints that have links."""
    edges = near_links(nodes.select(F.lit(0).alias("kind"), "print"), radius, bucket_rows).select("a", "b")
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    return components(ends, edges).select(F.col("id").alias("print"), F.col("label").alias("head"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, bucket_rows: int = 2048) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row; ``component_id`` is the smallest id reachable over links.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Null ids are members but never a
    component's id, unless it has no other: then that is null. Repeated rows give repeated rows; an empty table gives none.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    led = nodes.join(_heads(nodes, radius, bucket_rows), "print", "left").select("print", "first", F.coalesce("head", "print").alias("head"))
    ids = led.groupBy("head").agg(F.min("first").alias("component_id"))
    known = led.select("print", "head").join(ids, "head").select("print", "component_id")
    return rows.join(known, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _still(up: DataFrame) -> DataFrame:
    """``id, up`` where every chain of ``up`` is followed to its end: a chain of n links takes log4(n) rounds."""
    while True:
        for k in range(2):
            beyond = up.select(F.col("id").alias("mid"), F.col("up").alias("top"))
            up = up.join(beyond, F.col("up") == F.col("mid")).select("id", F.col("top").alias("up"))
        up = cut(up, "up")
        if not up.join(up.where("id <> up").select(F.col("id").alias("up")), "up", "left_semi").limit(1).count():
            return up


def contracted(edges: DataFrame) -> DataFrame:
    """``id, label``: smallest reachable id of every end of ``a, b`` edges.

    Each round every node goes under its smallest neighbour, and on to the end of that chain; the edges are rewritten to the ends, without loops and repeats. Only local minima
    are left, half of the nodes at most, and a crowded group shrinks to few edges at once, where passing labels along all edges would read them again in every round.
    """
    above = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _still(cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "up"))
        step = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        above = cut(up if above is None else above.withColumnRenamed("up", "mid").join(up.withColumnRenamed("id", "mid"), "mid", "left").select("id", F.coalesce("up", "mid").alias("up")), "above")
        edges = edges.join(step.select(F.col("up").alias("a"), F.col("top").alias("ta")), "a").join(step.select(F.col("up").alias("b"), F.col("top").alias("tb")), "b")
        edges = cut(edges.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")) if above is None else above.select("id", F.col("up").alias("label"))


def confirmed(docs: DataFrame, edges: DataFrame, placed: DataFrame, id_col: str, text_col: str, words: int, alike: float, block_size: int = 1 << 17) -> DataFrame:
    """``a, b``: edges that span every group of texts linked by a Jaccard similarity of at least ``alike``, within the groups that the candidates ``edges`` link.

    Candidates are stars, so a member may be like another member and not like the centre. Confirmed edges are contracted, and where a candidate group
    does not become one by them, all its members are compared: in blocks of about ``block_size`` shingles, each pair of blocks by an inverted index.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ends = edges.select(F.col("a").alias("row")).unionByName(edges.select(F.col("b").alias("row"))).distinct()
    named = cut(placed.select("row", "id", "digest").join(ends, "row").select(F.col("row").alias("base"), F.col("id").alias("_id"), F.col("digest").alias("_of"), F.xxhash64("id", "digest").alias("_key")), "named")
    all_rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))
    held = all_rows.where(in_sieve(sieve(named, "_key"), F.xxhash64("id", "digest")))
    texts = held.join(named, (held["digest"] == named["_of"]) & held["id"].eqNullSafe(named["_id"])).select("base", "text").dropDuplicates(["base"])
    with small_batches(docs.sparkSession):
        sets = cut(texts.mapInArrow(tidy(_sets(words)), "base long, shingles array<long>"), "sets")
    side = lambda c: sets.select(F.col("base").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    near = edges.join(side("a"), "a").join(side("b"), "b").where(both >= F.lit(alike) * (F.size("of_a") + F.size("of_b") - both))
    near = cut(near.select("a", "b"), "near")
    groups = contracted(edges).select(F.col("id").alias("base"), F.col("label").alias("group"))
    nodes = groups.join(contracted(near).select(F.col("id").alias("base"), F.col("label").alias("cluster")), "base", "left").withColumn("cluster", F.coalesce("cluster", "base"))
    nodes = cut(nodes.join(sets.select("base", F.size("shingles").alias("size")), "base"), "clusters")
    torn = nodes.groupBy("group").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high AND rows > 2")
    torn = cut(torn.select("group", F.greatest(F.ceil(F.col("n") / block_size), F.lit(1)).cast("long").alias("blocks"), "n"), "torn")
    small = -(-(torn.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // block_size) or 1
    open_ = nodes.join(torn.drop("n"), "group").withColumn("i", F.pmod(F.xxhash64("base"), F.col("blocks"))).select("base", "cluster", "group", "blocks", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    block = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(small))).otherwise(F.xxhash64("group", F.least("i", "j"), F.greatest("i", "j")))
    found = open_.select("base", "cluster", block.alias("block")).join(sets, "base").groupBy("block").applyInArrow(_block_links(alike), "a long, b long")
    return near.unionByName(cut(found, "found"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, prints: int = 8, radius: int = 4, bucket_rows: int = 2048, alike: float = 0.8,
             bands: int | None = None) -> DataFrame:
    """The rows of ``docs`` of which one per group stays, the smallest id (then digest), with all columns as they were.

    Two texts are linked when the Jaccard similarity of their shingle sets is at least ``alike``; groups are connected components. Texts with a similarity of 0.8 differ in
    about 10 of 64 bits, more than any search by equal parts can reach. So candidates are texts of which any of ``prints`` independent prints differs in at most ``radius``
    bits, or any of ``bands`` keys of minima agrees; every link is confirmed by the sets themselves. By default a search by a single print has no bands and finds what
    ``simhash_groups`` finds. Null ids come last. Repeated rows of one id and text give one row. Columns named ``_digest`` would clash and are refused by name.
    """
    if "_digest" in docs.columns:
        raise ValueError("rename the column _digest")
    bands = bands if bands is not None else BANDS if prints > 1 else 0
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))
    schema = StructType([*rows.drop("text").schema.fields, StructField("alike", BinaryType()), StructField("prints", ArrayType(LongType()))])
    with small_batches(docs.sparkSession):
        rows = cut(rows.mapInArrow(tidy(_sketches(words, prints, bands)), schema).withColumn("row", F.monotonically_increasing_id()), "prints")
    # the first row of a shingle set stands for it
    own = cut(rows.groupBy("alike").agg(F.min("row").alias("base")), "own")
    placed = cut(rows.select("row", "id", "digest", "alike").join(own, "alike").select("row", "id", "digest", "base"), "placed")
    flat = rows.join(own.select(F.col("base").alias("row")), "row", "left_semi").select("row", F.posexplode("prints").alias("kind", "print"))
    flat = cut(flat, "flat")
    first = cut(flat.groupBy("kind", "print").agg(F.min("row").alias("base"), F.count("*").alias("n")), "nodes")
    same = flat.join(first.where("n > 1").select("kind", "print", "base"), ["kind", "print"]).select(F.col("row").alias("a"), F.col("base").alias("b"))
    first = first.where(F.col("kind") < prints)
    near = near_links(first.select("kind", "print"), radius, bucket_rows)
    edges = same.unionByName(near.join(first.select("kind", F.col("print").alias("a"), F.col("base").alias("fa")), ["kind", "a"]).join(
        first.select("kind", F.col("print").alias("b"), F.col("base").alias("fb")), ["kind", "b"]).select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    edges = confirmed(docs, edges, placed, id_col, text_col, words, alike)
    heads = cut(contracted(edges).select(F.col("id").alias("base"), F.col("label").alias("head")), "heads")
    placed = placed.join(heads, "base", "left").withColumn("head", F.coalesce("head", "base"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    best = placed.groupBy("head").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    members = placed.join(best, "head").select("id", "digest", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.digest"))).alias("stays"))
    return without(docs, F.unhex(F.sha2(text, 256)), members, id_col)

"""Runs of words: stretches that repeat with a period, found by Kruskal's algorithm over suffixes in descending order of common prefixes.

Suffixes that share a prefix of at least L words form classes; L falls and classes unite (union-find), each with the ordered set of its positions.
Two positions that become neighbours in a set at distance d <= L seed a run of period d: the words from the first position on repeat after d
words. The leftmost seed of a run is the one that no word extends to the left, and its common prefix tells where the run ends. A run of at least
``least`` words and ``times`` periods has a seed with L >= ``floor_of(least, times)``, so shorter common prefixes are never united; positions whose
next words occur only once in their document have no longer one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)     # odd; hashes only choose positions, equality is decided by ranks
NONE = np.zeros((0, 3), dtype=np.int64)


def floor_of(least: int, times: int) -> int:
    """Least common prefix of the leftmost seed of a run: length - period, at length >= max(least, times * period)."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(words: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Positions whose next ``span`` words occur again in the same document (by hash: some others may come along)."""
    n = len(words) - span + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h, size, factor, whole, done = (words.astype(np.uint64) + np.uint64(1)) * BASE, 1, BASE, None, 0
        bits = span
        while bits:
            if bits & 1:
                whole, done = (h, size) if whole is None else (whole[:len(h) - done] * factor + h[done:][:len(whole)], done + size)
            if bits := bits >> 1:
                h, size, factor = h[:-size] * factor + h[size:] ^ (h[:-size] >> np.uint64(29)), size * 2, factor * factor
        key = whole[:n] ^ ((owner[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    inside = np.flatnonzero(owner[:n] == owner[span - 1:])
    order = np.argsort(key[inside])
    key, same = key[inside[order]], np.zeros(len(inside) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    return np.sort(inside[order[same[1:] | same[:-1]]])


def common_prefixes(words: np.ndarray, ends: np.ndarray, owner: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """``i, j, L``: positions of ``at`` that are neighbours in suffix order within their document, with the length of their common prefix, where at least ``least``.

    Ranks by prefix doubling: those of 1, 2, 4, .. words are kept for the suffixes that still share a rank, and give the lengths back.
    """
    n = len(words)
    _, rank = np.unique(owner * (int(words.max()) + 1) + words, return_inverse=True)
    levels, size, rank = [], 1, rank.astype(np.int64) + 1

    def after(rank, at, by):
        """Rank of the suffix ``by`` words on; 0 beyond the document."""
        to = at + by
        return np.where(to < ends[at], rank[np.minimum(to, n - 1)], 0)

    every = np.arange(n)
    while True:
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        key = rank * (n + 1) + after(rank, every, size)
        order = np.argsort(key, kind="stable")
        step = np.append(True, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        size *= 2
        if step.all():
            break
    at = at[np.argsort(rank[at])]
    i, j = at[:-1], at[1:]
    same = owner[i] == owner[j]
    i, j = i[same], j[same]
    length = np.zeros(len(i), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + length, j + length
        held = levels[level]
        equal = (a < ends[i]) & (b < ends[j]) & (held[np.minimum(a, n - 1)] == held[np.minimum(b, n - 1)])
        # equal ranks of a level mean equal words only if the level's words all lie inside the document
        equal &= np.maximum(a, b) + (1 << level) <= ends[i]
        length += equal.astype(np.int64) << level
    kept = length >= least
    return np.column_stack([i[kept], j[kept], length[kept]])


def seeds(edges: np.ndarray) -> list[tuple[int, int, int]]:
    """``i, d, L`` of positions that become neighbours, at distance d <= L, in the class of common prefix L."""
    order = np.argsort(-edges[:, 2], kind="stable")
    up: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []

    def find(x):
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    rows = edges[order].tolist()
    at = 0
    while at < len(rows):
        level, stop = rows[at][2], at
        # all edges of one length unite together: sets that meet are put together once
        joined: dict[int, list[int]] = {}
        while stop < len(rows) and rows[stop][2] == level:
            a, b = find(rows[stop][0]), find(rows[stop][1])
            if a != b:
                parts = joined.pop(a, [a]) + joined.pop(b, [b])
                root = a if len(held.get(a, (a,))) >= len(held.get(b, (b,))) else b
                up[a], up[b] = root, root
                joined[root] = parts
            stop += 1
        for root, parts in joined.items():
            sets = sorted((held.pop(p, [p]) for p in parts), key=len)
            big, few = sets.pop(), sum(map(len, sets))
            if few * 16 < len(big):
                new = [x for s in sets for x in s]
                for x in new:
                    insort(big, x)
                for x in new:
                    k = bisect_left(big, x)
                    # a neighbour on the right that is new itself is told by that one
                    out += [(p, q - p, level) for p, q in zip(big[max(k - 1, 0):k + 1], big[max(k, 1):k + 2]) if q - p <= level]
            else:
                mark = {x: k for k, s in enumerate(sets) for x in s}
                big = sorted(big + [x for s in sets for x in s])
                out += [(p, q - p, level) for p, q in zip(big, big[1:]) if q - p <= level and mark.get(p, -1) != mark.get(q, -1)]
            held[root] = big
        at = stop
    return out


def runs_of(words: np.ndarray, ends: np.ndarray, owner: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """``start, length, period`` (positions over all documents, in order) of every run of at least ``least`` words and ``times`` periods.

    ``words`` are numbers of words, documents one after another; ``owner`` is the document of each position and ``ends`` the end of that.
    """
    floor = floor_of(least, times)
    at = repeated(words, owner, floor)
    if not len(at):
        return NONE
    # only documents with such positions are sorted
    docs = np.unique(owner[at])
    inside = np.isin(owner, docs)
    new = np.cumsum(inside) - 1
    places = np.flatnonzero(inside)
    w, o = words[inside], owner[inside]
    e = new[ends[inside] - 1] + 1
    edges = common_prefixes(w, e, o, new[at], floor)
    found = seeds(edges) if len(edges) else []
    if not found:
        return NONE
    i, d, level = np.asarray(found, dtype=np.int64).T
    first = np.append(True, o[1:] != o[:-1])
    whole = (d + level >= np.maximum(least, times * d)) & (first[i] | (w[i - 1] != w[i - 1 + d]))
    out = np.unique(np.column_stack([places[i], d + level, d])[whole], axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


@dataclass(frozen=True)
class Planted:
    """A rewrite of some documents, so that every table holds long runs: words from ``first`` on repeat with ``period``."""
    first: int
    period: int


def rewrite(doc_id: int | None, n: int) -> Planted | None:
    """The rule for the document's id; a document without id or words stays as it is."""
    h = None if doc_id is None else crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    return Planted(g % n, 1 + (n - g % n) // (3 + g % 8))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def _split(raw: bytes | None, doc_id: int | None, rewritten: bool) -> list[bytes]:
    words = (raw or b"").split()
    if rewritten and (r := rewrite(doc_id, len(words))):
        tail = words[r.first:r.first + r.period]
        whole = tail * (-(-(len(words) - r.first) // len(tail)))
        words = words[:r.first] + whole[:len(words) - r.first]
    return words


def _finder(rewritten: bool, least: int, times: int):
    def found(ids, texts):
        number: dict[bytes, int] = {}
        split = [_split(raw, i, rewritten) for i, raw in zip(ids, texts)]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        if sizes.sum():
            words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(sizes.sum()))
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(split)), sizes)
            runs = runs_of(words, ends[owner], owner, least, times)
        else:
            runs, ends, owner = NONE, np.cumsum(sizes), np.zeros(0, np.int64)
        of = owner[runs[:, 0]]
        edges = np.searchsorted(of, np.arange(len(split) + 1))
        starts, lists, text = ends - sizes, [], []
        for k, ws in enumerate(split):
            mine = runs[edges[k]:edges[k + 1]] - np.asarray([starts[k], 0, 0]) if edges[k] < edges[k + 1] else NONE
            lists.append(mine.reshape(-1))
            text.append(b" ".join(ws if not len(mine) else [w for w, keep in zip(ws, kept_words(len(ws), mine).tolist()) if keep]))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(text, pa.binary())], names=["doc_id", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            ids, texts, size = [], [], 0
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(x.as_py())
                size += len(texts[-1] or b"")
                if size >= BATCH_BYTES:
                    yield found(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield found(ids, texts)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, rewritten: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row, in one pass without a shuffle.

    ``runs`` is an array of ``start, length, period`` in order of start, then period; ``collapsed`` is the text without the repetitions, its words joined by one space. Words are separated by
    ASCII white space. Null and empty texts, and texts of white space, have no runs and an empty text; ids may be null or repeated; other columns are
    not read. A document is handled in one task; its work grows with its words times the logarithm of its longest repetition. ``rewritten`` first makes every tenth document periodic.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(_finder(rewritten, least, times), "doc_id long, runs array<long>, collapsed binary")
    flat = F.transform(F.sequence(F.lit(0), (F.size("runs") / 3).cast("int") - 1), lambda k: F.struct(*[F.get("runs", 3 * k + i).alias(c) for i, c in enumerate(("start", "length", "period"))]))
    return out.select("doc_id", F.when(F.size("runs") > 0, flat).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")).alias("runs"), F.col("collapsed").cast("string").alias("collapsed"))


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``: counts, the run of the greatest exponent, and digests."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    # length / period is compared exactly, by cross products
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(ahead(r, a), r).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

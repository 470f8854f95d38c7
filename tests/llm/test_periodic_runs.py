"""Runs against a search by every period, and the query against plain Python."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from terralog.llm import periodic_runs as R
from terralog.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, times * q) and not any(w[s:s + size - p] == w[s + p:s + size] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digests(doc_id, text, rewritten=True):
    w = (text or "").encode().split()
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewritten and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] * 10 ** 9 // r[2], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.mark.parametrize("least, times", [(24, 3), (8, 2), (6, 3), (1, 2)])
def test_runs_equal_brute_force(least, times):
    rng = np.random.default_rng(least)
    for _ in range(80):
        docs = []
        for _ in range(int(rng.integers(1, 5))):
            parts = []
            for _ in range(int(rng.integers(0, 6))):
                unit = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 14))).tolist()
                parts += rng.integers(0, 3, int(rng.integers(0, 20))).tolist() if rng.random() < 0.4 else (unit * int(rng.integers(2, 12)))[:int(rng.integers(1, 100))]
            docs.append(parts)
        sizes = np.array([len(d) for d in docs])
        if not sizes.sum():
            continue
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(docs)), sizes)
        got = R.runs_of(np.array(sum(docs, [])), ends[owner], owner, least, times)
        want = [(s + int(ends[k] - sizes[k]), size, q) for k, d in enumerate(docs) for s, size, q in brute(d, least, times)]
        assert [tuple(x) for x in got.tolist()] == want


def test_prefix_floor():
    assert R.floor_of(24, 3) == 16 and R.floor_of(8, 2) == 4 and R.floor_of(1, 2) == 1


def test_long_and_crowded_texts():
    """One word half a million times, and a passage twenty thousand times between words that differ."""
    n = 500_000
    assert R.runs_of(np.zeros(n, np.int64), np.full(n, n), np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    w = np.concatenate([np.append(np.arange(20), 20 + k) for k in range(20_000)])
    assert len(R.runs_of(w, np.full(len(w), len(w)), np.zeros(len(w), np.int64))) == 0


def test_edges(spark):
    again = "one two three four five six seven eight nine " * 4
    rows = [(1, again), (1, again), (2, None), (3, ""), (4, " \n\t"), (None, again), (5, "a " * 23), (6, "a " * 24), (7, ("x y " * 30 + "z ") * 3), (8, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS best").repartition(3)
    got = sorted(((r["doc_id"] or -1), *tuple(r)[1:]) for r in R.run_digests(R.periodic_runs(docs)).where("doc_id IS NULL OR doc_id < 8").collect())
    want = sorted(((i or -1), *digests(i, t, False)) for i, t in rows if i != 8)
    assert [repr(g) for g in got] == [repr(w) for w in want]
    big = R.periodic_runs(docs).where("doc_id = 8").first()
    assert [tuple(x) for x in big["runs"]] == [(0, 100_000, 1)] and big["collapsed"] == "word"
    assert R.run_digests(R.periodic_runs(docs.limit(0))).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(got) >= len(rows) > 100 and any(v[0] for v in got.values())
    assert all(got[r["doc_id"]] == digests(r["doc_id"], r["text"]) for r in rows)

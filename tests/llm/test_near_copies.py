"""Near copies against brute force around the similarity of 0.8."""

import numpy as np
import pytest

from terralog.llm.simhash import keep_one, set_links
from tests.llm.test_text_operators import jaccard


def brute_kept(rows, alike=0.8):
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and jaccard(rows[a][1], rows[b][1]) >= alike:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted({g: min(i for (i, _), h in zip(rows, group) if h == g) for g in group}.values())


def pairs(low, high, count, rng):
    out = []
    while len(out) < count:
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, 200)]
        other = list(base)
        for at in rng.choice(200, int(rng.integers(2, 10)), replace=False):
            other[int(at)] = f"changed{int(rng.integers(1 << 30))}"
        pair = " ".join(base), " ".join(other)
        if low <= jaccard(*pair) < high:
            out.append(pair)
    return out


@pytest.mark.parametrize("low, high, left", [(0.8, 0.9, 40), (0.7, 0.8, 80)])
def test_pairs_at_the_threshold(spark, low, high, left):
    rows = [(2 * k + j, t) for k, pair in enumerate(pairs(low, high, 40, np.random.default_rng(11))) for j, t in enumerate(pair)]
    kept = sorted(r["doc_id"] for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == brute_kept(rows) and len(kept) == left


def test_chains_and_repeats(spark):
    """Members that are like each other but not like the centre of their candidates, and equal prints of unlike sets."""
    rng, rows = np.random.default_rng(4), []
    for k in range(8):
        w = [f"w{int(x)}" for x in rng.integers(0, 5000, 120)]
        for j in range(12):
            rows.append((100 * k + int(rng.permutation(100)[0]) // 12 * 12 + j, " ".join(w)))
            for at in rng.choice(120, 1 + (j + k) % 4, replace=False):
                w[int(at)] = f"new{k}x{j}x{int(at)}"
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(5000, "word " * 3000 + "one line of its own"), (5001, "word " * 3000 + "quite another ending here"), (5002, ""), (5003, " ")]
    kept = sorted(r["doc_id"] for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == brute_kept(rows)


def test_set_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(60)]
    got, want = np.arange(60), np.arange(60)
    for a, b in set_links(sets, np.arange(60), 0.5):
        got[got == got[b]] = got[a]
    for a in range(60):
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])):
                want[want == want[b]] = want[a]
    assert all(((got == got[i]) == (want == want[i])).all() for i in range(60)) and 1 < len(set(want.tolist())) < 60


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Ascending, descending, shuffled and starred chains of 4,096 links; every round writes a bounded number of tables."""
    from terralog.llm import simhash
    rounds, real = [], simhash.cut

    def counted(df, label="cut"):
        rounds.append(label)
        return real(df, label)
    monkeypatch.setattr(simhash, "cut", counted)
    rng = np.random.default_rng(7)
    n = 4096
    mixed = rng.permutation(n).tolist()
    for order in (list(range(n)), mixed):
        rounds.clear()
        edges = [(a, b) for a, b in zip(order, order[1:])] + [(10_000, k) for k in range(10_001, 10_200)]
        got = {r["id"]: r["label"] for r in simhash.contracted(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {**dict.fromkeys(range(n), 0), **dict.fromkeys(range(10_000, 10_200), 10_000)}
        assert rounds.count("edges") <= 16 and len(rounds) <= 60

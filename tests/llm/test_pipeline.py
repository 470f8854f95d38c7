"""The whole pipeline over a small folder with nulls, empty and repeated rows, against stage by stage brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralog.llm import toxicity
from terralog.llm.tokens import memo, tokenizer_path
from terralog.session import scratch_path
from tests.llm.test_text_operators import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, rows, labels):
    path = scratch_path(spark, "small")
    spark.createDataFrame([(i, t, "en", "hot", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{int(x)}" for x in rng.integers(0, 4000, n)]
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        rows.append((i, " ".join(words(60) + ["idiot", "worthless", "stupid"] * bad)))
        labels.append((i, 1, int(bad)))
    base = words(150)
    for k in range(6):                                     # near copies, each a little further from the first
        base = list(base)
        base[10 * k] = f"new{k}"
        rows.append((200 + k, " ".join(base)))
    rows += [(300, rows[1][1]), (301, rows[1][1].replace(" ", "  \n")), (302, rows[1][1])] * 2
    rows += [(400, None), (401, ""), (402, " \t"), (None, "a text without id " * 4), (403, "word " * 3000)]
    return rows, folder(spark, rows, labels)


def first_of(groups):
    return [min(g, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0)) for g in groups]


def test_pipeline_against_brute_force(spark, small):
    rows, path = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    clean = [r for r in rows if toxicity.score_text(r[1].encode() if r[1] else None, model) < 0.3]
    assert 20 < len(rows) - len(clean) < 40
    same = {}
    for r in clean:
        same.setdefault(" ".join((r[1] or "").split()) if (r[1] or "").split() else " " * bool(r[1]), []).append(r)
    once = first_of(same.values())
    near = []
    for r in once:
        hits = [g for g in near if any(jaccard(r[1] or "", x[1] or "") >= 0.8 for x in g)]
        near = [g for g in near if not any(g is h for h in hits)] + [[r, *(x for g in hits for x in g)]]
    kept = sorted((i if i is not None else -1) for i, _ in first_of(near))
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted({(r["doc_id"] if r["doc_id"] is not None else -1) for r in out}) == kept
    # every id lies in one piece, sequences are gapless and short enough
    words, text = memo(tokenizer_path()), {i: t for i, t in rows}
    for i in {r["doc_id"] for r in out}:
        pieces = sorted((r["start"], bytes(r["ids"])) for r in out if r["doc_id"] == i)
        ids = np.frombuffer(words.encode(text[i]), words.kind).astype("<u4").tobytes()
        assert b"".join(p for _, p in pieces) == ids
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_stages_keep_columns(spark, small):
    _, path = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.simpleString() == docs.schema.simpleString(), name


def test_pipeline_over_an_empty_table(spark):
    assert corpus_pipeline.run(spark, folder(spark, [], [])).count() == 0


def test_recall_of_near_copies_on_given_documents(spark):
    """All pairs of the smallest table by the sets themselves."""
    from terralog.llm.simhash import keep_one
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    sets = [frozenset(zip(*[t.lower().split()[k:] for k in range(5)])) if len(t.split()) >= 5 else frozenset([tuple(t.lower().split())]) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = {min(i for (i, _), h in zip(rows, group) if h == g) for g in group}
    got = {r["doc_id"] for r in keep_one(docs).select(F.col("doc_id")).collect()}
    assert got == want and len(want) < len(rows)

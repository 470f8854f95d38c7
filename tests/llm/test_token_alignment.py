"""Token alignment against plain merging of token ends, and corpus counts by hand."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from terralog.llm import token_alignment as T
from terralog.llm.lockstep import Decimals, groups_text, lanes, lockstep
from terralog.llm.queries import QUERIES
from terralog.llm.tokens import tokenizer_path
from tests.conftest import SMALL

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return T.token_pair(*PATHS)


def plain(pair, text):
    """Groups as pairs of id lists, by the libraries on the whole text; None without tokens."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.raw_a[i] for i in a) != raw or b"".join(pair.raw_b[i] for i in b) != raw:
        return None
    ends = [list(np.cumsum([len(r[i]) for i in ids])) for ids, r in ((a, pair.raw_a), (b, pair.raw_b))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or [])


def expected(pair, texts):
    every = [plain(pair, t) for t in texts]
    count = Counter((a[-1], b[-1]) for g in every for a, b in g or [])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for g in every:
        links = [(a[-1], b[-1]) for a, b in g or []]
        s = text_of(g)
        out.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    sha256(s.encode()).hexdigest() if s else ""))
    return out


ODD = [None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a\n\nb  c", "tab\tx \n y", "x<|endoftext|>y <s> </s><0x41>", "mark▁ inside", "é　ü \x1c z", "foo\nbar\n", "\nfoo", "it's 123456 $$$ \r\n ok",
       "0" * 3000, "日本語のテキスト 😀😀", "same words here", "same words here", "base64" * 200 + " end", "nul\x00l"]


def test_lockstep_is_the_intersection():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 400, 20)
        total = int(sizes.sum())
        a, b = (np.unique(np.append(rng.choice(total, min(total, 900)) + 1, np.cumsum(sizes))) for _ in "ab")
        partner = lockstep(a, b, lanes(sizes, int(rng.integers(1, 300))))
        assert set(a[partner >= 0].tolist()) == set(a.tolist()) & set(b.tolist()) and (a[partner >= 0] == b[partner[partner >= 0]]).all()


def test_groups_text():
    got = groups_text(np.array([5, 10, 99999]), np.array([0, 7, 123]), np.array([2, 1]), np.array([1, 2]), Decimals(100_000))
    assert got == b"5,10|0;99999|7,123" and groups_text(*[np.zeros(0, np.int64)] * 4, Decimals(10)) == b""


@pytest.mark.parametrize("stretch", [1 << 20, 8])
def test_texts_equal_the_libraries(pair, monkeypatch, stretch):
    monkeypatch.setattr(T, "STRETCH", stretch)
    rng = np.random.default_rng(2)
    texts = ODD + ["".join(rng.choice(list("ab é\n\t 1.,'s▂") + ["the ", "ing ", "  "], int(rng.integers(1, 120)))) for _ in range(150)]
    got = [groups_text(*f, pair.decimals).decode() if f else "" for f in T.aligned_texts(pair, texts)]
    assert got == [text_of(plain(pair, t)) for t in texts]


def test_a_full_memo_starts_anew(pair, monkeypatch):
    monkeypatch.setattr(T, "MEMO_TOKENS", 4)
    fresh = T.TokenPair(*PATHS)
    for t in ("one two three four", "five six", "one six", "two"):
        assert groups_text(*next(T.aligned_texts(fresh, [t])), fresh.decimals).decode() == text_of(plain(pair, t))


@pytest.mark.parametrize("head", [T.HEAD_ROWS, 5, 0])
def test_counts(spark, pair, head):
    rows = [(i % 9 if i % 5 else None, t) for i, t in enumerate(ODD + ["same words here and the same words there"] * 3 + [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS pairs", "2 AS n_a").repartition(3)
    got = T.score_links(*T.align_documents(docs, *PATHS), *PATHS, head_rows=head)
    want = sorted(zip([r[0] if r[0] is not None else -1 for r in rows], expected(pair, [r[1] for r in rows])))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r)[1:]) for r in got.collect()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.score_links(*T.align_documents(docs, *PATHS), *PATHS).count() == 0


def test_query(spark, pair):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_token_alignment"](spark, SMALL).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], expected(pair, [r["text"] for r in rows])))

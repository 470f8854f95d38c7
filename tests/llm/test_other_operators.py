"""Dealt operators on vectors, pages and pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.llm import perfect_hash as mph
from terralog.llm.bk_tree import links
from terralog.llm.html_extract import extract, extract_pages
from terralog.llm.sentencepiece_codec import MARK, Codec, decode_documents, encode_documents
from terralog.llm.tokens import tokenizer_path
from terralog.llm.topk import exact_topk, integer_vectors


def brute_topk(rows, k):
    out = []
    for q, v in rows:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q and len(w) == len(v))
            out += [(q, r + 1, c, max(min(-m, (1 << 63) - 1), -(1 << 63) + 1)) for r, (m, c) in enumerate(s[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 8)]) for i in range(900)] + [(1000, [1 << 40] * 8), (1001, [1 << 61] * 8), (1002, [-(1 << 62)] * 8), (1003, [1, 2]), (1100, [3, 4]), (1200, []), (1201, [])]
    vectors = spark.createDataFrame([*rows, rows[5], rows[200]], "vec_id long, vec array<long>")
    for cell_mb in (16, 0):
        got = sorted(tuple(r) for r in exact_topk(vectors, F.col("vec_id") % 100 == 0, 10, cell_mb, fan_in=2).collect())
        assert got == brute_topk(rows, 10)
    assert exact_topk(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_integer_vectors(spark):
    rows = [(1, [0.5, -0.0001]), (2, None), (None, [1.0]), (3, [1.0, None]), (4, [float("nan")]), (5, [float("-inf")]), (6, [])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, vec int, v int")
    assert sorted((r[0], r[1]) for r in integer_vectors(table).collect()) == [(1, [512, -1]), (6, [])]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    sizes, words = mph.build(keys)
    assert sorted(mph.probe(keys, sizes, words, mph.ranks(words)).tolist()) == list(range(len(keys)))
    assert int(sizes.sum()) < 5 * len(keys)
    none = mph.build(np.zeros(0, np.uint64))
    assert mph.probe(keys[:3], *none, mph.ranks(none[1])).tolist() == [-1] * 3


def test_bk_tree_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    flips = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    prints = np.unique(np.concatenate([base, np.asarray([b ^ flips() for b in base for _ in range(5)])]))
    bucket = np.asarray([int(p) % 3 for p in prints])
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bucket[a] == bucket[b] and int(prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = {frozenset(int(p) for p, h in zip(prints, group) if h == g) for g in group if group.count(g) > 1}
    got = {}
    for a, b in zip(*(prints[at] for at in links(prints, bucket, 4))):
        got.setdefault(int(b), {int(b)}).add(int(a))
    assert {frozenset(x) for x in got.values()} == want


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>The  head&amp;line</h1></header><p><b>First&nbsp;paragraph of some length here<br>goes on.<p>Second one &#8217; &eacute; with
more text in it.<div class="ad">Buy now</div><ul><li>item one<li>item two</ul><form><input><button>Go</button></form><section id="comments"><p>A reader says no.</p></section></article>
<aside>Side</aside><footer>&copy; us</footer>"""


def test_extract():
    assert extract(PAGE) == "The head&line\nFirst paragraph of some length here goes on.\nSecond one ’ é with more text in it.\nitem one\nitem two"
    body = "<div class='x'><h2>Head</h2><p>%s</p><p>short</p><p>%s</p></div>" % ("long text here " * 20, "more text " * 30)
    assert extract(f"<body><div class=menu>a b c</div>{body}<div class='comments'><p>{'troll ' * 50}</p></div>").split("\n")[::2] == ["Head", "short"]
    assert extract(None) == extract("") == extract("<html><body><nav>x</nav></body></html>") == ""
    assert extract("just text") == "just text"
    assert extract("<article><p>" + "a b " * 100_000 + "</p></article>") == ("a b " * 100_000).strip()
    assert extract("<p>cut off in a <b") .startswith("cut off in a")


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got if r["page_id"]] == [(1, len(extract(PAGE)))] * 2
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got if r["page_id"] is None] == [(None, None, "", 0)]
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def codec():
    return Codec(tokenizer_path("piece_bpe_32k.model"))


def plain_viterbi(codec, text):
    score = {codec.model.id_to_piece(i): (i, x) for _, ids, xs in codec.table.keys.values() for i, x in zip(ids.tolist(), xs.tolist())}
    s = MARK + text.replace(" ", MARK) if text else ""
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for k in range(min(max(codec.table.keys), j), 0, -1):
            piece, x = score.get(s[j - k:j], (-1, codec.table.unknown if k == 1 else None))
            if x is not None and best[j - k] + x > best[j]:
                best[j], back[j] = best[j - k] + x, (k, piece)
    out, j = [], len(s)
    while j:
        k, piece = back[j]
        out.append([piece] if piece >= 0 else [codec.bytes[b] for b in s[j - k:j].encode()])
        j -= k
    return [i for x in out[::-1] for i in x]


def test_sentencepiece(codec):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeth in▁ \n日é😀.x") for _ in range(r.randrange(80))) for _ in range(150)] + ["", None, " ", "a" * 2000, "  the  thing  ", "internationalisation"]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain_viterbi(codec, text or "")
        assert codec.decode(ids) == (text or "").replace(MARK, " ")


def test_sentencepiece_tables(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (None, None, None), (2, "", 1)], "doc_id long, text string, ids int")
    both = decode_documents(encode_documents(docs, path), path).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in both) == [(0, ""), (1, "Hello world"), (1, "Hello world"), (2, "")]
    by_model = encode_documents(docs, path, algorithm="model").where("n_pieces > 0").first()
    from sentencepiece import SentencePieceProcessor
    assert np.frombuffer(by_model["ids"], "<u4").tolist() == SentencePieceProcessor(model_file=path).encode("Hello world")
    assert encode_documents(docs.limit(0), path).count() == 0

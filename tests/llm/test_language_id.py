"""Language identification against plain naive Bayes and by held-out accuracy."""

import zlib
from collections import Counter
from math import exp, log

import numpy as np

from terralog.llm import language_id as L
from terralog.llm.queries import QUERIES
from tests.conftest import SMALL


def plain_grams(text):
    """Hash input as tuples of letters and spaces, by loops."""
    words = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text).split()
    line = " " + " ".join(words) + " " if words else " "
    return [line[i:i + n] for n in L.SIZES for i in range(len(line) - n + 1) if line[i:i + n] != " "]


def bucket(gram):
    codes = np.array([ord(c) for c in gram], dtype=np.uint64)
    got = list(L.grams(codes, np.zeros(len(codes), np.int64), np.ones(len(codes), bool)))
    return int(got[-1][0][-1 if len(gram) == 1 else 0])


def test_scores_equal_plain_bayes(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat", "en"), ("le chat est là", "fr"), ("der Hund und die Katze", "de"), ("el perro y el gato", "es")] * 4)]
    rows = [(i, f"{t} {i % 3}", g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    count = {g: Counter(bucket(x) for t in {t for _, t, h in rows if h == g} for x in plain_grams(t)) for g in model.languages}
    size = 1 << L.BUCKET_BITS
    texts = ["the dog and the cat", "Le perro", "ÉTÉ là-bas 12", "Straße und Hund"]
    best, score = L.score_texts(texts, model)
    for t, b, s in zip(texts, best, score):
        at = {g: sum(log((c[bucket(x)] + 0.5) / (sum(c.values()) + 0.5 * size)) for x in plain_grams(t)) for g, c in count.items()}
        top = max(at, key=at.get)
        assert model.languages[b] == top and abs(s - 1 / sum(exp(v - at[top]) for v in at.values())) < 1e-4


def test_blocks_do_not_change_counts():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc é1"), int(n))) for n in (0, 1, 5, 4000, 17, 900)]

    def count(chars):
        return Counter((b, o) for block in L.blocks(texts, chars) for bs, os_ in L.grams(*block) for b, o in zip(bs.tolist(), os_.tolist()))
    assert count(64) == count(7) == count(1 << 18) and sum(count(64).values()) == sum(len(plain_grams(t)) for t in texts)


def test_edges(spark):
    rows = [(1, "une phrase en français", "fr"), (1, "une phrase en français", "fr"), (3, "a sentence in English", "en"), (5, "no language", None), (None, "words without id", "en"),
            (7, None, "fr"), (8, "", "fr"), (9, "12 34 !?", "en"), (10, "x " * 400_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS lang_pred", "2 AS hash")
    model = L.fit(docs)
    assert model.languages == ("en", "fr")
    got = sorted(((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in L.predict(docs, model).collect()))
    assert len(got) == len(rows) and {g for i, g, _ in got if i in (7, 8, 9)} == {"und"} and all(s == 0 for i, _, s in got if i in (7, 8, 9))
    assert [g for i, g, _ in got if i == 1] == ["fr", "fr"] and all(0 <= s <= 1 for _, _, s in got)
    none = L.fit(docs.limit(0))
    assert none.languages == () and L.predict(docs.limit(0), none).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs, none).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(out, "geheim", "xx"), (out + 1 if zlib.crc32(str(out + 1).encode()) % 4 != 2 else 0, "known", "en")], "doc_id long, text string, lang string")
    assert L.fit(docs).languages == ("en",)


def test_query_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = [(r["lang_pred"], lang[r["doc_id"]]) for r in QUERIES["op11_language_id"](spark, SMALL).where("held_out").collect()]
    assert len(got) > 20 and sum(a == b for a, b in got) >= 0.97 * len(got)

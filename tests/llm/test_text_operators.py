"""Dealt operators on texts: edge cases on small fixtures, held against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.llm import toxicity
from terralog.llm.exact_dedup import exact_dedup, keep_first
from terralog.llm.license_scan import classify, licenses, scan_licenses, train, words_of, grams_of
from terralog.llm.line_dedup import line_dedup
from terralog.llm.packing import pack
from terralog.llm.simhash import fingerprint, keep_one, simhash_groups
from terralog.llm.tokens import WordMemo, tokenizer_path
from terralog.llm.token_store import lookup, read_store, write_store

SCHEMA = "doc_id long, text string, id string, row int, digest string, key long, n long"      # names that operators use inside


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 7, 8) for i, t in rows], SCHEMA)


ROWS = [(5, "one  two\tthree"), (3, "one two three"), (9, None), (7, ""), (None, "one two three"), (2, "A line that repeats\nb\nA line that repeats "), (2, "A line that repeats\nb\nA line that repeats "),
        (4, "  a LINE that repeats\nÉtoile entière ici\n"), (6, "ÉTOILE entière ici\nétoile entière ici"), (8, "word " * 5000)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(spark):
    got = rows_of(exact_dedup(table(spark, ROWS)))
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in ROWS]
    assert len(got) == len(ROWS)
    for i, keep, size, kept, digest in got:
        same = [a for a, t in norm if hashlib.sha256(t.encode()).hexdigest() == digest]
        assert size == len(same) and keep == min(a for a in same if a is not None)
    assert sum(r[3] for r in got) == len({t for _, t in norm})
    assert exact_dedup(table(spark, [])).count() == 0
    assert rows_of(exact_dedup(table(spark, [(None, "q"), (None, "q")])).select("keep_id", "group_size", "kept")) == [(None, 2, False), (None, 2, True)]


def test_exact_dedup_runs(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text")).repartition(40)
    got = exact_dedup(docs, fan_in=2).groupBy("keep_id", "group_size").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {(k, len(range(k, 400, 7)), len(range(k, 400, 7)), 1) for k in range(7)}


def test_keep_first(spark):
    got = keep_first(table(spark, ROWS))
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3, 4, 6, 7, 8]
    with pytest.raises(ValueError):
        keep_first(table(spark, ROWS).withColumn("_digest", F.lit(1)))


def brute_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) not in first or order(i) < order(first[key(line)]):
                first[key(line)] = i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = [*ROWS, (None, "A line that repeats"), (11, "\n\n"), (12, "x" * 9 + "\n" + "x" * 10), (13, "x" * 10), (14, "\n".join(f"shared line number {i}" for i in range(200))),
            (15, "\n".join(f"Shared line number {i}" for i in range(0, 200, 3)) + "\ntail")]
    assert rows_of(line_dedup(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute_lines(rows)
    assert line_dedup(table(spark, [])).count() == 0


def brute_simhash(rows, words=4, radius=4):
    from xxhash import xxh64_intdigest
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        hs = [xxh64_intdigest(" ".join(w[i:i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    return sorted(((i, f"{p:016x}", best[g]) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def near_rows():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"], 300)) for _ in range(6)]
    rows = [*ROWS, (90, "   \n"), (91, "One two THREE")]
    for k, b in enumerate(base):
        w = b.split()
        for j in range(12):
            w[int(rng.integers(len(w)))] = f"new{k}x{j}"
            rows.append((100 + 20 * k + j, " ".join(w)))
    return rows


@pytest.mark.parametrize("bucket_rows", [2048, 8])
def test_simhash(spark, bucket_rows):
    rows = near_rows()
    want = brute_simhash(rows)
    assert rows_of(simhash_groups(table(spark, rows), bucket_rows=bucket_rows)) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})          # there are links between different prints


def test_simhash_empty(spark):
    assert simhash_groups(table(spark, [])).count() == 0
    assert fingerprint(None) == fingerprint(b" \t") == 0


def test_keep_one(spark):
    rows = near_rows()
    want = {c for _, _, c in brute_simhash(rows)}
    got = keep_one(table(spark, rows), words=4, prints=1).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    assert keep_one(table(spark, [])).count() == 0


def jaccard(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_by_similarity(spark):
    rng = np.random.default_rng(8)
    rows, close = [], 0
    for k in range(40):
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, 400)]
        other = list(base)
        for at in rng.choice(400, 1 + k % 4, replace=False):
            other[int(at)] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        close += jaccard(*(t for _, t in rows[-2:])) >= 0.9
    assert close == 40
    kept = {r["doc_id"] for r in keep_one(table(spark, rows)).collect()}
    assert {2 * k for k in range(40)} <= kept and len(kept) <= 43


ODD = "don't Stop. I'VE <|endoftext|> a<|endoftext|>.b ÀÉ Straße ŒUVRE İstanbul ΣΑΣ Σ. ﬁ été. ª² ½. 12.5, abc123, a\x1cb\xa0c d 日本。 .. (a) \"q\" of%%% éte ŉ ſt"


def direct_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_word_memo():
    memo = WordMemo(tokenizer_path())
    for text, want in zip([ODD, "", None, ODD.upper()], direct_ids([ODD, "", None, ODD.upper()])):
        assert np.frombuffer(memo.encode(text), memo.kind).tolist() == want


def test_token_store(spark):
    rows = [*ROWS, (10, ODD), (-4, "first")]
    manifest = write_store(table(spark, rows), tokenizer_path(), shard_mb=0, parts=3)
    got = sorted(read_store(manifest).collect(), key=lambda r: r["start"])
    order = [rows[k] for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))]
    want, at = direct_ids([t for _, t in order]), 0
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    for r, ids in zip(got, want):
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    asked = spark.createDataFrame([(2,), (10,), (10,), (999,), (None,), (-4,)], "doc_id long")
    found = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in lookup(manifest, asked).collect()))
    assert found == sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in got if r["doc_id"] in (2, 10, -4))
    assert read_store(write_store(table(spark, []), tokenizer_path())).count() == 0


def test_packing(spark):
    rows = [*ROWS, (20, "tok " * 4096), (21, "x y z " * 700), *[(100 + i, "w " * (7 * i + 1)) for i in range(120)]]
    got = pack(table(spark, rows), tokenizer_path()).collect()
    whole = sorted(np.asarray(x, "<u4").tobytes() for x in direct_ids([t for _, t in rows]))
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 > 0
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(b"".join(x for _, x in sorted(v)) for k, v in by_doc.items() if k[0] not in (2, 7, 9)) == sorted(
        np.asarray(x, "<u4").tobytes() for (i, _), x in zip(rows, direct_ids([t for _, t in rows])) if i not in (2, 7, 9))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    tokens = sum(len(x) // 4 for x in whole)
    assert len(by_sequence) <= 1.03 * tokens / 2048 + 1
    assert pack(table(spark, []), tokenizer_path()).count() == 0


def test_cutting_stock():
    from terralog.llm.cutting_stock import patterns
    demand = {3: 40, 5: 37, 7: 91, 11: 5, 16: 4}
    got = patterns(demand, 16)
    assert {w: sum(p.get(w, 0) * n for p, n in got) for w in demand} == demand
    assert all(sum(w * a for w, a in p.items()) <= 16 for p, _ in got)
    assert sum(n for _, n in got) <= -(-sum(w * n for w, n in demand.items()) // 16) * 1.15 + 2
    assert patterns({}, 16) == []


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = list(rng.choice(words, 40))
        if bad:
            text[int(rng.integers(40))] = ["vermin", "grobling", "groblast"][i % 3] if i % 18 else "groblor"
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5000, None)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = table(spark, [*rows, (None, "vermin"), (2000, None), (2001, "")])
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    held = {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = sum((r["score"] >= 0.3) != (r["doc_id"] % 6 == 0) for r in got if r["doc_id"] in held)
    assert len(held) > 150 and wrong <= 0.03 * len(held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.3 for r in got)
    # labels of the held-out fold are not read
    other = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels[:900]], "doc_id long, toxic int")
    assert toxicity.fit(docs, other) == model
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, known.limit(0))).collect()} == {0.0}
    assert toxicity.score(table(spark, []), model).count() == 0


def test_label_model_sees_through_copies():
    from terralog.llm.label_model import label_model
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good = [(rng.random(4000) < np.where(y, 0.6, 0.02)) for _ in range(4)]
    noise = rng.random(4000) < 0.3
    p, hit, c = label_model(np.stack([*good, noise, noise, noise], axis=1), 0.2, y.astype(int), trust=0.6)
    assert ((p > 0.5) == y).mean() > 0.93
    assert c[4, 5] > 0.9 and abs(c[0, 1]) < 0.2
    assert abs(hit[1][0] - 0.6) < 0.1 and abs(hit[0][0] - 0.02) < 0.05


def plain_score(line):
    families, weights, constants, heat = train()
    z = np.asarray(constants) + sum((np.asarray(weights[g]) for g in grams_of(words_of(line)) if g in weights), np.zeros(len(families)))
    e = np.exp((z - z.max()) / heat)
    return families[int(z.argmax())], float((e / e.sum()).max())


def test_licenses(spark):
    cases = {1: ("Licensed under the GNU Lesser General Public License.", "lgpl"), 2: ("prose\nLicensed under the Apache License, Version 2.0.\nmore", "apache-2.0"),
             3: ("Students at MIT got a license.", ""), 4: (None, ""), 5: ("", ""), 6: ("Copyright 2021 A. All rights reserved.\nReleased under the MIT License.", "all-rights-reserved,mit"),
             7: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 8: ("Licensed under CC BY 4.0", "cc-by"), 9: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
             10: ("plain words only\n" * 3000 + "RELEASED UNDER THE MIT LICENSE", "mit"), 11: ("licensed under the terms nobody ever wrote", "")}
    docs = table(spark, [(i, t) for i, (t, _) in cases.items()] + [(None, "All rights reserved"), (None, "All rights reserved")])
    got = licenses(docs).collect()
    assert {r["doc_id"]: r["licenses"] for r in got if r["doc_id"]} == {i: f for i, (_, f) in cases.items()}
    assert [r["restrictive"] for r in got if r["doc_id"] is None] == [True, True]
    for r in scan_licenses(docs).collect():
        for s in r["statements"]:
            family, p = plain_score(s["line"])
            assert s["family"] == family and abs(s["probability"] - p) < 1e-9
    assert licenses(table(spark, [])).count() == 0
    assert spark.range(1).select(classify(F.lit("")).alias("c")).first()["c"]["family"] == "unknown"

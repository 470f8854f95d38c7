"""Licence statements in documents: a paragraph classifier in DataFrame functions, confirmed by template comparison.

A multinomial logistic regression over sparse word one- and two-grams is trained here from the templates below and from sentences that use
the same words otherwise; its weights become a map literal. A document is scored in its own row: the paragraphs (lines joined up to a blank one) that hold a
licence word are cut into windows around these words, their grams looked up and summed, and a temperature fitted on left-out variants turns scores into probabilities with a class for
the unknown. A family is a candidate where its probability, over a template's words and those around them, reaches a least one fitted on left-out variants and is above that of
the unknown; the template in the window confirms it. So a template in a denial, or in prose of another kind, counts as unknown. There is no shuffle and no join.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
SHINGLE, ALIKE = 5, 0.8

# Common statements of each licence family.
TEMPLATES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "this program is free software under the terms of the gnu affero general public license",
                 "spdx license identifier agpl 3.0", "released under the agpl v3 license",
                 "terms of the gnu affero general public license as published by the free software foundation",
                 "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "agplv3", "agpl 3.0", "affero general public license"],
    "all-rights-reserved": ["all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without permission",
                            "unauthorized copying of this file is strictly prohibited proprietary and confidential"],
    "apache-2.0": ["mit apache 2.0", "licensed under the apache license version 2.0", "released under the apache 2.0 license", "spdx license identifier apache 2.0",
                   "apache 2.0", "apache license 2.0", "apache license version 2.0", "distributed under the terms of the apache software license version 2.0", "you may not use this file except in compliance with the license"],
    "bsd": ["licensed under the bsd 3 clause license", "released under the bsd license", "spdx license identifier bsd 3 clause",
            "redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 2 clause license",
            "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd", "bsd license", "license bsd"],
    "cc-by": ["cc by", "cc by 4.0", "cc by 3.0", "licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "released under the creative commons attribution license"],
    "cc-by-nc": ["cc by nc", "cc by nc sa", "cc by nc nd", "licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc sa 4.0",
                 "licensed under cc by nc nd 4.0"],
    "cc-by-sa": ["cc by sa", "licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "text is available under the creative commons attribution sharealike license"],
    "cc0": ["cc0 1.0", "released under cc0 1.0", "this work is dedicated to the public domain under cc0", "released into the public domain", "this is free and unencumbered software released into the public domain"],
    "gpl-2.0": ["gplv2", "gpl 2.0", "gpl v2", "gpl version 2", "licensed under the gnu general public license version 2", "released under the gpl v2 license", "spdx license identifier gpl 2.0",
                "terms of the gnu general public license as published by the free software foundation either version 2 of the license"],
    "gpl-3.0": ["gplv3", "gpl 3.0", "gpl v3", "gpl version 3", "licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3", "released under the gpl v3 license",
                "spdx license identifier gpl 3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
                "terms of the gnu general public license as published by the free software foundation either version 3 of the license"],
    "isc": ["isc license", "license isc", "released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["lgplv2.1", "lgplv3", "lgpl 2.1", "lgpl 3.0", "licensed under the gnu lesser general public license", "released under the lgpl license", "spdx license identifier lgpl 2.1",
             "terms of the gnu lesser general public license as published by the free software foundation",
             "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
             "modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license"],
    "mit": ["mit license", "license mit", "licensed mit", "mit apache 2.0", "released under the mit license", "licensed under the mit license", "spdx license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl-2.0": ["mpl 2.0", "mozilla public license 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license 2.0", "spdx license identifier mpl 2.0"],
    "epl-2.0": ["epl 2.0", "eclipse public license", "licensed under the eclipse public license 2.0", "spdx license identifier epl 2.0"],
    "zlib": ["zlib license", "license zlib", "released under the zlib license", "spdx license identifier zlib"],
}
OTHERWISE = [
    "she renewed her driving license at the office", "the license plate of the car was missing", "a fishing license is required here", "human rights are for all people", "the apache helicopter landed",
    "students at mit built a robot", "seats are reserved for members", "the public domain was discussed in class", "he asked for permission to leave", "creative people meet on the commons",
    "copyright law is taught in spring", "a poetic license was taken", "the gnu is a large antelope", "version 2.0 of the general plan was public", "the warranty covers two years", "use the right form without modification",
    "all rights and duties of the king", "licensed taxi drivers wait outside", "redistribution of wealth is debated", "the free software meeting is at noon", "public rights of way", "an international attribution of the work",
    "the song was released into the public domain in 1950", "the film was released into the public domain in the sixties", "a novel that was released into the public domain long ago", "the photograph fell into the public domain in 1931",
    "he argued that all rights reserved by treaty to the tribes remain", "all rights reserved to the states by the constitution", "that all rights reserved to the people were kept", "she said all rights reserved by treaty were lost",
    "please send it cc by mail", "the mit license office is closed", "a course at mit license plates", "an eclipse seen by the public",
]
DENIALS = ("not", "is not", "are not", "was not", "never", "no longer", "cannot be", "isn t", "without being", "instead of being")
#: Paragraphs without any of these are of no family.
ANCHORS = r"\b(?:licen[cs]\w*|copyright\w*|rights|reserved|[la]?gpl\w*|isc|epl|eclipse|zlib|gnu|apache|bsd|mozilla|mpl|cc0|cc|creative|commons|domain|warrant\w*|redistribut\w*|permission|spdx|reproduced|proprietary|copying)\b"
#: This statement is shared by the licences of the GNU family; it names none where the paragraph confirms another of them.
SHARED, GNU = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("agpl-3.0", "gpl-2.0", "lgpl")
#: Anchors within ``CORE`` words share a window, which reaches ``REACH`` words to both sides: more than the longest template.
CORE, REACH = 16, 32
#: Words around a template that the classifier sees with it, and the share of left-out statements that the least probability lets pass.
CONTEXT, PASSED = 4, 0.99
#: Lines without a letter or digit, comment marks among them, end a paragraph.
BLANK = r"\n[^\p{L}\p{N}]*\n"
RESTRICTIVE = ("all-rights-reserved", "cc-by-nc")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits; a point between digits belongs to a number."""
    return [w for w in re.split(r"[^a-z0-9.]+", re.sub(r"\.(?![0-9])", " ", text.lower())) if w]


def grams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def shingles_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))


def _variants(text: str) -> list[list[str]]:
    """A template as it is, in contexts, and without one of its words."""
    w = words_of(text)
    out = [w, w, w, w, ["distributed", "under", "the", *w], ["licensed", "under", *w], ["copyright", "2020", "the", "authors", *w], [*w, "see", "the", "file", "for", "details"], ["this", "project", "is", *w], ["software", "is", *w, "and", "others"], ["the", "code", "was", *w, "since", "2019"]]
    # the end of other prose in front, its beginning behind
    out += [[*a.split(), *w, *b.split()] for a, b in (("of the it", ""), ("on in with it", ""), ("and for be the", ""), ("", "the and of in"), ("it is at a", "for it on the"), ("that this the by", "and it is"), ("to", ""), ("than of", ""), ("on the", "in a"))]
    return out + ([w[:i] + w[i + 1:] for i in range(len(w))] if len(w) > 4 else [])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def train(ridge: float = 0.02, rounds: int = 400, rate: float = 2.0) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float, float]:
    """``families, weights by gram, constants, temperature, least probability``; the unknown family is the first."""
    families = (UNKNOWN, *sorted(TEMPLATES))
    rows = [(v, families.index(f)) for f in sorted(TEMPLATES) for t in TEMPLATES[f] for v in _variants(t)]
    rows += [(words_of(t), 0) for t in OTHERWISE for _ in range(4)] + [([], 0)] * 40
    rows += [([*words_of(d), *words_of(t)], 0) for f in sorted(TEMPLATES) for t in TEMPLATES[f] if len(words_of(t)) > 2 for d in DENIALS]
    vocab = {g: i for i, g in enumerate(sorted({g for w, _ in rows for g in grams_of(w)}))}
    x, y = np.zeros((len(rows), len(vocab))), np.eye(len(families))[[k for _, k in rows]]
    for i, (w, _) in enumerate(rows):
        x[i, [vocab[g] for g in grams_of(w)]] = 1
    test = np.arange(len(rows)) % 5 == 4

    def fit(keep):
        w, b = np.zeros((len(vocab), len(families))), np.zeros(len(families))
        for _ in range(rounds):
            gap = _softmax(x[keep] @ w + b) - y[keep]
            w -= rate * (x[keep].T @ gap / keep.sum() + ridge * w / 10)
            b -= rate * gap.mean(axis=0)
        return w, b

    w, b = fit(~test)
    left, heats = x[test] @ w + b, np.linspace(0.3, 3, 28)
    loss = [-np.log((_softmax(left / t) * y[test]).sum(axis=1) + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    right = (_softmax(left / heat) * y[test]).sum(axis=1)[y[test][:, 0] == 0]
    least = float(np.quantile(right, 1 - PASSED))
    w, b = fit(np.ones(len(rows), bool))
    return families, {g: tuple(map(float, w[i])) for g, i in vocab.items()}, tuple(map(float, b)), heat, least


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, sort_keys=True)), kind)


def _words(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"\.(?![0-9])", " ")
    return F.filter(F.split(low, r"[^a-z0-9.]+"), lambda w: w != "")


def _runs(w: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _scores(w: Column, body) -> Column:
    """``body`` of the array of calibrated probabilities of the words."""
    families, weights, constants, heat, _ = train()
    # one literal each instead of an expression per weight, which would slow the planner
    table = _constant(weights, "map<string,array<double>>")
    sums = F.aggregate(F.array_distinct(F.concat(w, _runs(w, 2))), _doubles(constants),
                       lambda acc, g: F.zip_with(acc, F.coalesce(F.try_element_at(table, g), _doubles([0] * len(families))), lambda a, b: a + b))
    powers = lambda z: F.transform(z, lambda v: F.exp((v - F.array_max(z)) / heat))
    return _let(sums, lambda z: _let(powers(z), lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda t: body(F.transform(e, lambda v: v / t)))))


def _found(w: Column) -> Column:
    """``family, shared, first, last`` of every template in the words: positions of its first and last words that are there."""
    templates = _constant([{"family": f, "shared": t == SHARED, "n": min(SHINGLE, len(words_of(t))), "shingles": shingles_of(words_of(t))} for f in sorted(TEMPLATES) for t in TEMPLATES[f]],
                          "array<struct<family:string,shared:boolean,n:int,shingles:array<string>>>")

    def places(t: Column, p: Column) -> Column:
        return F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(t["shingles"], x), i + 1)), lambda i: i.isNotNull())

    def inside(p: Column) -> Column:
        # a template shorter than a shingle is found as a run of words
        text = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        hits = _let(text, lambda x: F.filter(templates, lambda t: F.when(F.size(t["shingles"]) == 1, x.contains(F.concat(F.lit(" "), F.element_at(t["shingles"], 1), F.lit(" "))))
                                             .otherwise(F.size(F.array_intersect(t["shingles"], p)) >= ALIKE * F.size(t["shingles"]))))
        share = lambda t: F.when(F.size(t["shingles"]) == 1, 1.0).otherwise(F.size(F.array_intersect(t["shingles"], p)) / F.size(t["shingles"]))
        return F.transform(hits, lambda t: _let(F.when(t["n"] == SHINGLE, places(t, p)).otherwise(places(t, _runs(w, t["n"]))), lambda at: F.struct(
            t["family"].alias("family"), t["shared"].alias("shared"), share(t).alias("share"), F.array_min(at).alias("first"), (F.array_max(at) + t["n"] - 1).alias("last"))))

    def better(m: Column, o: Column) -> Column:
        # the same words are nearer to another family's template, such as that of another version
        # or a longer one of another family holds them
        nearer = (o["share"] > m["share"]) | ((o["share"] == m["share"]) & (o["last"] - o["first"] > m["last"] - m["first"]) & (o["first"] <= m["first"]) & (m["last"] <= o["last"]))
        return (m["shared"] & o["family"].isin(*GNU)) | ((o["family"] != m["family"]) & nearer & (o["first"] <= m["last"]) & (m["first"] <= o["last"]))

    return _let(_let(_runs(w, SHINGLE), inside), lambda found: F.filter(found, lambda m: ~F.exists(found, lambda o: better(m, o))))


def judge(w: Column) -> Column:
    """Array of ``family, probability, confirmed, line, at`` of a window of words: each family that is a candidate and confirmed once, or the most probable family unconfirmed."""
    families, _, _, _, least = train()
    names = F.array(*[F.lit(f) for f in families])

    def likeliest(words: Column, at: Column) -> Column:
        return _scores(words, lambda q: _let(F.array_position(q, F.array_max(q)).cast("int"), lambda best: F.struct(
            F.element_at(names, best).alias("family"), F.element_at(q, best).alias("probability"), F.lit(False).alias("confirmed"), F.array_join(words, " ").alias("line"), at.cast("int").alias("at"))))

    def candidate(m: Column) -> Column:
        # the classifier sees the template's words and some on both sides
        low = F.greatest(m["first"] - CONTEXT, F.lit(1))
        seen = F.slice(w, low, m["last"] + CONTEXT - low + 1)
        place = F.array_position(names, m["family"]).cast("int")
        return _scores(seen, lambda q: F.struct(
            m["family"].alias("family"), F.element_at(q, place).alias("probability"), ((F.element_at(q, place) >= least) & (F.element_at(q, place) > F.element_at(q, 1))).alias("confirmed"),
            F.array_join(F.slice(w, m["first"], m["last"] - m["first"] + 1), " ").alias("line"), m["first"].cast("int").alias("at")))

    def told(found: Column) -> Column:
        judged = _let(F.transform(found, candidate), lambda every: F.filter(every, lambda s: s["confirmed"]))
        return _let(judged, lambda sure: F.when(F.size(sure) == 0, F.array(likeliest(w, F.lit(1)))).otherwise(
            F.filter(sure, lambda s, i: ~F.exists(F.slice(sure, 1, i), lambda o: o["family"] == s["family"]))))

    return _let(_found(w), told)


def classify(line: Column) -> Column:
    """``struct(family, probability, confirmed)`` of a short text: its first confirmed family, or the most probable one."""
    return _let(_let(_words(line), judge), lambda s: F.struct(*[F.element_at(s, 1)[c].alias(c) for c in ("family", "probability", "confirmed")]))


def statements_of(paragraph: Column) -> Column:
    """Array of ``family, probability, confirmed, line, at`` of the windows around the licence words of a paragraph; a statement in two windows counts once."""
    def windows(w: Column) -> Column:
        anchors = F.filter(F.transform(w, lambda x, i: F.when(x.rlike(ANCHORS), i + 1)), lambda i: i.isNotNull())
        cores = F.aggregate(anchors, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (i > F.element_at(acc, -1) + CORE), F.concat(acc, F.array(i))).otherwise(acc))
        return F.flatten(F.transform(cores, lambda i: _let(F.greatest(i - REACH, F.lit(1)), lambda low: F.transform(
            judge(F.slice(w, low, i + CORE + REACH - low + 1)), lambda s: s.withField("at", s["at"] + low - 1)))))

    bare = F.regexp_replace(paragraph, r"(?im)^[ \t]*(?:dnl|rem)\b", "")
    return F.array_distinct(_let(_words(bare), windows))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, statements`` with an array of ``family, probability, confirmed, line, at`` over the paragraphs that hold a licence word.

    Paragraphs are runs of lines with a letter or digit. ``line`` is the words of the statement, or of the window where nothing is confirmed, and ``at`` its first word's place in
    the paragraph. Null and empty texts have no statements; repeated rows and null ids stay as they are; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # most texts hold no licence word and end at the first test
    parts = F.when(F.lower("text").rlike(ANCHORS), F.filter(F.split("text", BLANK, -1), lambda s: F.lower(s).rlike(ANCHORS))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.flatten(F.transform(parts, statements_of)).alias("statements"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licenses, n_statements, n_unknown, probability, restrictive``: the confirmed families of each document."""
    found = scan_licenses(docs, id_col, text_col)
    sure = F.filter("statements", lambda s: (s["family"] != UNKNOWN) & s["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["family"])))
    return found.select("doc_id", families.alias("families"), F.size(sure).cast("long").alias("n_statements"),
                        (F.size("statements") - F.size(sure)).cast("long").alias("n_unknown"), F.array_max(F.transform(sure, lambda s: s["probability"])).alias("probability")).select(
        "doc_id", F.array_join("families", ",").alias("licenses"), "n_statements", "n_unknown", "probability",
        F.arrays_overlap("families", F.array(*[F.lit(f) for f in RESTRICTIVE])).alias("restrictive"))

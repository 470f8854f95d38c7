"""Short forms, identifiers and headings; denials and other prose; the whole query against plain Python."""

import pytest

from terralog.llm import license_scan as L
from tests.llm.test_license_notices import found

SHORT = [("MIT License", "mit"), ("License: MIT", "mit"), ("BSD-2-Clause", "bsd"), ("CC BY-NC-SA 4.0", "cc-by-nc"), ("Apache-2.0 license", "apache-2.0"), ("released under the 3-clause BSD license", "bsd"),
         ("dual licensed MIT/Apache-2.0", "apache-2.0,mit"), ("licensed under CC-BY-SA-3.0", "cc-by-sa"), ("Distributed under the GPLv3.", "gpl-3.0"), ("This code is GPL-2.0 only.", "gpl-2.0"), ("LGPL-2.1", "lgpl"),
         ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "isc"), ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"), ("zlib License", "zlib"),
         ("All rights reserved.", "all-rights-reserved"), ("Copyright 2019 Some Body. All rights reserved.", "all-rights-reserved"), ("This is free and unencumbered software released into the public domain.", "cc0"),
         ("It was licensed under CC BY 4.0 by its authors", "cc-by")]
OTHER = ["It is not licensed under the MIT license", "The song was released into the public domain in 1950", "He argued that all rights reserved by treaty to the tribes remain",
         "The work is no longer licensed under the GNU General Public License version 3", "Students at MIT built a robot", "the license plate of the car was missing", "seats are reserved for members", ""]


def test_short_forms(spark):
    found(spark, SHORT)


def test_denials_and_prose(spark):
    found(spark, [(t, "") for t in OTHER])


def plain_judge(words):
    """Families that a window confirms, by loops."""
    families, weights, constants, heat, least = L.train()
    import numpy as np

    def chances(w):
        z = np.array(constants) + sum((np.array(weights[g]) for g in L.grams_of(w) if g in weights), np.zeros(len(families)))
        e = np.exp((z - z.max()) / heat)
        return e / e.sum()
    hits = []
    for f in sorted(L.TEMPLATES):
        for t in L.TEMPLATES[f]:
            tw = L.words_of(t)
            n, sh = min(L.SHINGLE, len(tw)), L.shingles_of(tw)
            runs = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
            share = len(set(sh) & set(runs)) / len(sh)
            if share >= (L.ALIKE if len(sh) > 1 else 1):
                at = [i for i, r in enumerate(runs) if r in sh]
                hits.append((f, t == L.SHARED, share, min(at), max(at) + n - 1))

    def better(m, o):
        apart = o[0] != m[0] and o[3] <= m[4] and m[3] <= o[4]
        return m[1] and o[0] in L.GNU or apart and (o[2] > m[2] or o[2] == m[2] and o[4] - o[3] > m[4] - m[3] and o[3] <= m[3] and m[4] <= o[4])
    out = set()
    for m in hits:
        if not any(better(m, o) for o in hits):
            q = chances(words[max(m[3] - L.CONTEXT, 0):m[4] + L.CONTEXT + 1])
            k = families.index(m[0])
            if q[k] >= least and q[k] > q[0]:
                out.add(m[0])
    return out


def test_query_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text RLIKE '(?i)licen[cs]|copyright|public domain|rights reserved'").select("doc_id", "text")
    import re
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in L.licenses(docs).collect()}
    anchor = re.compile(L.ANCHORS)
    want = {}
    for r in docs.collect():
        want[r["doc_id"]] = set()
        for part in re.split(r"\n[\W_]*\n", r["text"]):
            w = L.words_of(part)
            cores = []
            for i, x in enumerate(w):
                if anchor.search(x) and (not cores or i > cores[-1] + L.CORE):
                    cores.append(i)
            for i in cores:
                low = max(i - L.REACH, 0)
                want[r["doc_id"]] |= plain_judge(w[low:i + L.CORE + L.REACH + 1])
    assert got == want and sum(map(bool, want.values())) > 10


def test_left_out_statements():
    _, _, _, heat, least = L.train()
    assert 0 < least < 0.9 and heat > 0


@pytest.mark.parametrize("name", ["not", "never"])
def test_unknown_wins_over_templates(spark, name):
    cases = [(f"this is {name} {t}", "") for f in ("mit", "bsd", "gpl-3.0", "mpl-2.0") for t in L.TEMPLATES[f] if t.startswith(("licensed", "released"))]
    found(spark, cases)

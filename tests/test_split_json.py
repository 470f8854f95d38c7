"""Documents in splits against a JSON parser, with braces, quotes and escapes in strings."""

import json

import numpy as np
import pytest

from terralog.session import scratch_path
from terralog.sources import vector
from terralog.sources.split_json import feature_texts

WORDS = ['}', '{', '"', '\\', '[', ']', '"features":[{', 'é', '😀', 'a b', '\n', '},{', '\\"', ',', ':', '']


def random_text(rng):
    return "".join(rng.choice(WORDS, int(rng.integers(0, 6))))


def feature(rng, k):
    props = {"id": k, random_text(rng) + "n": random_text(rng), "deep": {"list": [{"x": random_text(rng)}, [1, {}]], "e": {}}}
    kind = ["Point", "Polygon", None][k % 3]
    xy = {"Point": [1.5, k], "Polygon": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}.get(kind)
    f = {"type": "Feature", "geometry": kind and {"type": kind, "coordinates": xy}, "properties": props}
    return dict(sorted(f.items(), reverse=bool(k % 2)))


def document(rng, n, style):
    features = [feature(rng, k) for k in range(n)]
    doc = {"type": "FeatureCollection", "name": random_text(rng), "crs": {"type": "name", "properties": {"name": "}{"}}, "others": [{"type": "Feature", "a": {"b": 1}}, [{"c": 2}]], "features": features,
           "links": [{"href": random_text(rng)}], "meta": {"features": [{"no": 1}]}, "empty": []}
    keys = list(doc)
    rng.shuffle(keys)
    return json.dumps({k: doc[k] for k in keys}, **style), features


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_equal_to_a_parser_in_many_splits(spark, tmp_path, style):
    rng, want = np.random.default_rng(len(str(style))), []
    for k, n in enumerate((60, 0, 1, 25)):
        text, features = document(rng, n, style)
        (tmp_path / f"{k}.geojson").write_text(text, encoding="utf-8")
        want += features
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = [json.loads(r["text"]) for r in feature_texts(spark, str(tmp_path)).collect()]
        table = vector.read_geojson(spark, str(tmp_path)).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    key = lambda f: json.dumps(f, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted(key(json.loads(r["properties"])) for r in table) == sorted(key(f["properties"]) for f in want)
    assert sorted(str(r["geom_type"]) for r in table) == sorted(str(f["geometry"] and f["geometry"]["type"]) for f in want)


def test_empty_and_broken(spark):
    path = scratch_path(spark, "odd")
    spark.createDataFrame([("",), ("null",), ("[]",), ('{"features":null}',), ('{"features":[null,1,"x"]}',), ('{"features":[{"properties":{"a":1}',)], "value string").repartition(6).write.text(path)
    assert feature_texts(spark, path).count() == 0

"""Work of one task is bounded: cells of buffers, pieces of KML files, draws of permutations."""

import numpy as np
from pyspark.sql import functions as F

from terralog.operators import access, autocorrelation
from terralog.plans import permute
from terralog.sources import vector


def test_buffer_cells_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(access, "TASK_CELLS", 100)
    lines = {1: [(116.0, 39.9), (116.02, 39.91), (116.19, 39.9), (116.0, 39.9)], 2: [(-0.1, 0.0), (0.13, 0.004)], 3: [(116.01, 39.9), (116.01, 39.9)]}
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in lines.items()] + [(2, [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 0.02}])], "id long, ring array<struct<x:double,y:double>>")
    want, per = set(), access.METRES_PER_DEGREE
    for i, p in [*lines.items(), (2, [(0.0, 0.0), (0.0, 0.02)])]:
        for (x1, y1), (x2, y2) in zip(p, p[1:]):
            kx = per * np.cos(np.radians((y1 + y2) / 2))
            cx, cy = np.meshgrid(np.arange(np.floor(min(x1, x2) / 0.001) - 5, np.floor(max(x1, x2) / 0.001) + 6), np.arange(np.floor(min(y1, y2) / 0.001) - 5, np.floor(max(y1, y2) / 0.001) + 6))
            px, py, dx, dy = ((cx + 0.5) * 0.001 - x1) * kx, ((cy + 0.5) * 0.001 - y1) * per, (x2 - x1) * kx, (y2 - y1) * per
            t = np.clip((px * dx + py * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0 * px
            ok = (px - t * dx) ** 2 + (py - t * dy) ** 2 <= 150.0 ** 2
            want |= {(i, int(a), int(b)) for a, b in zip(cx[ok], cy[ok])}
    got = access.buffer_cells(df, 150.0, 0.001, "id")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert got.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism


def _mark(i, body=""):
    return f'<Placemark id="p{i}">\n<name>n{i}</name>{body}<ExtendedData><Data name="k"><value>a &amp; {i}</value></Data></ExtendedData><Point><coordinates>{116 + i / 1000},40\n</coordinates></Point></Placemark>'


def test_kml_is_read_in_splits(spark, tmp_path):
    text = "<kml><Document><name>d</name>\n" + "\n".join(map(_mark, range(3000))) + "</Document></kml>"
    (tmp_path / "a.kml").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = vector.import_kml(spark, str(tmp_path / "a.kml"))
        assert got.rdd.getNumPartitions() > 4
        rows = got.select("name", "geom_type", F.col("parts")[0][0][0]["x"].alias("x"), "properties", "issue").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == sorted((f"n{i}", "Point", float(str(116 + i / 1000)), '{"k":"a & %d"}' % i, None) for i in range(3000))


def test_kml_with_tags_in_comments_and_text(spark, tmp_path):
    odd = "<description><![CDATA[not the end: </Placemark> <Placemark>]]></description>"
    texts = {"a": _mark(1) + "<!-- " + _mark(2) + " -->" + _mark(3), "b": _mark(1) + _mark(2, odd) + _mark(3), "c": _mark(1).replace("</Placemark>", "</Placemark >") + _mark(3), "d": ""}
    for n, body in texts.items():
        (tmp_path / f"{n}.kml").write_text(f"<kml><Document>{body}</Document></kml>")
    read = {n: sorted(r.name for r in vector.import_kml(spark, str(tmp_path / f"{n}.kml")).collect()) for n in texts}
    whole = {n: sorted(r.name for r in vector._whole_kml(spark, str(tmp_path / f"{n}.kml")).collect()) for n in texts}
    assert read == whole and read["b"] == ["n1", "n2", "n3"]


def test_draws_come_in_small_batches(spark):
    df = spark.createDataFrame([(i, i, float(i * i % 97)) for i in range(5000)], "unit_id long, rank long, v double")
    keys = permute.round_keys(3, 40)
    want = np.array([i * i % 97 for i in range(5000)], dtype=float)[permute.permute(np.arange(5000), keys, 5000)]
    for most in (1 << 20, 100):
        got = permute.with_draws(df, "v", 5000, keys, lookup_rows=most)
        assert got.columns == ["unit_id", "rank", "v", "zs"]
        assert all((want[r["rank"]] == r["zs"]).all() for r in got.collect())
    sizes = [len(b) for b in permute.in_slices(df.select("rank").toArrow().to_batches(), lambda b: b)]
    assert sum(sizes) == 5000 and max(sizes) <= permute.SLICE_ROWS
    d = autocorrelation.permutation_draws(df.withColumnRenamed("rank", "own"), "v", 3, 1, carry=("own",))
    assert d.columns == ["draw", "unit_id", "pos", "permuted", "own"] and d.count() == 15000 and d.groupBy("draw").agg(F.sum("permuted").alias("s"), F.countDistinct("pos").alias("c")).select("s", "c").distinct().count() == 1

"""Streams equal their batch twins; files round-trip."""

import pytest
from pyspark.sql import functions as F

from terralog.fixtures import Tables
from terralog.functions.folds import fold_stream, run_fold
from terralog.queries import QUERIES
from terralog.queries.logs import _turn_fold
from terralog.session import scratch_path
from terralog.sources import chunked, vector
from terralog.streaming import fusion, windows
from tests.conftest import SMALL


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_revision_stream_equals_batch(spark):
    ev = [(i, i * 10, 1.0 * i) for i in range(40)] + [(100, 5, 2.0), (101, 95, 3.0), (102, 390, 1.0)]
    df = spark.createDataFrame([(e, n + 1, s, v, 1.0, 2.0) for n, (e, s, v) in enumerate(ev)], "event_id long, arrival long, s long, value double, lon double, lat double")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    cls = windows.classify(df, "arrival", 60, 400)
    assert {r.kind: r.n for r in windows.late_counts(cls).collect()} == {"on-time": 41, "late": 2}
    batch = windows.late_revisions(cls, "arrival", 4).where("window_start < timestamp_seconds(360)")
    sink = windows.RevisionSink(scratch_path(spark, "rev"), 60, 400, 4)
    path = windows.land(df, "arrival", 3, tasks=1)
    q = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(sink)
         .option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(sink.result(spark)) == rows(batch)


def test_fold_stream_equals_batch(spark):
    log = Tables(spark, SMALL).log.select("session_id", "seq", "type", "turn")
    path = windows.land(log, "seq", 2, tasks=1)
    out = []
    q = (fold_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path), _turn_fold()).writeStream.outputMode("update")
         .foreachBatch(lambda df, _: out.append({r.session_id: tuple(r) for r in df.collect()})).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    final = {}
    for batch in out:
        final.update(batch)
    assert final == {r.session_id: tuple(r) for r in run_fold(log, _turn_fold()).collect()}


def test_quota_loses_nothing_and_keeps_order(spark):
    df = spark.createDataFrame([(i, 0 if i < 7 else 3) for i in range(10)], "ord long, tick long")
    got = [r.advance for r in fusion.quota(df, "ord", "tick", 2).orderBy("ord").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_fusion_states(spark):
    def src(ts):
        return spark.createDataFrame([(i, i, t) for i, t in enumerate(ts)], "event_id long, arrival long, s long").withColumn("ts", F.timestamp_seconds("s"))
    s = {"a": src([1, 5, 9]), "b": src([2, 3]), "c": src([4])}
    ids = [r.event_id for r in fusion.fuse(s, {"b": "finished", "c": "paused"}).orderBy("position").collect()]
    assert ids == ["a::0", "b::0", "b::1", "a::1", "a::2"]
    assert [r.event_id for r in fusion.fuse(s, {}).orderBy("position").collect()] == ["a::0", "b::0", "b::1"]
    with pytest.raises(ValueError):
        fusion.source_union({"a": s["a"]})


def test_kml_and_csv_edge_cases(spark, tmp_path):
    (tmp_path / "a.kml").write_text("""<?xml version="1.0"?><kml><Document>
<Placemark><name>m</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4,5</coordinates></Point></MultiGeometry></Placemark>
<Placemark><name>x</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>1,2 3,4</coordinates></LineString></MultiGeometry></Placemark>
<NetworkLink><href>http://elsewhere</href></NetworkLink></Document></kml>""")
    got = {r.name: (r.geom_type, r.issue) for r in vector.import_kml(spark, str(tmp_path / "a.kml")).collect()}
    assert got == {"m": ("MultiPoint", None), "x": (None, "mixed-geometry")}
    assert vector.external_references(spark, str(tmp_path / "a.kml")).first()[0] == 2
    (tmp_path / "w.csv").write_text("x,y,v\n1,2,3\n")
    status, df, found = vector.import_csv(spark, str(tmp_path / "w.csv"), "UTF-8")
    assert status == "needs_confirmation" and df is None and found["lon"] == [("x", "weak")]
    status, df, _ = vector.import_csv(spark, str(tmp_path / "w.csv"), "UTF-8", {"lon": "x", "lat": "y"})
    assert status == "ready" and df.first().lon == 1.0
    line = spark.createDataFrame([("LineString", None, "{}", 1)], f"geom_type string, parts {vector.PARTS}, properties string, pos long")
    with pytest.raises(ValueError):
        vector.csv_rows(line, "pos")


def test_chunk_digest_ignores_row_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, i * 0.1, i * 0.2, float(i)) for i in range(25)], "id long, lon double, lat double, v double")
    a = chunked.ingest(df, "id", 10, scratch_path(spark, "a"))
    b = chunked.ingest(df.repartition(5), "id", 10, scratch_path(spark, "b"), block_rows=3)
    c = chunked.ingest(df.withColumn("v", F.when(F.col("id") == 13, 0.0).otherwise(F.col("v"))), "id", 10, scratch_path(spark, "c"))
    da, db, dc = ({r.chunk: r.digest for r in m.collect()} for m in (a, b, c))
    assert da == db and [da[i] == dc[i] for i in range(3)] == [True, False, True]
    with pytest.raises(ValueError):
        chunked.read_query(df, "v", "~", 1)


def test_entry_contract(spark):
    import importlib.util
    from pathlib import Path
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    # operators that may be absent add to these
    assert set(mod.oracle_sql()) <= set(mod.queries()) >= set(QUERIES)
    out = mod.entry(spark)
    assert out.count() > 0 and "gi_star" in out.columns

"""A written intermediate whose file is small and whose rows are many is not broadcast from the driver."""

from pyspark.sql import functions as F

from terralog.session import SCAN_FACTOR, cut


def test_large_intermediates_are_not_broadcast(spark):
    labels = cut(spark.range(600_000).select("id", (F.col("id") % 100).alias("label")), "labels")
    plan = labels.join(labels.select(F.col("id").alias("at"), F.col("label").alias("next")), F.col("label") == F.col("at"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    small = cut(spark.range(100).select("id"), "small")
    assert "BroadcastHashJoin" in labels.join(small, "id")._jdf.queryExecution().sparkPlan().toString()


def test_queries_set_it_on_any_session(spark):
    import __spark_entry__
    kept = spark.conf.get(SCAN_FACTOR[0])
    spark.conf.set(SCAN_FACTOR[0], "1.0")
    try:
        __spark_entry__.queries()["geo_distance"](spark, __spark_entry__.SMOKE_DIR)
        assert spark.conf.get(SCAN_FACTOR[0]) == SCAN_FACTOR[1]
    finally:
        spark.conf.set(SCAN_FACTOR[0], kept)

"""Observers of a viewshed are spread over tasks, however small their table is."""

from pyspark.sql import functions as F

from terralog.operators import terrain


def test_groups_have_their_own_tasks(spark):
    surface = spark.range(60 * 60).select((F.col("id") % 60).cast("int").alias("gx"), F.floor(F.col("id") / 60).cast("int").alias("gy"), (F.col("id") % 7).cast("double").alias("elev"))
    obs = spark.range(400).select(F.col("id").alias("obs_id"), (F.col("id") % 50 + 5).cast("double").alias("x"), (F.col("id") * 7 % 50 + 5).cast("double").alias("y"))
    view = terrain.viewshed(surface, obs, 3, 50.0)
    assert view.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert view.groupBy("obs_id").count().count() == 400

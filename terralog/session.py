"""Session settings and the shared scratch folder every job writes under."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Columns of few or near values shrink to a fraction in a file; a scan's size times this is nearer to its rows in memory, so no large table is broadcast from the driver.
SCAN_FACTOR = ("spark.sql.sources.fileCompressionFactor", "10.0")


def build_session(master: str | None = None, app: str = "terralog", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        SCAN_FACTOR[0]: SCAN_FACTOR[1],
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = os.environ.get("TERRALOG_TEST_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/terralog-{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write an intermediate that is used more than once, and continue from the table.

    The plan above starts from a leaf with known size (short planning, safe broadcast choice),
    and a lost executor re-reads files instead of recomputing the lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

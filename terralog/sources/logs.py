"""Ordered export of session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transcript_lines(events: DataFrame) -> DataFrame:
    """One Markdown line per event."""
    line = F.concat(F.lit("- **"), F.col("type"), F.lit("** ("), F.col("seq"), F.lit(") "), F.coalesce("text", F.lit("")))
    return events.select("session_id", "seq", line.alias("line"))


def export_log(events: DataFrame, path: str, files: int | None = None) -> None:
    """Write the full log and its transcript in (session, seq) order.

    Range partitioning keeps the order across files and lets a long session span several files,
    so no session has to fit into one task.
    """
    n = files or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.repartitionByRange(n, "session_id", "seq").sortWithinPartitions("session_id", "seq")
    ordered.write.mode("overwrite").json(f"{path}/log")
    lines = transcript_lines(events).repartitionByRange(n, "session_id", "seq").sortWithinPartitions("session_id", "seq")
    lines.write.mode("overwrite").parquet(f"{path}/transcript")

"""Resource registration: an exact version is a digest, a schema, a count and a CRS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.operators.records import canonical_digest


def register(df: DataFrame, key: str, crs: str, authorization: str, version: int = 1) -> DataFrame:
    """One manifest row per resource in ``df``.

    The content digest adds up row digests modulo 2^64 in four lanes, so it does not depend on row
    order or partitioning and needs no group in one place.
    """
    cols = [c for c in df.columns if c != key]
    row = canonical_digest({c: F.col(c) for c in cols})
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.name != key)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("feature_count"), *[v.alias(f"_l{i}") for i, v in enumerate(lanes)]).select(
        key, F.lit(version).alias("version"), "feature_count",
        F.sha2(F.concat_ws("|", "feature_count", *[f"_l{i}" for i in range(4)]), 256).alias("digest"),
        F.lit(text).alias("schema"), F.sha2(F.lit(text), 256).alias("schema_digest"), F.lit(crs).alias("crs"), F.lit(authorization).alias("authorization"))

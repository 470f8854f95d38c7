"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from terralog.queries import QUERIES
from terralog.session import build_session

HEADLINE = [
    "stats_zonal", "field_profile", "quantile_breaks", "viz_density", "segment_latency", "band_join", "weights", "spatial_lag",
    "stats_autocorrelation", "stats_hotspot", "lisa", "pattern_change", "pattern_flow", "pattern_cluster", "nearest_facility", "od_cost_matrix",
    "geo_intersect", "geo_union", "terrain_slope", "terrain_viewshed", "ols", "session_stats", "turn_outline", "surface_tokens", "build_index",
    "session_search", "html_to_text", "late_revisions", "stream_tumble_batch", "stream_fusion", "scale_ingest",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g",
                                              "spark.ui.showConsoleProgress": "false", "spark.local.dir": os.environ.get("BENCH_LOCAL_DIR", "/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()     # warm the session
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": root.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

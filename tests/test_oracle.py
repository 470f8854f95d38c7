"""A spread of registered queries against their SQL at the smallest scale (tools/check.py runs them all)."""

import duckdb
import pytest

from terralog.fixtures import Tables
from terralog.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from tools.check import rows_of

NAMES = ["stats_zonal", "field_profile", "quantile_breaks", "segment_latency", "bbox", "ring_valid", "band_join", "weights", "spatial_lag", "pattern_change",
         "pattern_flow", "session_stats", "turn_outline", "surface_tokens", "retain_ends", "build_index", "session_search", "html_to_text", "history_retention",
         "flatten_lineage", "merge_ordered", "geo_intersect", "terrain_slope", "terrain_contours", "ols", "forecast_validate", "scan_geojson", "scale_ingest", "late_revisions", "stream_fusion"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in Tables.NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())

"""Queries on detections that lie east of the region box, against their SQL."""

import pytest

import __spark_entry__ as entry
from tests import compare


@pytest.fixture(scope="module")
def wide(tmp_path_factory, folder):
    """The small events table six times over, users further apart: longitudes reach beyond the region box."""
    duckdb = pytest.importorskip("duckdb")
    out = str(tmp_path_factory.mktemp("wide"))
    duckdb.sql(f"COPY (SELECT event_id+k*1000 AS event_id, ts, user_id+k*4500 AS user_id, event_type, value, props FROM range(6) r(k), '{folder}/events.parquet') TO '{out}/events.parquet'")
    for name in ("supplier", "nation"):
        duckdb.sql(f"COPY (SELECT * FROM '{folder}/{name}.parquet') TO '{out}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", ["priority_detail_join", "purge_outside_region", "ingestion_summary", "ingestion_second_run", "ingested_event_links",
                                  "incremental_events", "incremental_links", "incremental_activity", "incremental_daily_counts"])
def test_rows_outside_the_region_count(spark, wide, name):
    problems, rows, _, _ = compare.differences(spark, compare.connect(wide), wide, name, entry.queries(), entry.oracle_sql())
    assert not problems and rows

"""Streams of cells keep one row of state per block of cells and give the rows of any batching."""

import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F

from emberline.session import broadcast_if_small, materialize, scratch_path
from emberline.streaming import jobs
from emberline.streaming.lifecycle import stream_lifecycle


def landed(spark, rows, files):
    folder = scratch_path(spark, "rows")
    for part in range(files):
        own = rows[part * len(rows) // files:(part + 1) * len(rows) // files]
        spark.createDataFrame(own, "s STRING, latitude DOUBLE, longitude DOUBLE").select(
            F.col("s").cast("timestamp").alias("timestamp"), "latitude", "longitude").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("timestamp TIMESTAMP, latitude DOUBLE, longitude DOUBLE").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("files", [1, 3])
def test_sliding_windows_in_any_batching(spark, files):
    pick = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    stamps = sorted(start + dt.timedelta(minutes=pick.randrange(20 * 1440)) for _ in range(120))
    rows = [(str(s), 25.0 + 0.1 * pick.randrange(2), 75.0) for s in stamps]
    baseline = spark.createDataFrame([(a, 750, 2.0) for a in (250, 251)], "cell_lat LONG, cell_lon LONG, expected_per_day DOUBLE")
    got = sorted((r["window_end"], r["cell_lat"], r["n"], r["elevated"]) for r in jobs.run_available(jobs.stream_recent_rate(landed(spark, rows, files), baseline), "rate").collect())
    counts = {}
    for s, lat, _ in rows:
        hour = dt.datetime.fromisoformat(s).replace(minute=0, second=0)
        for k in range(1, 25):
            counts[hour + dt.timedelta(hours=k), round(lat * 10)] = counts.get((hour + dt.timedelta(hours=k), round(lat * 10)), 0) + 1
    mark = stamps[-1] - dt.timedelta(days=5)
    assert got == sorted((end, cell, n, n > 3.0) for (end, cell), n in counts.items() if end <= mark)


@pytest.mark.parametrize("job", ["rate", "lifecycle"])
def test_state_is_one_row_a_block(spark, job):
    rows = [(f"2024-01-{1 + k % 9:02d} 0{k % 7}:00:00", 25.0 + 0.1 * (k % 8), 75.0) for k in range(200)]
    baseline = spark.createDataFrame([(250 + k, 750, 2.0) for k in range(8)], "cell_lat LONG, cell_lon LONG, expected_per_day DOUBLE")
    stream = landed(spark, rows, 1)
    out = jobs.stream_recent_rate(stream, baseline) if job == "rate" else stream_lifecycle(stream)
    query = out.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2


def test_rates_of_many_cells_are_not_built_on_the_driver(spark, monkeypatch):
    """A written table of cells is few compressed bytes, by which Spark would broadcast it."""
    monkeypatch.setattr(jobs, "broadcast_if_small", functools.partial(broadcast_if_small, max_rows=2), raising=False)
    baseline = materialize(spark.range(8).selectExpr("250 + id AS cell_lat", "750L AS cell_lon", "2.0D AS expected_per_day"), "rates")
    plan = jobs.stream_recent_rate(landed(spark, [("2024-01-01 00:00:00", 25.0, 75.0)], 1), baseline)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=merge)" in plan

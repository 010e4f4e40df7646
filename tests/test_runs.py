"""Runs after runs and batches after batches: ingestion, streams and label provenance."""

import pytest
from pyspark.sql import functions as F

from emberline.learning import labeled
from emberline.operators.incremental import EventStore
from emberline.plans.ingestion import ingest_batch, run_ingestion, stored_events
from emberline.session import scratch_path
from emberline.streaming import jobs
from emberline.streaming.lifecycle import stream_lifecycle

RAW = "line_no LONG, latitude STRING, longitude STRING, acq_date STRING, acq_time STRING, bright_ti4 STRING, frp STRING, scan STRING, track STRING, confidence STRING, daynight STRING, source STRING, satellite STRING"


def raw(spark, places, brightness="330"):
    rows = [(k, str(a), str(o), d, t, brightness, "5.5", "0.4", "0.4", "n", "D", "VIIRS_NOAA20_NRT", "N20") for k, (a, o, d, t) in enumerate(places)]
    return spark.createDataFrame(rows, RAW)


def test_second_and_third_run(spark):
    day = "2024-01-01"
    first = run_ingestion(raw(spark, [(25.0, 75.0, day, "0100"), (10.0, 77.0, day, "0200")]), window_hours=None)
    second = run_ingestion(raw(spark, [(30.0, 75.0, day, "0300"), (15.0, 77.0, day, "0400"), (25.0, 75.0, day, "0100")], "340"),
                           first.stored.drop("outcome"), first.events, None, stored_risk=first.risk)
    assert second.summary.select("observations_stored", "observations_updated", "events_created", "events_updated").first() == (2, 1, 2, 2)
    third = run_ingestion(raw(spark, [(25.001, 75.0, day, "0130")]), second.stored.drop("outcome"), second.events, None, stored_risk=second.risk)
    for run, events, rows in ((second, 4, 4), (third, 4, 5)):
        counts = {r["event_id"]: r["observation_count"] for r in run.events.collect()}
        links = {r["event_id"]: r["n"] for r in run.stored.groupBy("event_id").agg(F.count("*").alias("n")).collect()}
        assert counts == links and len(counts) == events and sum(links.values()) == rows
        assert {r["event_id"] for r in run.risk.collect()} >= set(counts)
    assert {r["event_id"] for r in first.events.collect()} <= {r["event_id"] for r in second.events.collect()}
    assert [r["intensity"] for r in second.stored.filter("latitude = 25").collect()] == [340.0]


def test_rows_of_one_time_come_by_their_line(spark):
    """Six events of four rows at one time, the later lines hotter; half of the lines come in a second batch."""
    places = [(25.0 + k % 6 + 0.001 * (k // 6), 75.0, "2024-01-01", "0100") for k in range(24)]
    rows = raw(spark, places).withColumn("bright_ti4", F.when(F.col("line_no") < 12, "300").otherwise("400"))
    store = EventStore(spark, scratch_path(spark, "store"))
    for part in ("line_no % 2 = 1", "line_no % 2 = 0"):
        ingest_batch(store, rows.filter(part).coalesce(1))
    assert [(r["observation_count"], r["trend"]) for r in stored_events(store).collect()] == [(4, "INCREASING")] * 6


@pytest.mark.parametrize("files", [1, 2, 4])
def test_ingest_over_batches(spark, files):
    folder = scratch_path(spark, "landed")
    places = [(25.0, 75.0, "2024-01-01", "0100"), (26.0, 75.0, "2024-01-01", "0100"), (25.0, 75.0, "2024-01-01", "0100"), (25.0, 75.0, "2024-01-02", "0100")]
    for part in range(files):
        raw(spark, places[part * 4 // files:(part + 1) * 4 // files]).coalesce(1).write.mode("append").option("header", True).csv(folder)
    good, bad = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    jobs.run_writer(spark, jobs.stream_ingest(jobs.stream_detections_csv(spark, folder, RAW, 1), good, bad), "ingest")
    assert spark.read.parquet(good).count() == 3
    assert [r["reason"] for r in spark.read.parquet(bad).collect()] == ["DUPLICATE_OBSERVATION"]


@pytest.mark.parametrize("files", [1, 2, 4])
def test_silence_closes_an_episode_in_any_batching(spark, files):
    folder = scratch_path(spark, "rows")
    stamps = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 06:00:00", "2024-01-20 00:00:00", "2024-02-10 00:00:00", "2024-02-11 00:00:00", "2024-02-12 00:00:00", "2024-03-01 00:00:00"]
    for part in range(files):
        own = stamps[part * 8 // files:(part + 1) * 8 // files]
        spark.createDataFrame([(s, 25.0, 75.0) for s in own], "s STRING, latitude DOUBLE, longitude DOUBLE").select(
            F.col("s").cast("timestamp").alias("timestamp"), "latitude", "longitude").coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema("timestamp TIMESTAMP, latitude DOUBLE, longitude DOUBLE").option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted((str(r["last_detection"])[:10], r["status"], r["detections"], r["active_days"]) for r in jobs.run_available(stream_lifecycle(rows), "life").collect())
    assert got == sorted([("2024-01-01", "ACTIVE", 1, 1), ("2024-01-02", "PERSISTENT", 3, 2), ("2024-01-02", "RESOLVED", 3, 2), ("2024-01-20", "ACTIVE", 1, 1),
                          ("2024-01-20", "RESOLVED", 1, 1), ("2024-02-10", "ACTIVE", 1, 1), ("2024-02-12", "PERSISTENT", 3, 3), ("2024-02-12", "RESOLVED", 3, 3), ("2024-03-01", "ACTIVE", 1, 1)])


def test_rule_made_labels_are_refused():
    with pytest.raises(ValueError):
        labeled.require_independent(labeled.Origin("rules", "field review of table rows"))
    with pytest.raises(ValueError):
        labeled.require_independent(labeled.Origin("fixture", "made up"))
    with pytest.raises(ValueError):
        labeled.require_independent(" ")
    assert labeled.require_independent("field survey 2023") == "review: field survey 2023"

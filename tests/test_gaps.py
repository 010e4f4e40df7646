"""Days that one side lacks, and markers without detail."""

import datetime

from pyspark.sql import functions as F

from emberline.operators import history, listing


def days(spark, name, *values):
    at = [datetime.datetime(2024, 1, d, 12, tzinfo=datetime.timezone.utc) for d in values]
    return spark.createDataFrame([(k, t) for k, t in enumerate(at)], f"obs_id long, {name} timestamp")


def test_days_of_either_side(spark):
    rows, events = days(spark, "timestamp", 1, 1, 3), days(spark, "start_time", 2, 3, 3)
    assert sorted((r["day"].day, r["observations"], r["events"]) for r in history.daily_full_outer(rows, events).collect()) == [(1, 2, 0), (2, 0, 1), (3, 1, 2)]
    assert sorted(r["day"].day for r in history.union_days(rows, events).collect()) == [1, 2, 3]
    assert history.union_days(rows.limit(0), events.limit(0)).collect() == []


def test_high_markers_keep_their_place_without_detail(spark):
    markers = spark.createDataFrame([(1, "high", 60.0), (2, "high", 90.0), (3, "medium", 99.0), (4, "high", None), (5, "high", 60.0)], "event_id long, risk_severity string, risk_score double")
    details = spark.createDataFrame([(1, "ACTIVE"), (5, "RESOLVED"), (9, "ACTIVE")], "event_id long, status string")
    got = [(r["event_id"], r["status"]) for r in listing.priority_details(markers, details).collect()]
    assert got == [(2, None), (1, "ACTIVE"), (5, "RESOLVED"), (4, None)]


def test_a_stored_row_is_taken_whole(spark):
    events = spark.createDataFrame([(1,), (2,), (3,)], "event_id long")
    stored = spark.createDataFrame([(1, None, 5.0), (9, "x", 1.0)], "event_id long, kind string, score double")
    computed = spark.createDataFrame([(1, "made", 7.0), (2, "made", None)], "event_id long, kind string, score double")
    got = sorted(tuple(r) for r in listing.stored_or_computed(events, stored, computed, ("kind", "score")).collect())
    assert got == [(1, None, 5.0, False), (2, "made", None, True), (3, None, None, True)]

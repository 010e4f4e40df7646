"""Bit maps of days against plain dates, and cursors against offsets."""

import datetime
import random

from pyspark.sql import functions as F

from emberline.operators import activity, listing
from emberline.operators.events import max_consecutive_days
from emberline.operators.incremental import EventStore
from emberline.session import scratch_path


def rows(spark, seed, count):
    pick = random.Random(seed)
    at = datetime.datetime(1969, 12, 20, tzinfo=datetime.timezone.utc)
    made = [(k, pick.randrange(12), at + datetime.timedelta(days=pick.randrange(150), hours=pick.randrange(24))) for k in range(count)] + [(count, 3, None), (count + 1, None, at)]
    return spark.createDataFrame(made, "obs_id long, event_id long, timestamp timestamp")


def test_states_of_batches_merge(spark):
    table = rows(spark, 1, 500)
    parts = [table.filter(F.col("obs_id") % 3 == k) for k in range(3)]
    states = [activity.day_words(p) for p in parts]
    merged = activity.merged_words(states[0].unionAll(states[1]).unionAll(states[2]))
    got = {r["event_id"]: (r["detections"], r["active_days"], r["consecutive_active_days"]) for r in activity.activity_of(merged).collect()}
    known = table.filter("event_id IS NOT NULL AND timestamp IS NOT NULL")
    counts = {r["event_id"]: r["n"] for r in known.groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    assert got == {r["event_id"]: (counts[r["event_id"]], r["active_days"], r["consecutive_active_days"]) for r in max_consecutive_days(known).collect()}


def test_joined_events_share_their_days(spark):
    store = EventStore(spark, scratch_path(spark, "events"))
    day = 86_400

    def batch(rows):
        return spark.createDataFrame([(i, 25.0, 75.0, t) for i, t in rows], "obs_id long, latitude double, longitude double, t long").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")

    store.add(batch([(1, 0), (2, 3600), (3, 8 * day)]))
    assert store.activity().count() == 2
    store.add(batch([(4, 3 * day), (5, 5 * day), (6, 9 * day)]))
    assert [(r["detections"], r["active_days"], r["consecutive_active_days"]) for r in store.activity().collect()] == [(6, 5, 2)]
    assert {r["day"].day: r["n"] for r in store.daily_counts().collect()} == {1: 2, 9: 1, 4: 1, 6: 1, 10: 1}


def test_cursors_equal_offsets(spark):
    pick = random.Random(2)
    at = datetime.datetime(2024, 1, 1)
    scored = spark.createDataFrame([(k, float(pick.randrange(5)), at + datetime.timedelta(hours=pick.randrange(3))) for k in range(157)], "event_id long, risk_score double, end_time timestamp")
    path = scratch_path(spark, "ranked")
    listing.write_ranked(scored, path)
    table, after, seen = spark.read.parquet(path), None, []
    while True:
        page = listing.seek_page(table, 25, after)
        ids = [r["event_id"] for r in page.collect()]
        if not ids:
            break
        seen.append(ids)
        after = listing.cursor_of(page)
    ranked = [r["event_id"] for r in listing.rank_events(scored).collect()]
    assert seen == [ranked[k:k + 25] for k in range(0, 157, 25)]
    plan = listing.seek_page(table, 25, (2.0, at, 7))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(risk_score,2.0)" in plan and "TakeOrderedAndProject" in plan

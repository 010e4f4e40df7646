"""Clustering kept up to date against clustering everything at once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.operators.cluster import Linker
from emberline.operators.incremental import EventStore
from emberline.session import scratch_path

ROWS = "obs_id long, latitude double, longitude double, t long, intensity double"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("timestamp", F.timestamp_seconds("t")).drop("t")


def partition_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["event_id"], []).append(r["obs_id"])
    return sorted(sorted(g) for g in groups.values())


def made(seed, n, spread):
    pick = random.Random(seed)
    ids = list(range(1, n + 1))
    pick.shuffle(ids)
    return [(i, 25 + pick.randrange(spread) * 0.004 + pick.random() * 0.002, 75 + pick.randrange(spread) * 0.004, 1_704_067_200 + pick.randrange(40 * 86_400), 300.0 + i % 7) for i in ids]


@pytest.mark.parametrize(("seed", "batches", "by_time"), [(1, 4, False), (2, 3, True), (3, 6, False)])
def test_any_batches_give_the_components_of_all_rows(spark, seed, batches, by_time):
    rows = made(seed, 240, 9)
    if by_time:
        rows.sort(key=lambda r: r[3])
    store = EventStore(spark, scratch_path(spark, "events"))
    survivors = set()
    for k in range(batches):
        part = rows[k * len(rows) // batches:(k + 1) * len(rows) // batches]
        earlier = set() if k == 0 else {r["event_id"] for r in store.rows().select("event_id").collect()}
        run = store.add(table(spark, part))
        assert (run.run, run.inserted, run.updated) == (k + 1, len(part), 0)
        now = {r["event_id"] for r in store.rows().select("event_id").collect()}
        survivors = earlier & now
        assert len(earlier - now) == run.merged_events  # a stored event keeps its id unless it joins another stored one
    assert survivors
    whole = table(spark, rows)
    assert partition_of(store.rows().collect()) == partition_of(Linker(whole).attach(whole).collect())


def test_an_event_longer_than_a_window_stays_one(spark):
    day = 86_400
    store = EventStore(spark, scratch_path(spark, "events"))
    store.add(table(spark, [(50 + k, 25.0, 75.0, k * day, 1.0) for k in range(3)]))
    store.add(table(spark, [(10 + k, 25.0, 75.0, k * day, 1.0) for k in (3, 4)]))
    assert {r["event_id"] for r in store.rows().collect()} == {50}
    # two events far in time are joined by what comes between, and once more
    store.add(table(spark, [(5, 25.0, 75.0, 14 * day, 1.0), (4, 25.0, 75.0, 24 * day, 1.0)]))
    assert {r["event_id"] for r in store.rows().collect()} == {50, 5, 4}
    run = store.add(table(spark, [(3, 25.0, 75.0, 17 * day, 1.0), (2, 25.0, 75.0, 20 * day, 1.0), (1, 25.0, 75.0, 22 * day, 1.0)]))
    assert run.merged_events == 1 and {r["event_id"] for r in store.rows().collect()} == {50, 4}
    store.add(table(spark, [(k, 25.0, 75.0, (k - 90) * day, 1.0) for k in (97, 100, 102)]))
    assert {r["event_id"] for r in store.rows().collect()} == {4}


def test_redelivery_updates_values_and_links_nothing_anew(spark):
    store = EventStore(spark, scratch_path(spark, "events"))
    store.add(table(spark, [(1, 25.0, 75.0, 0, 1.0), (2, 26.0, 75.0, 0, 1.0)]))
    run = store.add(table(spark, [(1, 25.0, 75.0, 0, 9.0), (3, 25.001, 75.0, 60, 2.0)]))
    assert (run.inserted, run.updated) == (1, 1)
    assert sorted((r["obs_id"], r["event_id"], r["intensity"]) for r in store.rows().collect()) == [(1, 1, 9.0), (2, 2, 1.0), (3, 1, 2.0)]


def test_what_is_not_published_is_not_seen(spark):
    store = EventStore(spark, scratch_path(spark, "events"))
    store.add(table(spark, [(1, 25.0, 75.0, 0, 1.0)]))
    store.link(table(spark, [(2, 25.0, 75.0, 60, 1.0)]))  # broken off before it was published
    assert [r["obs_id"] for r in store.rows().collect()] == [1]
    store.add(table(spark, [(3, 25.0, 75.0, 120, 1.0)]))
    assert sorted(r["obs_id"] for r in store.rows().collect()) == [1, 3]


def test_only_buckets_in_reach_are_read(spark):
    store = EventStore(spark, scratch_path(spark, "events"))
    store.add(table(spark, [(k, 25.0, 75.0, k * 10 * 86_400, 1.0) for k in range(1, 12)]))
    near = store.rows(buckets=[13, 14])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+L? IN \(13,14\)", plan) or re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(13,14\)", plan), plan
    assert [r["obs_id"] for r in near.collect()] == [4]

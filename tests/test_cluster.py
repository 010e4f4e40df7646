"""Clustering against brute force, and its invariants."""

import functools
import math
import operator
import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.operators import cluster, components
from emberline.operators.components import connected_components

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "obs_id LONG, latitude DOUBLE, longitude DOUBLE, timestamp TIMESTAMP"


def frame(spark, points):
    return spark.createDataFrame([(i, lat, lon, START + timedelta(hours=h)) for i, (lat, lon, h) in enumerate(points)], SCHEMA)


def brute(points, meters=1000.0, hours=72.0):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, o, h) in enumerate(points):
        for j in range(i):
            b, p, k = points[j]
            middle = math.radians((a + b) / 2)
            if abs(h - k) <= hours and math.hypot(111200 * (a - b), 111200 * math.cos(middle) * (o - p)) <= meters:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(points))}


def found(spark, points, **kw):
    rows = cluster.cluster_assignments(frame(spark, points), **kw).collect()
    return {r.obs_id: r.event_id for r in rows}


def test_adjacent_cells_still_need_the_distance(spark):
    assert len(set(found(spark, [(20.0, 75.0, 0), (20.0, 75.09, 0)], distance_meters=1500, time_hours=24).values())) == 2


def test_chain_is_one_event_and_gap_ends_it(spark):
    points = [(20.0, 75.0, 0), (20.0, 75.0, 72), (20.0, 75.0, 144), (20.0, 75.0, 217)]
    assert found(spark, points) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_unlocatable_rows_stay_unassigned(spark):
    rows = frame(spark, [(20.0, 75.0, 0), (20.0, 75.0, 1)]).withColumn("latitude", F.when(F.col("obs_id") == 0, F.col("latitude")))
    linked = cluster.assign_event_ids(rows, cluster.cluster_assignments(rows))
    assert {r.obs_id: r.event_id for r in linked.collect()} == {0: 0, 1: None}


@pytest.mark.parametrize("latitude", [0.0, 45.0, -63.0, 89.2])
def test_dense_field_matches_brute_force(spark, latitude):
    rng = random.Random(int(latitude * 10))
    wide = 0.06 / max(math.cos(math.radians(latitude)), 0.01)
    points = [(latitude + rng.uniform(-0.06, 0.06), 10 + rng.uniform(-wide, wide), rng.uniform(0, 400)) for _ in range(250)]
    assert found(spark, points) == brute(points)


def test_populous_undecided_cubes_are_split_exactly(spark):
    """Two hot sites about one linkage distance apart, a third of all rows in one of them."""
    rng = random.Random(7)
    def site(lat, lon, n):
        return [(lat + rng.uniform(-2e-4, 2e-4), lon + rng.uniform(-2e-4, 2e-4), rng.uniform(0, 200)) for _ in range(n)]

    points = site(20.0, 75.0, 120) + site(20.0 + 990 / 111200, 75.0, 60) + site(20.0 + 2040 / 111200, 75.0, 60) + site(21.0, 76.0, 60)
    exact = brute(points)
    assert found(spark, points, light_product=4096) == exact
    assert found(spark, points, light_product=1) == exact


def test_order_and_partitioning_do_not_matter(spark):
    rng = random.Random(3)
    points = [(20 + rng.uniform(0, 0.1), 75 + rng.uniform(0, 0.1), rng.uniform(0, 200)) for _ in range(150)]
    rows = frame(spark, points)
    one = {r.obs_id: r.event_id for r in cluster.cluster_assignments(rows.repartition(7, "longitude")).collect()}
    two = {r.obs_id: r.event_id for r in cluster.cluster_assignments(rows.orderBy(F.rand(1))).collect()}
    assert one == two == brute(points)


def test_every_row_is_linked_once_and_counts_agree(spark):
    rng = random.Random(5)
    rows = frame(spark, [(20 + rng.uniform(0, 0.1), 75 + rng.uniform(0, 0.1), rng.uniform(0, 200)) for _ in range(150)])
    linked = cluster.attach_events(rows)
    assert linked.count() == 150 == linked.select("obs_id").distinct().count()
    events = {r.event_id: r.observation_count for r in cluster.cluster_events(rows).collect()}
    assert events == {r.event_id: r["count"] for r in linked.groupBy("event_id").count().collect()}


def test_groups_are_clustered_apart(spark):
    rows = frame(spark, [(20.0, 75.0, 0), (20.0, 75.0, 1), (20.0, 75.0, 0), (20.5, 75.0, 0)]).withColumn(
        "event_id", F.when(F.col("obs_id") < 2, 7).otherwise(8))
    assert [r.event_id for r in cluster.single_cluster_groups(rows, "event_id").collect()] == [7]


coordinate = st.integers(0, 60).map(lambda k: k * 0.002)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(coordinate, coordinate, st.integers(0, 40).map(lambda k: k * 12.0)), min_size=1, max_size=60),
       st.sampled_from([1, 16, 4096]))
def test_random_grids_match_brute_force(spark, cells, light):
    points = [(20 + a, 75 + b, h) for a, b, h in cells]
    assert found(spark, points, light_product=light) == brute(points)


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_components_of_long_chains_and_stars(spark, monkeypatch, chunk):
    """Both what one task may hold and what needs star rounds."""
    monkeypatch.setattr(components, "CHUNK_EDGES", chunk)
    chain = [(i, i + 1) for i in range(400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star, "a LONG, b LONG").repartition(8)
    parts = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert len(parts) == 701
    assert all(parts[i] == 0 for i in range(401)) and all(parts[1000 + i] == 1000 for i in range(300))


@pytest.mark.parametrize("bad", [{"distance_meters": 0}, {"time_hours": -1}])
def test_limits_are_checked(spark, bad):
    with pytest.raises(ValueError):
        cluster.cluster_assignments(frame(spark, [(1.0, 1.0, 0)]), **bad)


def test_hot_cube_join_is_salted_without_change(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HOT_CUBE_ROWS", 5)
    points = [(20.0, 75.0, 0.01 * i) for i in range(40)] + [(21.0, 76.0, 0.0), (21.0, 76.0, 500.0)]
    rows = frame(spark, points)
    got = {r.obs_id: r.event_id for r in cluster.attach_events(rows).collect()}
    assert got == brute(points) == {r.obs_id: r.event_id for r in cluster.cluster_assignments(rows).collect()}


def test_longitudes_of_any_size_link_through_few_blocks(spark):
    """Far beyond 360 degrees on either side a cube goes to the blocks in its reach, and to all of them."""
    pick = random.Random(8)
    points = [(20 + pick.random() * 0.1, centre + pick.random() * 0.1, pick.random() * 100) for centre in (-900.0, 1600.0, 360.95) for _ in range(60)]
    rows = frame(spark, points)
    linker = cluster.Linker(rows)
    home, halo = linker._blocks()
    assert halo.count() <= 12 * home.count()
    assert {r["obs_id"]: r["event_id"] for r in linker.assignments().collect()} == brute(points)


def test_a_mean_on_a_bound_is_the_bound_in_any_order(spark):
    """Plain sums of these latitudes give 25 or a little more or less, by their order."""
    steps = [-0.006] * 3 + [-0.003] * 4 + [0.0] + [0.003] * 4 + [0.006] * 3
    orders = [random.Random(k).sample(steps, len(steps)) for k in range(40)]
    rows = [(event, i, 25.0 + s) for event, order in enumerate(orders) for i, s in enumerate(order)]
    assert len({functools.reduce(operator.add, (lat for e, _, lat in rows if e == event)) / len(steps) for event in range(40)}) > 1
    linked = spark.createDataFrame(rows, "event_id long, obs_id long, latitude double").selectExpr("*", "70.1D AS longitude", "timestamp_seconds(obs_id) AS timestamp").coalesce(1)
    means = cluster.summarize_events(linked).select("latitude", "longitude").distinct().collect()
    assert [tuple(r) for r in means] == [(25.0, 70.1)]

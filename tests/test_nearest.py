"""The k nearest rows against all distances."""

import functools
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import nearest
from emberline.operators.nearest import nearest_rows
from emberline.session import broadcast_if_small, materialize


def km(a, b):
    d_lat, d_lon = (a[0] - b[0]) * 111.0, (a[1] - b[1]) * 111.0 * math.cos(math.radians(b[0]))
    return math.sqrt(d_lat * d_lat + d_lon * d_lon)


@pytest.mark.parametrize(("k", "leaf", "shape"), [(1, 4, "even"), (3, 4, "dense spot"), (2, 1, "lattice"), (5, 32, "one place")])
def test_equal_to_all_distances(spark, k, leaf, shape):
    pick = random.Random(k)
    if shape == "even":
        catalog = [(i, pick.uniform(-60, 60), pick.uniform(-170, 170)) for i in range(300)]
    elif shape == "dense spot":
        catalog = [(i, 20 + pick.random() * 0.01, 80 + pick.random() * 0.01) for i in range(250)] + [(900 + i, -30.0 - i, 10.0) for i in range(4)]
    elif shape == "lattice":  # many equal distances
        catalog = [(i, float(i % 12), float(i // 12)) for i in range(144)]
    else:
        catalog = [(i, 7.0, 69.0) for i in range(60)]
    pick.shuffle(catalog)
    points = [(i, pick.uniform(-70, 70), pick.uniform(-180, 180)) for i in range(60)] + [(100 + i, float(i), 3.5) for i in range(12)] + [(300, 20.005, 80.005), (301, None, 5.0), (302, 80.0, float("nan"))]
    schema = "event_id long, latitude double, longitude double"
    found = nearest_rows(spark.createDataFrame(points, schema), spark.createDataFrame(catalog + [(10_000, None, 1.0)], "facility_id long, latitude double, longitude double"), k, leaf_rows=leaf)
    got = {}
    for r in found.collect():
        got.setdefault(r["event_id"], []).append((r["place"], r["facility_id"], r["distance_km"]))
    for i, lat, lon in points:
        if lat is None or math.isnan(lon):
            assert i not in got
            continue
        want = sorted((km((a, o), (lat, lon)), f) for f, a, o in catalog)[:k]
        mine = sorted(got[i])
        assert [p for p, _, _ in mine] == list(range(1, len(want) + 1))
        assert [d for _, _, d in mine] == pytest.approx([d for d, _ in want], abs=1e-9)
        if shape in ("lattice", "one place"):
            assert {f for _, f, _ in mine} <= {f for d, f in sorted((km((a, o), (lat, lon)), f) for f, a, o in catalog) if d <= want[-1][0] + 1e-9}
        else:
            assert [f for _, f, _ in mine] == [f for _, f in want]


def test_small_and_empty_catalogues(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0)], "event_id long, latitude double, longitude double")
    schema = "facility_id long, latitude double, longitude double"
    assert nearest_rows(points, spark.createDataFrame([], schema), 2).collect() == []
    assert [(r["place"], r["facility_id"]) for r in nearest_rows(points, spark.createDataFrame([(7, 5.0, 6.0), (3, 5.0, 4.0)], schema), 5).orderBy("place").collect()] == [(1, 3), (2, 7)]


def test_copies_of_a_place_and_far_points_bring_few_candidates(spark, monkeypatch):
    """Every place held 50 times and points up to 1,600 degrees east: the rows are right, and few places are measured."""
    pick = random.Random(4)
    sites = [(7 + pick.random() * 27, 69.0 + i % 5 / 10) for i in range(200)]
    catalog = [(n * 200 + i, *site) for i, site in enumerate(sites) for n in range(50)]
    # places of two levels of latitude, within a cell of the points' grid, near and far, east and west
    points = [(i, 8 + i % 6 * 4 + pick.random() * 0.05, pick.choice((-1300.0, 60.0, 69.2, 335.0, 1600.0)) + pick.random() * 0.05) for i in range(120)]
    measured = []
    rows_of = nearest.Quadtree.leaf_rows_of

    def counted(tree, leaves, keep):
        measured.append((leaves.agg(F.sum("n")).first()[0], leaves.select("box").distinct().count()))
        return rows_of(tree, leaves, keep)

    monkeypatch.setattr(nearest.Quadtree, "leaf_rows_of", counted)
    schema = "event_id long, latitude double, longitude double"
    found = nearest_rows(spark.createDataFrame(points, schema), spark.createDataFrame(catalog, "facility_id long, latitude double, longitude double"), 3, leaf_rows=2)
    got = {}
    for r in found.collect():
        got.setdefault(r["event_id"], []).append((r["place"], r["facility_id"]))
    for i, lat, lon in points:
        assert [f for _, f in sorted(got[i])] == [f for _, f in sorted((km((a, o), (lat, lon)), f) for f, a, o in catalog)[:3]]
    rows, boxes = measured[0]
    assert rows < 15 * boxes


def test_the_points_meet_their_leaves_by_shuffle(spark, monkeypatch):
    """Written boxes and leaves are a few compressed bytes, by which Spark would build all their rows on the driver."""
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(nearest, "materialize", spy)
    monkeypatch.setattr(nearest, "broadcast_if_small", functools.partial(broadcast_if_small, max_rows=2))
    points = spark.range(50).selectExpr("id AS event_id", "10.0D + id % 9 AS latitude", "70.0D + id % 7 AS longitude")
    catalog = spark.range(40).selectExpr("id AS facility_id", "10.0D + id % 8 AS latitude", "70.0D + id % 5 AS longitude")
    assert nearest_rows(points, catalog, 3, leaf_rows=4).count() == 150
    joins = [line for line in plans["nearest-rows"].splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and all("strategy=merge" in line for line in joins)

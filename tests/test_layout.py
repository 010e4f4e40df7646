"""Box reads over the curve layout against plain filters."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import Area
from emberline.session import scratch_path
from emberline.sources import layout


def interleaved(x, y):
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(16))


@pytest.fixture(scope="module")
def stored(spark):
    pick = random.Random(8)
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, pick.uniform(-90, 90), pick.uniform(-180, 180), at + datetime.timedelta(hours=pick.randrange(700))) for k in range(3000)]
    rows += [(5000 + k, 25.0, 75.0, at + datetime.timedelta(hours=k)) for k in range(1500)]  # a third of all in one place
    rows += [(9000, None, 1.0, at), (9001, float("nan"), 1.0, at), (9002, 90.0, 180.0, at), (9003, -90.0, -180.0, at)]
    path = scratch_path(spark, "layout")
    layout.write_by_cell(spark.createDataFrame(rows, "obs_id long, latitude double, longitude double, timestamp timestamp").repartition(5), path, 24)
    return rows, path


BOXES = [Area(68, 6.5, 97.5, 35.5), Area(74.9, 24.9, 75.1, 25.1), Area(-180, -90, 180, 90), Area(179, 89, 180, 90), Area(-0.5, -0.5, 0.5, 0.5), Area(100.001, -44.2, 100.002, -44.1)]


@pytest.mark.parametrize("area", BOXES)
def test_same_rows_as_a_filter(spark, stored, area):
    rows, path = stored
    start, end = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    for a, b in ((None, None), (start, end)):
        got = sorted(r["obs_id"] for r in layout.read_box(spark, path, area, a, b).collect())
        assert got == sorted(i for i, lat, lon, t in rows if lat is not None and area.south <= lat <= area.north and area.west <= lon <= area.east
                             and (a is None or datetime.datetime.fromisoformat(a) <= t < datetime.datetime.fromisoformat(b)))


def test_ranges_hold_every_cell_and_few_others(spark):
    area = Area(10.0, 10.0, 10.3, 10.2)
    ranges = layout.key_ranges(area)
    assert len(ranges) <= layout.MOST_RANGES and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    xs = [int((v + 180) / 360 * 65536) for v in (area.west, area.east)]
    ys = [int((v + 90) / 180 * 65536) for v in (area.south, area.north)]
    inside = {interleaved(x, y) for x in range(xs[0], xs[1] + 1) for y in range(ys[0], ys[1] + 1)}
    assert all(any(a <= k <= b for a, b in ranges) for k in inside)
    assert sum(b - a + 1 for a, b in ranges) < 3 * len(inside)


def test_keys_and_files_read(spark, stored):
    _, path = stored
    key = spark.createDataFrame([(10.0, 10.0), (None, 1.0)], "latitude double, longitude double").select(layout.cell_key(F.col("latitude"), F.col("longitude")).alias("k")).collect()
    assert [r["k"] for r in key] == [interleaved(int(190 / 360 * 65536), int(100 / 180 * 65536)), None]
    every = len(layout.box_files(spark, path, Area(-180, -90, 180, 90)))
    assert every >= 20
    assert len(layout.box_files(spark, path, Area(100.0, -45.0, 101.0, -44.0))) <= 3
    # the dense place is spread over files by time, and a few days open few of them
    dense = Area(74.9, 24.9, 75.1, 25.1)
    assert len(layout.box_files(spark, path, dense, "2024-01-05 00:00:00", "2024-01-06 00:00:00")) < len(layout.box_files(spark, path, dense)) < every

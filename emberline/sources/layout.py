"""Stored detections in the order of a space-filling curve, and reads of a box's files only.

A row's key interleaves the bits of its longitude and latitude cell, so that rows near one
another mostly have near keys. Rows are range-partitioned and sorted by (key, time): every
file covers a narrow range of keys, however dense one place is. A small table beside the
files holds each file's least and greatest key and time. A box becomes a few ranges of
keys; only files that meet one of them (and the time range) are opened, the ranges go down
to their row groups, and the exact box settles the rest, so answers do not depend on the
layout. Rows without a position have no key; they are kept in files of their own and no
box finds them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.geo import Area, in_box

BITS = 16
#: Ranges of keys to a box; fewer cover more than the box, never less.
MOST_RANGES = 32
KEY = "cell_key"


def _spread(value: Column) -> Column:
    """The low 16 bits of a long, each followed by a free bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = (value.bitwiseOR(F.shiftleft(value, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return value


def _cell(value: Column, low: float, span: float) -> Column:
    at = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(1 << BITS)))
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def cell_key(lat: Column, lon: Column) -> Column:
    """Interleaved cell number; null without a position. Positions beyond the poles or the date line count as on them."""
    key = _spread(_cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_cell(lat, -90.0, 180.0)), 1))
    return F.when(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), key)


def key_ranges(area: Area, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, in order, that hold every cell of a box: squares are halved while there is room for more ranges."""
    def cells(low: float, high: float, start: float, span: float) -> tuple[int, int]:
        top = (1 << BITS) - 1
        return tuple(min(max(int((v - start) / span * (1 << BITS) // 1), 0), top) for v in (low, high))

    (x0, x1), (y0, y1) = cells(area.west, area.east, -180.0, 360.0), cells(area.south, area.north, -90.0, 180.0)
    squares = [(0, 0, BITS)]  # column, row and level of a square of 2 ** level cells a side
    while True:
        parts = []
        for x, y, level in squares:
            left, right, low, high = x << level, ((x + 1) << level) - 1, y << level, ((y + 1) << level) - 1
            if right < x0 or left > x1 or high < y0 or low > y1:
                continue
            whole = x0 <= left and right <= x1 and y0 <= low and high <= y1
            parts += [(x, y, level)] if whole or level == 0 else [(2 * x + dx, 2 * y + dy, level - 1) for dy in (0, 1) for dx in (0, 1)]
        parts = [(x, y, level) for x, y, level in parts if not (((x + 1) << level) - 1 < x0 or x << level > x1 or ((y + 1) << level) - 1 < y0 or y << level > y1)]
        if parts == squares or _joined(parts, most) is None:
            return _joined(parts, most) or _joined(squares, 1 << 30)
        squares = parts


def _joined(squares: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]] | None:
    """Squares as ranges of keys, neighbours in one; None if these are more than ``most``."""
    def interleaved(x: int, y: int) -> int:
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(BITS))

    ranges: list[tuple[int, int]] = []
    for low, high in sorted((interleaved(x, y) << 2 * level, ((interleaved(x, y) + 1) << 2 * level) - 1) for x, y, level in squares):
        if ranges and low <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], max(high, ranges[-1][1]))
        else:
            ranges.append((low, high))
    return ranges if len(ranges) <= most else None


def write_by_cell(rows: DataFrame, path: str, files: int) -> None:
    """Rows in key order below ``path``/rows, and the table of what each file covers."""
    keyed = rows.withColumn(KEY, cell_key(F.col("latitude"), F.col("longitude")))
    keyed.repartitionByRange(files, KEY, "timestamp").sortWithinPartitions(KEY, "timestamp").write.parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    covered = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(KEY).alias("key_low"), F.max(KEY).alias("key_high"), F.min("timestamp").alias("time_low"), F.max("timestamp").alias("time_high"))
    covered.coalesce(1).write.parquet(f"{path}/files")  # a row a file


def box_files(spark: SparkSession, path: str, area: Area, start: str | None = None, end: str | None = None) -> list[str]:
    """The files that may hold rows of the box in [start, end)."""
    meets = reduce(Column.__or__, [(F.col("key_low") <= high) & (F.col("key_high") >= low) for low, high in key_ranges(area)])
    covered = spark.read.parquet(f"{path}/files").filter(meets)
    if start is not None:
        covered = covered.filter(F.col("time_high") >= F.lit(start).cast("timestamp"))
    if end is not None:
        covered = covered.filter(F.col("time_low") < F.lit(end).cast("timestamp"))
    return sorted(r["file"] for r in covered.select("file").collect())


def read_box(spark: SparkSession, path: str, area: Area, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored rows of the box, borders included, and of the time from start to before end."""
    found = box_files(spark, path, area, start, end)
    rows = spark.read.parquet(*found) if found else spark.read.parquet(f"{path}/rows").filter(F.lit(False))
    rows = rows.filter(reduce(Column.__or__, [F.col(KEY).between(low, high) for low, high in key_ranges(area)]))
    rows = rows.filter(in_box(F.col("latitude"), F.col("longitude"), area.south, area.north, area.west, area.east))
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return rows.select(*columns) if columns else rows.drop(KEY)

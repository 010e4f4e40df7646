"""Exact row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import cut_lineage

WINDOW_LIMIT = 2_000_000
# Pass as ``largest`` where one group holds the whole table.
RANGES_ALWAYS = WINDOW_LIMIT + 1


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys; the left keys stay."""
    named = right.select(*(F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(named, same, how).drop(*(f"_right_{key}" for key in keys))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "size",
                largest: int | None = None, window_limit: int = WINDOW_LIMIT) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group's size.

    ``order`` must be unique within a group. While the largest group is below
    ``window_limit`` rows a window does it in one shuffle. Beyond, no task may
    hold a group: rows are range-partitioned by (keys, order), numbered in place
    and shifted by the counts of the partitions before.
    """
    if (largest_group(df, keys) if largest is None else largest) <= window_limit:
        group = Window.partitionBy(*keys)
        return (df.withColumn(rank, F.row_number().over(group.orderBy(*order)).cast("long"))
                .withColumn(size, F.count(F.lit(1)).over(group)))
    placed = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                         .withColumn("_place", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_place", 33)))
    pieces = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # One row per group and partition it touches: at most as many as there are partitions.
    spans = Window.partitionBy(*keys)
    before = F.sum("_n").over(spans.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = (pieces.withColumn("_shift", F.coalesce(before, F.lit(0)) - F.col("_first") + 1)
              .withColumn(size, F.sum("_n").over(spans)).drop("_n", "_first"))
    return (join_null_safe(placed, pieces, ["_part", *keys])
            .withColumn(rank, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift"))

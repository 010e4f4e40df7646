"""Exact quantiles with linear interpolation, without a buffer that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ranking import join_null_safe
from emberline.session import cut_lineage

PERCENTILE_LIMIT = 1_000_000


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], keys: Sequence[str] = (),
                    percentile_limit: int = PERCENTILE_LIMIT) -> DataFrame:
    """One row per key with the named quantiles of the non-null values.

    Equal values are counted first. While a key has at most ``percentile_limit``
    distinct values the built-in percentile (over value and count) is used; beyond,
    the counts are range-partitioned by value and positions are found from
    running totals, so no task sees more than its range.
    """
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
                         .agg(F.count(F.lit(1)).alias("_n")))
    widest = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if widest <= percentile_limit:
        return counts.groupBy(*keys).agg(*(F.percentile("_v", q, F.col("_n")).alias(name) for name, q in quantiles.items()))
    placed = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    pieces = placed.groupBy("_part", *keys).agg(F.sum("_n").alias("_piece"))
    spans = Window.partitionBy(*keys)
    pieces = pieces.select("_part", *keys, (
        F.coalesce(F.sum("_piece").over(spans.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).alias("_before"), F.sum("_piece").over(spans).alias("_all"))
    inside = Window.partitionBy("_part", *keys).orderBy("_v")
    running = (join_null_safe(placed, pieces, ["_part", *keys])
               .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col("_v")))

    wanted = []
    for name, q in quantiles.items():
        place = (F.col("_all") - 1) * F.lit(q)
        wanted += [at(F.floor(place)).alias(name + "_lo"), at(F.ceil(place)).alias(name + "_hi"),
                   F.max(place - F.floor(place)).alias(name + "_share"), F.max(F.ceil(place) - place).alias(name + "_rest")]
    found = running.groupBy(*keys).agg(*wanted)
    # the same arithmetic as the built-in percentile, so that both ways give the same bits
    return found.select(*keys, *(
        F.when(F.col(n + "_lo") == F.col(n + "_hi"), F.col(n + "_lo").cast("double"))
        .otherwise(F.col(n + "_rest") * F.col(n + "_lo") + F.col(n + "_share") * F.col(n + "_hi")).alias(n) for n in quantiles))

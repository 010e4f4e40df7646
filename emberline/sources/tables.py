"""Stored tables as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION_COLUMNS = ("obs_id", "timestamp", "latitude", "longitude", "intensity", "confidence", "confidence_category",
                       "source", "sensor", "frp", "scan", "track", "bright_ti5", "bright_t31", "daynight")


def write_observations(rows: DataFrame, path: str, mode: str = "errorifexists", salts: int = 8) -> None:
    """Partitioned by day and source.

    ``salts`` spreads a (day, source) that holds a large share of the rows over
    that many writers; each writer makes one file per partition.
    """
    dated = rows.withColumn("date", F.to_date("timestamp"))
    salt = F.pmod(F.xxhash64("timestamp", "latitude", "longitude"), F.lit(salts))
    (dated.repartition("date", "source", salt).write.mode(mode).partitionBy("date", "source").parquet(path))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def overwrite_by_key(spark: SparkSession, fresh: DataFrame, current: str | None, target: str, key: str = "event_id") -> None:
    """Write a new version of a keyed table: fresh rows replace rows of the same key."""
    from emberline.operators.merge import replace_rows

    merged = fresh if current is None else replace_rows(spark.read.parquet(current), fresh, key)
    merged.write.parquet(target)

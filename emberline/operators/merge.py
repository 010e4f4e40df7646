"""Bringing new detections and clusters into stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.ranking import join_null_safe
from emberline.session import broadcast_if_small

# Identity of a stored detection; replays also compare the sensor.
OBSERVATION_KEY = ("timestamp", "latitude", "longitude", "source")
REPLAY_KEY = ("source", "timestamp", "latitude", "longitude", "sensor")
CENTROID_TOLERANCE = 0.001
MATCH_CELL = 0.01


def latest_per_key(batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last in ``order``; a combinable aggregation, no window."""
    rest = [c for c in batch.columns if c not in key]
    return (batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
            .select(*key, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*batch.columns))


def upsert_observations(stored: DataFrame, batch: DataFrame, key: Sequence[str] = OBSERVATION_KEY,
                        order: str = "line_no") -> DataFrame:
    """The stored table after the batch, with ``outcome`` kept / updated / inserted.

    Measurements of known detections are replaced, everything else is added. Both
    sides hold a key at most once, so the full join has no hot keys.
    """
    new = latest_per_key(batch, key, order)
    values = [c for c in stored.columns if c not in key]
    old_side = stored.select(*key, F.struct(*values).alias("old"))
    new_side = new.select(*key, F.struct(*(
        F.col(c) if c in new.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in values)).alias("new"))
    joined = old_side.join(new_side, list(key), "full")
    carried = {"obs_id", "event_id"}

    def value(name: str) -> Column:
        old, fresh = F.col("old")[name], F.col("new")[name]
        if name in carried:
            return F.coalesce(old, fresh)
        return F.when(F.col("new").isNotNull(), fresh).otherwise(old)

    outcome = (F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").otherwise("updated"))
    return joined.select(*key, *(value(c).alias(c) for c in values), outcome.alias("outcome"))


def upsert_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("outcome") == "inserted").alias("inserted"),
                        F.count_if(F.col("outcome") == "updated").alias("updated"))


def match_existing_events(clusters: DataFrame, stored: DataFrame, tolerance: float = CENTROID_TOLERANCE) -> DataFrame:
    """Clusters with the stored event of equal times and near centroid, or none.

    Many events share their times (one overpass), so the join also uses a
    coordinate cell; stored events enter every cell their tolerance touches.
    """
    def cell(value: Column) -> Column:
        return F.floor(value / F.lit(MATCH_CELL)).cast("long")

    def cells(name: str) -> Column:
        return F.explode(F.sequence(cell(F.col(name) - F.lit(tolerance)), cell(F.col(name) + F.lit(tolerance))))

    known = (stored.select(F.col("event_id").alias("stored_id"), F.col("latitude").alias("s_lat"),
                           F.col("longitude").alias("s_lon"), "start_time", "end_time")
             .withColumn("cell_lat", cells("s_lat")).withColumn("cell_lon", cells("s_lon")))
    placed = clusters.withColumn("cell_lat", cell(F.col("latitude"))).withColumn("cell_lon", cell(F.col("longitude")))
    near = (F.abs(F.col("latitude") - F.col("s_lat")) <= F.lit(tolerance)) & (
        F.abs(F.col("longitude") - F.col("s_lon")) <= F.lit(tolerance))
    hits = (placed.select("event_id", "latitude", "longitude", "start_time", "end_time", "cell_lat", "cell_lon")
            .join(known, ["start_time", "end_time", "cell_lat", "cell_lon"]).filter(near)
            .groupBy("event_id").agg(F.min("stored_id").alias("stored_id")))
    return (clusters.join(hits, "event_id", "left")
            .withColumn("outcome", F.when(F.col("stored_id").isNull(), "created").otherwise("updated")))


def merge_capture_into_events(members: DataFrame, stored: DataFrame, key: Sequence[str] = REPLAY_KEY) -> DataFrame:
    """Per new cluster: the stored event its known members belong to.

    ``outcome`` is created, adopted or conflict (members of several stored
    events). Null key parts, such as an unknown sensor, equal each other. Two extremes tell one stored event from several; no set is collected.
    """
    known = stored.filter("event_id IS NOT NULL").select(*key, F.col("event_id").alias("stored_id"))
    adopted = join_null_safe(members, known, key, "left").groupBy("event_id").agg(
        F.min("stored_id").alias("low"), F.max("stored_id").alias("high"), F.count(F.lit(1)).alias("members"),
        F.count("stored_id").alias("known_members"))
    return adopted.select(
        "event_id", "members", "known_members",
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("stored_id"),
        F.when(F.col("low").isNull(), "created").when(F.col("low") == F.col("high"), "adopted").otherwise("conflict")
        .alias("outcome"))


def require_no_conflict(merged: DataFrame) -> DataFrame:
    """Refuse a merge in which a cluster would join several stored events."""
    if not merged.filter("outcome = 'conflict'").isEmpty():
        raise ValueError("capture joins several stored events; reconcile them first")
    return merged


def recount_events(events: DataFrame, linked: DataFrame) -> DataFrame:
    """Stored events with observation_count recomputed from the real links."""
    counts = (linked.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("actual")))
    return (events.join(counts, "event_id", "left")
            .withColumn("observation_count", F.coalesce("actual", F.lit(0).cast("long"))).drop("actual"))


def replace_rows(table: DataFrame, fresh: DataFrame, key: str = "event_id") -> DataFrame:
    """Keyed overwrite: fresh rows replace the rows of the same key."""
    return table.join(broadcast_if_small(fresh.select(key)), key, "left_anti").unionByName(fresh, allowMissingColumns=True)

"""Data-quality measures over stored observations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import in_region
from emberline.functions.numeric import display_round, grid_round, utc_day
from emberline.operators.profile import source_histogram
from emberline.operators.validate import count_duplicates, count_invalid_coordinates

# Confidence buckets.
CONFIDENCE_BUCKETS = ("0-20", "20-40", "40-60", "60-80", "80-100")


def confidence_histogram(rows: DataFrame) -> DataFrame:
    """Five zero-filled buckets; null confidences are left out."""
    c = F.col("confidence")
    slot = F.when(c < 20, 0).when(c < 40, 1).when(c < 60, 2).when(c < 80, 3).when(c.isNotNull(), 4)
    counts = rows.agg(*(F.count_if(slot == i).alias(name) for i, name in enumerate(CONFIDENCE_BUCKETS)))
    pairs = F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n in CONFIDENCE_BUCKETS))
    return counts.select(F.inline(pairs))


def observations_per_event(events: DataFrame, linked: DataFrame) -> DataFrame:
    """Linked rows per event, zero included. Counts first, so the join is one row per event."""
    counts = linked.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return events.select("event_id").join(counts, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


def orphan_events(events: DataFrame, linked: DataFrame) -> DataFrame:
    return events.join(linked.filter("event_id IS NOT NULL").select("event_id").distinct(), "event_id", "left_anti")


def count_mismatches(events: DataFrame, linked: DataFrame) -> DataFrame:
    actual = observations_per_event(events, linked).withColumnRenamed("n", "actual")
    return events.select("event_id", "observation_count").join(actual, "event_id").filter("observation_count <> actual")


def event_observations(events: DataFrame, linked: DataFrame) -> DataFrame:
    return linked.join(events.select("event_id", "status", "start_time"), "event_id")


def events_with_observations(events: DataFrame, linked: DataFrame) -> DataFrame:
    return events.join(linked.filter("event_id IS NOT NULL").select("event_id").distinct(), "event_id", "left_semi")


def location_recurrence(rows: DataFrame, digits: int = 3) -> DataFrame:
    """Rounded places with two or more detections on two or more days."""
    return (rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
            .groupBy(grid_round(F.col("latitude"), digits).alias("latitude"), grid_round(F.col("longitude"), digits).alias("longitude"))
            .agg(F.count(F.lit(1)).alias("detection_count"), F.count_distinct(utc_day(F.col("timestamp"))).alias("unique_days"),
                 F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
            .filter("detection_count >= 2 AND unique_days >= 2"))


def recurring_locations(rows: DataFrame, top: int = 10) -> DataFrame:
    return location_recurrence(rows).orderBy(F.col("detection_count").desc(), "latitude", "longitude").limit(top)


def date_span(rows: DataFrame) -> DataFrame:
    day_us = 86_400_000_000
    return rows.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
                    F.count_distinct(utc_day(F.col("timestamp"))).alias("unique_dates")).select(
        "start", "end", F.when(F.col("start").isNull(), F.lit(0)).otherwise(
            F.floor((F.unix_micros("end") - F.unix_micros("start")) / F.lit(day_us)) + 1).cast("long").alias("span_days"),
        "unique_dates")


def data_quality_report(rows: DataFrame, events: DataFrame, linked: DataFrame) -> DataFrame:
    """One row of quality counters; an empty table gives zeros."""
    lat, lon, ts = F.col("latitude"), F.col("longitude"), F.col("timestamp")
    placed = lat.isNotNull() & lon.isNotNull()
    base = rows.agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_if(placed).alias("coordinates_valid"),
        F.count_if(~placed).alias("coordinates_invalid"), F.count_if(lat.isNull()).alias("missing_latitude"),
        F.count_if(lon.isNull()).alias("missing_longitude"), F.count_if(ts.isNotNull()).alias("timestamps_valid"),
        F.count_if(ts.isNull()).alias("missing_timestamp"), F.count_if(placed & ts.isNotNull()).alias("critical_valid"),
        F.min("timestamp").alias("earliest_observation"), F.max("timestamp").alias("latest_observation"))
    parts = [
        count_duplicates(rows), count_invalid_coordinates(rows), events.agg(F.count(F.lit(1)).alias("total_events")),
        orphan_events(events, linked).agg(F.count(F.lit(1)).alias("orphan_events")),
        count_mismatches(events, linked).agg(F.count(F.lit(1)).alias("count_mismatches")),
        location_recurrence(rows).agg(F.count(F.lit(1)).alias("recurring_locations")),
        source_histogram(rows.withColumn("source", F.coalesce("source", F.lit("UNKNOWN")))),
        confidence_histogram(rows).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("confidence_distribution")),
        date_span(rows).select("span_days", "unique_dates")]
    out = base
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out


def local_quality(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Confidence classes, recurring events and totals of one period."""
    c = F.col("confidence")
    one = rows.agg(F.count(F.lit(1)).alias("total_observations"), F.count_if(c < 50).alias("confidence_low"),
                   F.count_if((c >= 50) & (c < 80)).alias("confidence_medium"), F.count_if(c >= 80).alias("confidence_high"),
                   F.count_distinct(utc_day(F.col("timestamp"))).alias("days"), )
    return one.join(F.broadcast(events.agg(F.count_if(F.col("active_days") > 1).alias("recurring_locations"),
                                           F.count_distinct(utc_day(F.col("start_time"))).alias("start_days"))))


def events_by_start_day(events: DataFrame) -> DataFrame:
    return events.groupBy(utc_day(F.col("start_time")).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def size_histogram(events: DataFrame, linked: DataFrame) -> DataFrame:
    """How many events have k rows, and how many of them start and end together."""
    sizes = observations_per_event(events, linked)
    return (sizes.join(events.select("event_id", (F.col("start_time") == F.col("end_time")).alias("instant")), "event_id")
            .groupBy("n").agg(F.count(F.lit(1)).alias("events"), F.count_if("instant").alias("instant_events")))


def start_hour_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("start_time").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def readiness_audit(rows: DataFrame, events: DataFrame, risk: DataFrame) -> DataFrame:
    """Volumes, coverage, missing fields and score range for learning."""
    n = F.col("observation_count")
    parts = [
        events.agg(F.count(F.lit(1)).alias("events"), F.count_if(n >= 3).alias("events_3"), F.count_if(n >= 5).alias("events_5"),
                   F.count_if(n >= 10).alias("events_10")),
        risk.agg(F.min("risk_score").alias("score_min"), F.max("risk_score").alias("score_max"),
                 display_round(F.avg("risk_score"), 4).alias("score_avg"),
                 *(F.count_if(F.col("severity") == s).alias("severity_" + s.lower()) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")))]
    out = rows.agg(
        F.count(F.lit(1)).alias("observations"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.count_distinct(utc_day(F.col("timestamp"))).alias("unique_days"), F.min("latitude").alias("lat_min"),
        F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        F.count_if(F.col("intensity").isNull()).alias("missing_intensity"),
        F.count_if(F.col("confidence").isNull()).alias("missing_confidence"), F.count("frp").alias("with_frp"),
        F.count("track").alias("with_track"), F.count(F.coalesce("bright_ti5", "bright_t31")).alias("with_secondary"))
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out


def source_share(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("source", "n", display_round(F.col("n") / F.col("total") * 100.0, 1).alias("share_pct"))


def outside_region(events: DataFrame, linked: DataFrame) -> DataFrame:
    """Events outside the region box with their number of linked rows."""
    outside = events.filter(~in_region(F.col("latitude"), F.col("longitude")))
    return outside.select("event_id", "latitude", "longitude", "status", "start_time").join(
        observations_per_event(outside, linked).withColumnRenamed("n", "observation_count"), "event_id")


def purge_outside(events: DataFrame, linked: DataFrame, inside) -> tuple[DataFrame, DataFrame]:
    """Events kept, and rows with the links to removed events set to null."""
    kept = events.filter(inside)
    alive = kept.select("event_id", F.lit(True).alias("alive"))
    return kept, linked.join(alive, "event_id", "left").withColumn(
        "event_id", F.when(F.col("alive"), F.col("event_id"))).drop("alive")

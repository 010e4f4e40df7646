"""Behavioural profile of events: temporal, intensity, spatial, persistence, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.numeric import display_round, grid_round, hours_between, utc_day
from emberline.operators.events import max_consecutive_days, trend_nonnull_halves

# Rows needed per family of features.
MIN_ROWS = {"temporal": 2, "intensity": 1, "spatial": 2, "persistence": 2, "quality": 1}
COMPLETE_SHARE = 0.9


def history_status(n: Column, sufficient: int, insufficient: int) -> Column:
    return (F.when(n >= sufficient, F.lit(config.SUFFICIENT)).when(n >= insufficient, F.lit(config.INSUFFICIENT))
            .otherwise(F.lit(config.NO_HISTORY)))


def profile_temporal(linked: DataFrame) -> DataFrame:
    timed = linked.filter("timestamp IS NOT NULL")
    base = timed.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_detection"),
        F.max("timestamp").alias("last_detection"),
        F.count_distinct(utc_day(F.col("timestamp"))).alias("active_days"))
    trend = trend_nonnull_halves(timed).withColumnRenamed("trend", "temporal_trend")
    return (base.filter(F.col("n") >= MIN_ROWS["temporal"]).join(trend, "event_id", "left")
            .select("event_id", "first_detection", "last_detection", "active_days",
                    display_round(hours_between(F.col("first_detection"), F.col("last_detection")), 2).alias("event_duration_hours"),
                    display_round(F.col("n") / F.greatest("active_days", F.lit(1)), 2).alias("detection_frequency"),
                    F.col("active_days").alias("recurrence"),
                    F.coalesce("temporal_trend", F.lit("UNKNOWN")).alias("temporal_trend")))


def profile_intensity(linked: DataFrame) -> DataFrame:
    base = linked.groupBy("event_id").agg(
        F.avg("intensity").alias("mean"), F.max("intensity").alias("max"), F.min("intensity").alias("min"),
        F.var_pop("intensity").alias("var"), F.count("intensity").alias("n"),
        F.avg("frp").alias("frp_mean"), F.max("frp").alias("frp_max"), F.min("frp").alias("frp_min"))
    trend = trend_nonnull_halves(linked).withColumnRenamed("trend", "intensity_trend")
    rounded = {"mean_brightness_temperature": "mean", "max_brightness_temperature": "max",
               "min_brightness_temperature": "min", "intensity_variance": "var",
               "frp_mean": "frp_mean", "frp_max": "frp_max", "frp_min": "frp_min"}
    return (base.filter("n >= 1").join(trend, "event_id", "left")
            .select("event_id", *(display_round(F.col(c), 2).alias(name) for name, c in rounded.items()),
                    F.coalesce("intensity_trend", F.lit("UNKNOWN")).alias("intensity_trend")))


def profile_spatial(linked: DataFrame) -> DataFrame:
    """A higher ``spatial_stability_index`` is stabler (the plain variance is a separate metric)."""
    placed = linked.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    variance = F.var_pop("latitude") + F.var_pop("longitude")
    place = F.struct(grid_round(F.col("latitude"), 3), grid_round(F.col("longitude"), 3))
    base = placed.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"),
        ((F.max("latitude") - F.min("latitude")) * (F.max("longitude") - F.min("longitude"))).alias("spread"),
        variance.alias("variance"), F.count_distinct(place).alias("distinct_detections"))
    return base.filter(F.col("n") >= MIN_ROWS["spatial"]).select(
        "event_id", display_round(F.col("lat"), 4).alias("centroid_lat"), display_round(F.col("lon"), 4).alias("centroid_lon"),
        display_round(F.col("spread"), 8).alias("spatial_spread"), display_round(F.col("variance"), 8).alias("spatial_variance"),
        display_round(F.lit(1.0) / (F.lit(1.0) + F.col("variance")), 8).alias("spatial_stability_index"),
        "distinct_detections")


def profile_persistence(linked: DataFrame) -> DataFrame:
    sizes = linked.filter("timestamp IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("total_detections"))
    joined = sizes.filter(F.col("total_detections") >= MIN_ROWS["persistence"]).join(max_consecutive_days(linked), "event_id")
    days, run = F.col("active_days"), F.col("consecutive_active_days")
    kind = (F.when((days >= 3) & (run >= 2), "PERSISTENT").when(days >= 2, "RECURRING").otherwise("ONE_OFF"))
    score = display_round(F.col("total_detections") / days, 2)
    return joined.select(
        "event_id", "total_detections", "active_days", "consecutive_active_days", score.alias("persistence_score"),
        kind.alias("persistence_type"), score.alias("recurrence_frequency"),
        F.when(kind == "PERSISTENT", "persistent").when(kind == "RECURRING", "intermittent").otherwise("one-off")
        .alias("detection_pattern"))


def source_histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """Map source -> count per key; counts first, so a group holds one row per source."""
    return (rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_distribution")))


def profile_quality(linked: DataFrame) -> DataFrame:
    whole = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("timestamp").isNotNull()
    c = F.col("confidence")
    base = linked.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_if(whole).alias("complete"),
        display_round(F.avg(c), 2).alias("confidence_mean"), F.count_if(c < 50).alias("confidence_low"),
        F.count_if((c >= 50) & (c < 80)).alias("confidence_medium"), F.count_if(c >= 80).alias("confidence_high"),
        F.count_if(c.isNull()).alias("confidence_null"))
    share = F.col("complete") / F.col("observation_count")
    return (base.withColumn("completeness", display_round(share, 2))
            .withColumn("status", F.when(share >= COMPLETE_SHARE, config.SUFFICIENT).otherwise(config.INSUFFICIENT))
            .drop("complete").join(source_histogram(linked, "event_id"), "event_id"))


def _family(name: str, columns: list[str]) -> Column:
    """The family's struct, or null with an INSUFFICIENT_DATA status."""
    present = F.col(f"{name}_present").isNotNull()
    return F.struct(F.when(present, F.lit("AVAILABLE")).otherwise(F.lit("INSUFFICIENT_DATA")).alias("status"),
                    *(F.col(f"{name}_{c}").alias(c) for c in columns)).alias(f"{name}_features")


def thermal_profile(linked: DataFrame) -> DataFrame:
    """The nested profile; every family sits behind its minimum number of rows."""
    families = {"temporal": profile_temporal(linked), "intensity": profile_intensity(linked),
                "spatial": profile_spatial(linked), "persistence": profile_persistence(linked)}
    quality = profile_quality(linked)
    out = quality.select("event_id", "observation_count", F.struct(
        *(c for c in quality.columns if c not in ("event_id", "observation_count"))).alias("data_quality"))
    columns = {}
    for name, frame in families.items():
        columns[name] = [c for c in frame.columns if c != "event_id"]
        out = out.join(frame.select("event_id", F.lit(True).alias(f"{name}_present"),
                                    *(F.col(c).alias(f"{name}_{c}") for c in columns[name])), "event_id", "left")
    return out.select("event_id", "observation_count",
                      history_status(F.col("observation_count"), 3, 1).alias("baseline_status"),
                      *(_family(name, columns[name]) for name in families), "data_quality")


def flatten_profile(profile: DataFrame) -> DataFrame:
    """Flat projection of the nested profile, the shape of the profile table."""
    return profile.select(
        "event_id", F.col("temporal_features.first_detection").alias("first_detection"),
        F.col("temporal_features.last_detection").alias("last_detection"),
        F.col("temporal_features.active_days").alias("active_days"),
        F.col("temporal_features.event_duration_hours").alias("duration_hours"),
        F.col("temporal_features.detection_frequency").alias("detection_frequency"),
        F.col("temporal_features.recurrence").alias("recurrence"),
        F.col("temporal_features.temporal_trend").alias("temporal_pattern"),
        F.col("temporal_features.temporal_trend").alias("trend"),
        F.col("intensity_features.mean_brightness_temperature").alias("average_intensity"),
        F.col("intensity_features.max_brightness_temperature").alias("max_intensity"),
        F.col("intensity_features.min_brightness_temperature").alias("min_intensity"),
        F.col("intensity_features.intensity_variance").alias("intensity_variance"),
        F.col("intensity_features.intensity_trend").alias("intensity_trend"),
        F.col("intensity_features.frp_mean").alias("frp_mean"), F.col("intensity_features.frp_max").alias("frp_max"),
        F.col("spatial_features.centroid_lat").alias("centroid_lat"),
        F.col("spatial_features.centroid_lon").alias("centroid_lon"),
        F.col("spatial_features.spatial_spread").alias("spatial_spread"),
        F.col("spatial_features.spatial_variance").alias("spatial_variance"),
        F.col("spatial_features.spatial_stability_index").alias("spatial_stability_index"),
        F.col("spatial_features.distinct_detections").alias("distinct_detections"),
        F.col("persistence_features.persistence_score").alias("persistence_score"),
        F.col("persistence_features.consecutive_active_days").alias("consecutive_active_days"),
        F.col("persistence_features.persistence_type").alias("persistence_type"),
        "observation_count",
        F.col("data_quality.confidence_mean").alias("confidence_mean"),
        F.col("data_quality.confidence_low").alias("confidence_low"),
        F.col("data_quality.confidence_medium").alias("confidence_medium"),
        F.col("data_quality.confidence_high").alias("confidence_high"),
        F.col("data_quality.confidence_null").alias("confidence_null"),
        F.col("data_quality.source_distribution").alias("source_distribution"),
        F.col("data_quality.completeness").alias("data_completeness"), "baseline_status",
        F.coalesce(F.col("temporal_features.detection_frequency"), F.lit(0.0)).alias("frequency"))

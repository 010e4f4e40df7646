"""Feature vectors of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.numeric import hours_between, utc_day
from emberline.operators.events import first_day_rows, persistence_metrics
from emberline.session import materialize

# Feature names in vector order.
FEATURES = (
    "observation_count", "active_days", "persistence_score", "duration_hours",
    "temporal_trend", "spatial_stability",
    "mean_intensity", "max_intensity", "intensity_variance",
    "mean_confidence", "mean_frp", "max_frp", "frp_variance",
    "mean_secondary_brightness", "mean_scan", "mean_track", "night_fraction",
    "spatial_spread_km", "recurrence_days", "historical_activity",
    "facility_distance_km",
)
# The features that the first day alone can give.
FIRST_DAY_FEATURES = (
    "observation_count", "temporal_trend", "spatial_stability",
    "mean_intensity", "max_intensity", "intensity_variance", "mean_frp", "max_frp",
    "frp_variance", "mean_secondary_brightness", "mean_scan", "mean_track",
    "night_fraction", "spatial_spread_km",
)
# Trend codes.
TREND_CODES = {"DECREASING": -1.0, "STABLE": 0.0, "INCREASING": 1.0}


def extract_features(linked: DataFrame, metrics: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """One row of doubles per event; missing measurements and context stay null.

    ``context`` may bring event_id, historical_activity and facility_distance_km.
    The spread needs the centroid first, hence one join back of a narrow row set.
    Wide sums are written before the joins, so that no task holds both.
    """
    if metrics is None:
        metrics = materialize(persistence_metrics(linked).select("event_id", "active_days", "persistence_score", "trend", "spatial_stability"), "feature_scores")
    night = F.upper("daynight")
    several = F.count("intensity") >= 2
    basic = materialize(linked.groupBy("event_id").agg(
        F.count(F.lit(1)).cast("double").alias("observation_count"),
        F.when(F.count("timestamp") >= 2, hours_between(F.min("timestamp"), F.max("timestamp"))).alias("duration_hours"),
        F.avg("intensity").alias("mean_intensity"), F.max("intensity").alias("max_intensity"),
        F.when(several, F.var_pop("intensity")).alias("intensity_variance"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("frp").alias("mean_frp"), F.max("frp").alias("max_frp"),
        F.when(F.count("frp") >= 2, F.var_pop("frp")).alias("frp_variance"),
        F.avg(F.coalesce("bright_ti5", "bright_t31")).alias("mean_secondary_brightness"),
        F.avg("scan").alias("mean_scan"), F.avg("track").alias("mean_track"),
        F.avg(F.when(night == "N", 1.0).when(night == "D", 0.0)).alias("night_fraction"),
        F.count_distinct(utc_day(F.col("timestamp"))).cast("double").alias("recurrence_days"),
        F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"),
        (F.count("latitude") >= 2).alias("placed")), "feature_sums")
    scale = F.lit(config.METERS_PER_DEGREE / 1000.0)
    north = scale * (F.col("latitude") - F.col("centre_lat"))
    east = scale * F.cos(F.radians("centre_lat")) * (F.col("longitude") - F.col("centre_lon"))
    spread = (linked.select("event_id", "latitude", "longitude")
              .join(basic.filter("placed").select("event_id", "centre_lat", "centre_lon"), "event_id")
              .groupBy("event_id").agg(F.sqrt(F.max(north * north + east * east)).alias("spatial_spread_km")))
    code = F.when(F.lit(False), F.lit(0.0))
    for name, value in TREND_CODES.items():
        code = code.when(F.col("trend") == name, F.lit(value))
    scores = metrics.select("event_id", F.col("active_days").cast("double").alias("active_days"), "persistence_score",
                            code.alias("temporal_trend"), "spatial_stability")
    out = basic.join(scores, "event_id").join(spread, "event_id", "left")
    if context is not None:
        out = out.join(context, "event_id", "left")
    for name in ("historical_activity", "facility_distance_km"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.select("event_id", *(F.col(name).cast("double").alias(name) for name in FEATURES))


def first_day_features(linked: DataFrame) -> DataFrame:
    """Features from the event's first calendar day only."""
    return extract_features(first_day_rows(linked)).select("event_id", *FIRST_DAY_FEATURES)

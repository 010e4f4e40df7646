"""Statistics over periods and places, baselines and deviations from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.numeric import display_round, hours_between, utc_day
from emberline.operators.geojoin import radius_box_join, radius_circle_join
from emberline.operators.profile import history_status, source_histogram
from emberline.operators.quantiles import exact_quantiles

# Deviation limits against a baseline.
ELEVATED_FACTOR = 1.5
BELOW_FACTOR = 0.5
INTENSITY_MARGIN_K = 10.0
FRESH_HOURS = 24


def time_range(rows: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None,
               column: str = "timestamp") -> DataFrame:
    """start inclusive, end exclusive, UTC."""
    if start is not None:
        rows = rows.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col(column) < F.lit(end).cast("timestamp"))
    return rows


def recent(rows: DataFrame, hours: float, as_of: datetime | str | None = None, column: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours`` before ``as_of`` (default: the newest row)."""
    span = F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    if as_of is not None:
        return rows.filter(F.col(column) >= F.lit(as_of).cast("timestamp") - span)
    # resolved first, so that the limit reaches the files as a literal
    newest = rows.agg(F.unix_micros(F.max(column)).alias("as_of")).first()["as_of"]
    if newest is None:
        return rows.filter(F.lit(False))
    return rows.filter(F.col(column) >= F.timestamp_micros(F.lit(newest - int(hours * 3600) * 1_000_000)))


def freshness_columns(latest: Column, as_of: Column) -> tuple[Column, Column]:
    age = F.greatest(hours_between(latest, as_of), F.lit(0.0))
    state = F.when(latest.isNull(), "UNKNOWN").when(age <= FRESH_HOURS, "FRESH").otherwise("STALE")
    return F.when(latest.isNotNull(), display_round(age, 2)), state


def daily_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(utc_day(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def weekly_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.weekofyear("timestamp").alias("week")).agg(F.count(F.lit(1)).alias("n"))


def monthly_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.month("timestamp").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def last_days_trend(rows: DataFrame, days: int = 7) -> DataFrame:
    """The last active days with their counts, as one line of text."""
    last = daily_counts(rows).orderBy(F.col("day").desc()).limit(days)
    items = F.array_sort(F.collect_list(F.concat(F.date_format("day", "MM-dd"), F.lit("="), F.col("n").cast("string"))))
    return last.agg(F.array_join(items, ",").alias("trend"))


def intensity_distribution(rows: DataFrame, column: str = "intensity", digits: int = 2) -> DataFrame:
    plain = rows.agg(F.avg(column).alias("mean"), F.when(F.count(column) > 1, F.stddev_pop(column)).alias("std"),
                     F.min(column).alias("min"), F.max(column).alias("max"))
    quartiles = exact_quantiles(rows, column, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    one = plain.join(F.broadcast(quartiles))
    return one.select(*(display_round(F.col(c), digits).alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75")))


def event_durations(events: DataFrame) -> DataFrame:
    return events.select("event_id", hours_between(F.col("start_time"), F.col("end_time")).alias("hours"))


def event_duration_distribution(events: DataFrame) -> DataFrame:
    return intensity_distribution(event_durations(events), "hours").select("mean", "median", "std")


def _peak(rows: DataFrame, key: Column, keys: tuple[str, ...]) -> DataFrame:
    counts = rows.groupBy(*keys, key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts


def hour_of(ts: str = "timestamp") -> Column:
    return F.hour(ts)


def weekday_of(ts: str = "timestamp") -> Column:
    return F.date_format(ts, "EEEE")


def activity_peaks(rows: DataFrame, *keys: str) -> DataFrame:
    """Peak hour and weekday with their histograms; the smallest wins ties."""
    hours = _peak(rows, hour_of(), keys).groupBy(*keys).agg(
        F.max_by("k", F.struct(F.col("n"), (-F.col("k")).alias("m"))).alias("peak_hour"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("hourly_distribution"))
    counts = _peak(rows, weekday_of(), keys)
    best = counts.groupBy(*keys).agg(F.max("n").alias("most"))
    tied = counts.join(best, list(keys)) if keys else counts.join(F.broadcast(best))
    days = tied.groupBy(*keys).agg(
        F.min(F.when(F.col("n") == F.col("most"), F.col("k"))).alias("peak_day"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("daily_distribution"))
    return hours.join(days, list(keys)) if keys else hours.join(F.broadcast(days))


def value_histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def historical_statistics(rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row that sums up a period; maps hold days, weeks, months, sources."""
    base = rows.agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct(utc_day(F.col("timestamp"))).alias("unique_days"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"),
        F.max("longitude").alias("lon_max"), F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"))

    def as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "n")))).alias(name))

    parts = [
        as_map(daily_counts(rows), "day", "daily_activity"), as_map(weekly_counts(rows), "week", "weekly_activity"),
        as_map(monthly_counts(rows), "month", "monthly_activity"),
        intensity_distribution(rows).select(F.struct("*").alias("intensity_distribution")),
        event_duration_distribution(events).select(F.struct("*").alias("duration_distribution")),
        events.agg(F.count(F.lit(1)).alias("event_count")), activity_peaks(rows).select("peak_hour", "peak_day"),
        source_histogram(rows), as_map(value_histogram(rows, "confidence").filter("value IS NOT NULL"), "value", "confidence_distribution")]
    out = base
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    n, days = F.col("observation_count"), F.col("unique_days")
    return (out.withColumn("detection_frequency", display_round(n / F.greatest(days, F.lit(1)), 2))
            .withColumn("status", F.when(n >= 10, config.SUFFICIENT).otherwise(config.INSUFFICIENT)))


def location_statistics(points: DataFrame, rows: DataFrame, radius_km: float = config.BASELINE_RADIUS_KM,
                        key: str = "point_id") -> DataFrame:
    """Statistics of the detections in the box around each point; points without any stay."""
    near = radius_box_join(points, rows, radius_km, key)
    base = near.groupBy(key).agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct(utc_day(F.col("timestamp"))).alias("unique_days"),
        F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"),
        display_round(F.avg("intensity"), 2).alias("intensity_mean"), display_round(F.max("intensity"), 2).alias("intensity_max"),
        display_round(F.min("intensity"), 2).alias("intensity_min"), display_round(F.stddev_pop("intensity"), 2).alias("intensity_std"))
    full = base.join(activity_peaks(near, key), key).join(source_histogram(near, key), key)
    out = points.select(key).join(full, key, "left")
    n = F.coalesce(F.col("observation_count"), F.lit(0))
    return out.withColumn("observation_count", n).withColumn("baseline_status", history_status(n, 5, 2))


def location_baseline(points: DataFrame, rows: DataFrame, events: DataFrame, radius_km: float = config.BASELINE_RADIUS_KM,
                      key: str = "point_id") -> DataFrame:
    """Expected frequency, intensity, recurrence, duration and peaks per point.

    The full form needs five detections; with two to four only the partial fields
    are given, with fewer none.
    """
    stats = location_statistics(points, rows, radius_km, key)
    near = radius_box_join(points, rows, radius_km, key).filter("event_id IS NOT NULL").select(key, "event_id").distinct()
    durations = (near.join(event_durations(events), "event_id").groupBy(key)
                 .agg(display_round(F.avg("hours"), 2).alias("mean_duration")))
    full = F.col("baseline_status") == config.SUFFICIENT
    some = F.col("baseline_status") != config.NO_HISTORY
    frequency = display_round(F.col("observation_count") / F.greatest("unique_days", F.lit(1)), 2)
    return stats.join(durations, key, "left").select(
        key, F.col("baseline_status").alias("status"), "observation_count",
        F.when(full, frequency).alias("expected_detection_frequency"),
        F.when(some, F.col("intensity_min")).alias("expected_intensity_min"),
        F.when(some, F.col("intensity_max")).alias("expected_intensity_max"),
        F.when(some, F.col("intensity_mean")).alias("expected_intensity_mean"),
        F.when(some, F.col("unique_days")).alias("expected_recurrence"),
        F.when(full, F.col("mean_duration")).alias("expected_duration"),
        F.when(some, F.col("peak_hour")).alias("peak_hour"), F.when(some, F.col("peak_day")).alias("peak_day"))


def _verdict(current: Column, low: Column, high: Column) -> Column:
    return (F.when(current.isNull() | high.isNull(), F.lit(None).cast("string")).when(current > high, "elevated")
            .when(current >= low, "normal").otherwise("below_baseline"))


def _percent(current: Column, expected: Column) -> Column:
    return F.when(expected > 0, display_round((current - expected) / expected * F.lit(100.0), 1))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, key: str = "point_id") -> DataFrame:
    """Frequency, intensity and duration of current detections against the baseline, per point.

    ``current`` holds the joined detections of the current window (with the key).
    """
    now = current.groupBy(key).agg(
        F.count(F.lit(1)).alias("current_count"), F.avg("intensity").alias("current_mean"),
        F.when(F.count("timestamp") >= 2, hours_between(F.min("timestamp"), F.max("timestamp"))).alias("current_hours"))
    both = baseline.join(now, key, "left")
    usable = F.col("status") == config.SUFFICIENT
    freq = F.when(usable, F.col("expected_detection_frequency"))
    mean = F.when(usable & (F.col("expected_intensity_mean") != 0), F.col("expected_intensity_mean"))
    hours = F.when(usable, F.col("expected_duration"))
    up, down, margin = F.lit(ELEVATED_FACTOR), F.lit(BELOW_FACTOR), F.lit(INTENSITY_MARGIN_K)
    count, c_mean, c_hours = F.col("current_count"), F.col("current_mean"), F.col("current_hours")
    compared = both.select(
        key, F.col("status").alias("baseline_status"), "current_count",
        _percent(count, freq).alias("frequency_pct"), _verdict(count, freq * down, freq * up).alias("frequency_status"),
        display_round(c_mean - mean, 2).alias("intensity_deviation_k"), _percent(c_mean, mean).alias("intensity_pct"),
        _verdict(c_mean, mean - margin, mean + margin).alias("intensity_status"),
        _percent(c_hours, hours).alias("duration_pct"), _verdict(c_hours, hours * down, hours * up).alias("duration_status"))
    verdicts = F.array_compact(F.array("frequency_status", "intensity_status", "duration_status"))
    overall = (F.when(F.col("baseline_status") != config.SUFFICIENT, config.INSUFFICIENT)
               .when(F.col("current_count").isNull(), "NO_DATA")
               .when(F.array_contains(verdicts, "elevated"), "ELEVATED_RELATIVE_TO_BASELINE")
               .when(F.size(verdicts) > 0, "NORMAL").otherwise("INSUFFICIENT_DATA"))
    return compared.withColumn("status", overall)


def local_statistics(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Totals of a period and of the events that have a detection in it."""
    touched = events.join(rows.select("event_id").distinct(), "event_id", "left_semi")
    counts = rows.agg(F.count(F.lit(1)).alias("total_observations"))
    seen = touched.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("status") != "RESOLVED").alias("active_locations"),
                       F.count_if(F.col("status") == "PERSISTENT").alias("persistent_sources"))
    return counts.join(F.broadcast(seen))


def daily_source_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy(utc_day(F.col("timestamp")).alias("day"), "source").agg(
        F.count(F.lit(1)).alias("n"), display_round(F.avg("intensity"), 2).alias("average_intensity"))


def local_location_statistics(points: DataFrame, rows: DataFrame, radius_km: float = config.BASELINE_RADIUS_KM,
                              key: str = "point_id") -> DataFrame:
    near = radius_circle_join(points, rows, radius_km, key)
    stats = near.groupBy(key).agg(
        F.count(F.lit(1)).alias("observation_count"), display_round(F.avg("intensity"), 2).alias("average_intensity"),
        F.max("intensity").alias("max_intensity"), F.min("intensity").alias("min_intensity"),
        F.count_distinct(utc_day(F.col("timestamp"))).alias("active_days"))
    out = points.select(key).join(stats.join(source_histogram(near, key), key), key, "left")
    return (out.withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
            .withColumn("active_days", F.coalesce("active_days", F.lit(0))))


def daily_full_outer(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Detections and event starts per day, zero filled on both sides."""
    seen = daily_counts(rows).withColumnRenamed("n", "observations")
    begun = events.groupBy(utc_day(F.col("start_time")).alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return seen.join(begun, "day", "full").select(
        "day", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("events", F.lit(0)).alias("events"))


def union_days(rows: DataFrame, events: DataFrame) -> DataFrame:
    return (rows.select(utc_day(F.col("timestamp")).alias("day")).union(events.select(utc_day(F.col("start_time")).alias("day")))
            .distinct())


def feed_status(rows: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    one = rows.agg(F.count(F.lit(1)).alias("observation_count"), F.max("timestamp").alias("latest_observation")).join(
        F.broadcast(events.agg(F.count(F.lit(1)).alias("event_count"))))
    age, state = freshness_columns(F.col("latest_observation"), as_of)
    return one.select("observation_count", "event_count", "latest_observation", age.alias("age_hours"), state.alias("freshness"))

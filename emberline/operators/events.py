"""Per-event metrics over linked observations (rows carrying event_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.numeric import display_round, hours_between, utc_day
from emberline.operators.ranking import rank_within


def trend_from_means(first: Column, second: Column) -> Column:
    """Ten per cent of the first mean (1.0 if it is zero) separates the trends."""
    threshold = F.when(first != 0, F.abs(first) * F.lit(0.1)).otherwise(F.lit(1.0))
    change = second - first
    return (F.when(first.isNull() | second.isNull(), F.lit("UNKNOWN"))
            .when(change > threshold, F.lit("INCREASING"))
            .when(change < -threshold, F.lit("DECREASING"))
            .otherwise(F.lit("STABLE")))


def _halves(ranked_half: Column, rank: str = "rank") -> tuple[Column, Column]:
    first = F.avg(F.when(F.col(rank) <= ranked_half, F.col("intensity")))
    second = F.avg(F.when(F.col(rank) > ranked_half, F.col("intensity")))
    return first, second


def _half() -> Column:
    return F.floor(F.col("size") / F.lit(2))


def trend_half_split(linked: DataFrame, largest: int | None = None) -> DataFrame:
    """Mean intensity of the earlier against the later half of an event's rows."""
    rows = linked.filter("timestamp IS NOT NULL").select("event_id", "timestamp", "obs_id", "intensity")
    first, second = _halves(_half())
    return (rank_within(rows, ["event_id"], ["timestamp", "obs_id"], largest=largest)
            .groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), first.alias("first_mean"), second.alias("second_mean"))
            .select("event_id", F.when(F.col("n") < 4, F.lit("UNKNOWN")).otherwise(
                trend_from_means(F.col("first_mean"), F.col("second_mean"))).alias("trend")))


def trend_nonnull_halves(linked: DataFrame, largest: int | None = None) -> DataFrame:
    """As above over the rows that have an intensity; two of them are enough."""
    rows = linked.filter("intensity IS NOT NULL").select("event_id", "timestamp", "obs_id", "intensity")
    first, second = _halves(_half())
    return (rank_within(rows, ["event_id"], ["timestamp", "obs_id"], largest=largest)
            .groupBy("event_id").agg(first.alias("first_mean"), second.alias("second_mean"))
            .select("event_id", trend_from_means(F.col("first_mean"), F.col("second_mean")).alias("trend")))


def persistence_metrics(linked: DataFrame, largest: int | None = None, order: Sequence[str] = ("timestamp", "obs_id")) -> DataFrame:
    """Counts, active days, score, intensity and stability per event, in one pass.

    Ranking and aggregation share the partitioning by event, so the rows are
    shuffled once. ``order`` puts an event's rows in their order, for the halves of its trend.
    """
    rows = linked.select("event_id", "intensity", "latitude", "longitude", "timestamp", *(c for c in order if c != "timestamp"))
    ranked = rank_within(rows, ["event_id"], order, largest=largest)
    first, second = _halves(_half())
    wide = ranked.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.count_distinct(utc_day(F.col("timestamp"))).alias("active_days"),
        F.avg("intensity").alias("mean_i"), F.var_pop("intensity").alias("var_i"),
        (F.var_pop("latitude") + F.var_pop("longitude")).alias("var_place"),
        F.min("timestamp").alias("first_detection"), F.max("timestamp").alias("last_detection"),
        first.alias("first_mean"), second.alias("second_mean"))
    n = F.col("total_detections")
    return wide.select(
        "event_id", "total_detections", "active_days",
        display_round(n / F.greatest("active_days", F.lit(1)), 2).alias("persistence_score"),
        display_round(F.col("mean_i"), 2).alias("average_intensity"),
        display_round(F.col("var_i"), 2).alias("intensity_variance"),
        F.when(n > 1, display_round(F.col("var_place"), 8)).alias("spatial_stability"),
        "first_detection", "last_detection",
        F.when(n < 4, F.lit("UNKNOWN")).otherwise(
            trend_from_means(F.col("first_mean"), F.col("second_mean"))).alias("trend"))


def max_consecutive_days(linked: DataFrame) -> DataFrame:
    """Longest run of consecutive UTC days per event (gaps and islands over distinct days)."""
    days = (linked.filter("timestamp IS NOT NULL")
            .select("event_id", utc_day(F.col("timestamp")).alias("day")).distinct())
    # One row per event and day: a group is as long as the calendar, not as the data.
    numbered = rank_within(days, ["event_id"], ["day"], largest=0)
    island = F.date_sub(F.col("day"), F.col("rank").cast("int"))
    return (numbered.groupBy("event_id", island.alias("island")).agg(F.count(F.lit(1)).alias("run"))
            .groupBy("event_id").agg(F.max("run").alias("consecutive_active_days"), F.sum("run").alias("active_days")))


def persistent_sources(events: DataFrame, min_detections: int = config.PERSISTENCE_MIN_DETECTIONS) -> DataFrame:
    return (events.filter(F.col("observation_count") >= F.lit(min_detections))
            .withColumn("persistence_type", F.lit("CONFIRMED"))
            .withColumn("persistence_score", F.col("observation_count"))
            .withColumn("active_days_estimate", F.greatest(F.lit(1), F.floor(F.col("observation_count") / 2)).cast("long")))


def lifecycle_status(last: Column, as_of: Column, active_days: Column, detections: Column,
                     resolved_after_hours: float = config.RESOLVED_AFTER_HOURS,
                     min_days: int = config.PERSISTENT_MIN_DAYS,
                     min_detections: int = config.PERSISTENCE_MIN_DETECTIONS) -> Column:
    return (F.when(hours_between(last, as_of) > F.lit(float(resolved_after_hours)), F.lit("RESOLVED"))
            .when((active_days >= min_days) & (detections >= min_detections), F.lit("PERSISTENT"))
            .otherwise(F.lit("ACTIVE")))


def with_as_of(df: DataFrame, ts: str, name: str = "as_of", source: DataFrame | None = None) -> DataFrame:
    """Attach the newest timestamp of the data (a one-row side, broadcast)."""
    newest = (source if source is not None else df).agg(F.max(ts).alias(name))
    return df.join(F.broadcast(newest))


def event_table(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """Stored shape of events: summary, score and lifecycle status."""
    joined = events.join(metrics, "event_id")
    return (with_as_of(joined, "end_time")
            .withColumn("status", lifecycle_status(F.col("end_time"), F.col("as_of"), F.col("active_days"),
                                                   F.col("observation_count"))).drop("as_of"))


def stable_event_ids(linked: DataFrame) -> DataFrame:
    """Ids that survive a replay: 100000 + 8 hex digits of the earliest member's hash.

    Colliding ids are counted up in event order. All events with one hash form a
    group of practically one row.
    """
    earliest = linked.groupBy("event_id").agg(
        F.min_by(F.struct("source", "latitude", "longitude", "timestamp"), F.struct("timestamp", "obs_id")).alias("m"))
    iso = F.date_format("m.timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    identity = F.concat_ws("|", F.col("m.source"), F.format_string("%.5f", F.col("m.latitude")),
                           F.format_string("%.5f", F.col("m.longitude")), F.concat(iso, F.lit("+00:00")))
    base = F.conv(F.substring(F.sha2(identity, 256), 1, 8), 16, 10).cast("long") + F.lit(100000)
    hashed = earliest.select("event_id", base.alias("base"))
    ranked = rank_within(hashed, ["base"], ["event_id"], largest=0)
    return ranked.select("event_id", (F.col("base") + F.col("rank") - 1).alias("stable_id"))


def first_last_observation(linked: DataFrame) -> DataFrame:
    order = F.struct("timestamp", "obs_id")
    row = F.struct("obs_id", "timestamp", "latitude", "longitude", "intensity", "source")
    return linked.groupBy("event_id").agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))


def confidence_category_first(linked: DataFrame) -> DataFrame:
    """First known category in time order; null when the event has none."""
    order = F.when(F.col("confidence_category").isNotNull(), F.struct("timestamp", "obs_id"))
    return linked.groupBy("event_id").agg(F.min_by("confidence_category", order).alias("confidence_category"))


def daily_history_first(linked: DataFrame) -> DataFrame:
    """Per event and day: the first row's values and the day's count."""
    order = F.struct("timestamp", "obs_id")
    return (linked.groupBy("event_id", utc_day(F.col("timestamp")).alias("day"))
            .agg(F.min("timestamp").alias("timestamp"), F.min_by("intensity", order).alias("intensity"),
                 F.min_by("confidence", order).alias("confidence"), F.count(F.lit(1)).alias("observation_count")))


def daily_history_avg(linked: DataFrame) -> DataFrame:
    return (linked.groupBy("event_id", utc_day(F.col("timestamp")).alias("day"))
            .agg(F.min("timestamp").alias("timestamp"), display_round(F.avg("intensity"), 2).alias("intensity"),
                 display_round(F.avg("confidence"), 2).alias("confidence"), F.count(F.lit(1)).alias("observation_count")))


def listing_aggregates(linked: DataFrame) -> DataFrame:
    """Count, means and the source, or MULTIPLE when there are several.

    Two extremes tell one source from several, so no distinct count is needed.
    """
    return linked.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("observation_count"), F.avg("intensity").alias("average_intensity"),
        F.avg("confidence").alias("average_confidence"),
        F.when(F.min("source") == F.max("source"), F.min("source")).otherwise(F.lit("MULTIPLE")).alias("source"))


def summary_dna(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "event_id", F.col("trend").alias("persistence"),
        F.format_string("%.1f detections/day", F.col("persistence_score")).alias("frequency"),
        F.col("average_intensity").alias("intensity"), "spatial_stability", "trend", "total_detections", "active_days")


def first_day_rows(linked: DataFrame) -> DataFrame:
    """Rows on the event's first UTC day.

    The first day is a combinable ``min``; rows come back by a semi-join on
    (event, day), so a giant event is spread by nothing worse than one day of it.
    """
    dated = linked.withColumn("day", utc_day(F.col("timestamp")))
    first = dated.groupBy("event_id").agg(F.min("day").alias("day"))
    return dated.join(first, ["event_id", "day"], "left_semi")

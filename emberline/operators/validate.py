"""Audit of raw detection rows: reasons, duplicates, report, quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import grid_round
from emberline.functions.parsing import (BRIGHTNESS_FIELDS, MISSING_CONFIDENCE_TOKENS, acquisition_time,
                                         confidence_category, confidence_percent, with_measurements)

# Rejection reasons in the order in which they are given.
REASONS = (
    "MALFORMED_RECORD",
    "INVALID_COORDINATES",
    "MISSING_COORDINATES",
    "INVALID_TIMESTAMP",
    "INVALID_BRIGHTNESS",
    "INVALID_FRP",
    "INVALID_SCAN",
    "INVALID_TRACK",
    "INVALID_CONFIDENCE",
    "DUPLICATE_OBSERVATION",
)
MISSING_FIELDS = ("coordinates", "brightness", "frp", "scan", "track", "confidence")


def _columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named columns that the feed has, whatever the case of its header."""
    present = {name.lower(): name for name in df.columns}
    found = [F.col(f"`{present[name.lower()]}`") for name in names if name.lower() in present]
    return found or [F.lit(None).cast("string")]


def check_rows(raw: DataFrame) -> DataFrame:
    """Every raw row with its parsed fields, its error flags and its first reason."""
    fields = {
        "p_lat": (_columns(raw, ["latitude"]), -90.0, 90.0),
        "p_lon": (_columns(raw, ["longitude"]), -180.0, 180.0),
        "p_brightness": (_columns(raw, BRIGHTNESS_FIELDS), 200.0, 500.0),
        "p_frp": (_columns(raw, ["frp"]), 0.0, 15000.0),
        "p_scan": (_columns(raw, ["scan"]), 0.0, 20.0),
        "p_track": (_columns(raw, ["track"]), 0.0, 20.0),
        "p_confidence": (_columns(raw, ["confidence"]), 0.0, 100.0),
    }
    conf = F.lower(F.trim(F.coalesce(_columns(raw, ["confidence"])[0], F.lit(""))))
    malformed = F.col("_malformed") if "_malformed" in raw.columns else F.lit(False)
    measured = with_measurements(raw, fields)
    parsed = measured.select("*", acquisition_time(_columns(raw, ["acq_date"])[0], _columns(raw, ["acq_time"])[0]).alias("p_time"),
                             conf.alias("p_conf"), malformed.alias("p_malformed"))

    def bad(name: str) -> Column:
        return F.col(f"p_{name}_error").isNotNull()

    def value(name: str) -> Column:
        return F.col(f"p_{name}_value")

    def absent(name: str) -> Column:
        return value(name).isNull() & ~bad(name)

    def not_positive(name: str) -> Column:
        return bad(name) | F.coalesce(value(name) <= 0, F.lit(False))

    origin = F.coalesce((value("lat") == 0) & (value("lon") == 0), F.lit(False))
    missing_conf = F.col("p_conf").isin(*MISSING_CONFIDENCE_TOKENS)
    flagged = parsed.select(
        "*",
        (bad("lat") | bad("lon") | origin).alias("bad_coordinates"),
        F.col("p_time").isNull().alias("bad_timestamp"),
        bad("brightness").alias("bad_brightness"), bad("frp").alias("bad_frp"),
        not_positive("scan").alias("bad_scan"), not_positive("track").alias("bad_track"),
        (~missing_conf & ~F.col("p_conf").isin("h", "n", "l") & bad("confidence")).alias("bad_confidence"),
        absent("brightness").alias("missing_brightness"), absent("frp").alias("missing_frp"),
        absent("scan").alias("missing_scan"), absent("track").alias("missing_track"),
        missing_conf.alias("missing_confidence"),
    )
    flagged = flagged.withColumn("missing_coordinates", ~F.col("bad_coordinates") & (value("lat").isNull() | value("lon").isNull()))
    reason = (F.when(F.col("bad_coordinates"), F.lit("INVALID_COORDINATES"))
              .when(F.col("missing_coordinates"), F.lit("MISSING_COORDINATES"))
              .when(F.col("p_malformed"), F.lit("MALFORMED_RECORD"))
              .when(F.col("bad_timestamp"), F.lit("INVALID_TIMESTAMP"))
              .when(F.col("bad_brightness"), F.lit("INVALID_BRIGHTNESS"))
              .when(F.col("bad_frp"), F.lit("INVALID_FRP"))
              .when(F.col("bad_scan"), F.lit("INVALID_SCAN"))
              .when(F.col("bad_track"), F.lit("INVALID_TRACK"))
              .when(F.col("bad_confidence"), F.lit("INVALID_CONFIDENCE")))
    return flagged.withColumn("reason", reason)


def duplicate_key(lat: str, lon: str, ts: str) -> list[Column]:
    return [grid_round(F.col(lat), 4).alias("key_lat"), grid_round(F.col(lon), 4).alias("key_lon"),
            F.col(ts).alias("key_time")]


def mark_duplicates(checked: DataFrame, order: str = "line_no") -> DataFrame:
    """Of equal valid rows the first in file order stays; the others get a reason.

    The first row of each key is a combinable ``min``; the mark travels back on
    the unique row order, so even one key holding a third of the table neither
    fills a task nor skews the join.
    """
    # A condition inside the aggregate, not a filter: a filter on ``reason`` would be
    # pushed to the scan and drag a second copy of every parsing expression along.
    firsts = (checked.groupBy(*duplicate_key("p_lat_value", "p_lon_value", "p_time"), "source")
              .agg(F.min(F.when(F.col("reason").isNull(), F.col(order))).alias(order))
              .filter(F.col(order).isNotNull()).select(order, F.lit(True).alias("is_first")))
    repeated = F.col("reason").isNull() & F.col("is_first").isNull()
    return (checked.join(firsts, order, "left")
            .withColumn("reason", F.when(repeated, F.lit("DUPLICATE_OBSERVATION")).otherwise(F.col("reason")))
            .drop("is_first"))


def validate_rows(raw: DataFrame, order: str = "line_no") -> DataFrame:
    return mark_duplicates(check_rows(raw), order)


def accepted_observations(validated: DataFrame) -> DataFrame:
    """Typed observations of the accepted rows; missing measurements stay null."""
    names = set(validated.columns)

    def text(name: str) -> Column:
        return F.col(name) if name in names else F.lit(None).cast("string")

    kept = ("version", "instrument", "bright_ti5", "bright_t31", "bright_ti4", "brightness")
    extras = F.map_filter(
        F.create_map(*(part for name in kept for part in (F.lit(name), text(name)))), lambda _, v: v.isNotNull())
    order = [name for name in ("line_no",) if name in names]
    return validated.filter("reason IS NULL").select(
        *order, F.col("p_time").alias("timestamp"), F.col("p_lat_value").alias("latitude"),
        F.col("p_lon_value").alias("longitude"), F.col("p_brightness_value").alias("intensity"),
        confidence_percent(F.col("p_conf")).alias("confidence"),
        confidence_category(F.col("p_conf")).alias("confidence_category"),
        "source", F.coalesce(text("sensor"), text("satellite")).alias("sensor"),
        F.col("p_frp_value").alias("frp"), F.col("p_scan_value").alias("scan"),
        F.col("p_track_value").alias("track"), text("daynight").alias("daynight"), extras.alias("metadata"))


def quarantined_rows(validated: DataFrame) -> DataFrame:
    """Rejected rows with their reason and their original text."""
    inner = [c for c in validated.columns if c.startswith(("p_", "bad_", "missing_"))]
    return validated.filter("reason IS NOT NULL").drop(*inner)


def validation_report(validated: DataFrame) -> DataFrame:
    """One row of counters; the vocabulary of reasons is fixed, so one aggregation does."""
    accepted = F.col("reason").isNull()

    def histogram(items: Sequence[tuple[str, Column]]) -> Column:
        counts = F.create_map(*(part for name, test in items for part in (F.lit(name), F.count_if(test))))
        return F.map_filter(counts, lambda _, n: n > 0)

    invalid = ("coordinates", "brightness", "frp", "scan", "track", "confidence")
    names = {"coordinates": "invalid_coordinates"}
    return validated.agg(
        F.count(F.lit(1)).alias("records_received"),
        F.count_if(accepted).alias("records_accepted"),
        F.count_if(~accepted).alias("records_rejected"),
        F.count_if(F.col("reason") == F.lit("DUPLICATE_OBSERVATION")).alias("duplicates_removed"),
        F.count_if(F.col("bad_timestamp")).alias("invalid_timestamps"),
        *(F.count_if(F.col("bad_" + n)).alias(names.get(n, "invalid_" + n)) for n in invalid),
        histogram([(n, F.col("missing_" + n)) for n in MISSING_FIELDS]).alias("missing_values"),
        histogram([(r, F.col("reason") == F.lit(r)) for r in REASONS]).alias("rejection_reasons"),
        F.min(F.when(accepted, F.col("p_time"))).alias("earliest_observation"),
        F.max(F.when(accepted, F.col("p_time"))).alias("latest_observation"))


def count_duplicates(observations: DataFrame) -> DataFrame:
    """Rows beyond the first per rounded place and time."""
    keyed = observations.filter("latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp IS NOT NULL")
    return (keyed.groupBy(*duplicate_key("latitude", "longitude", "timestamp"))
            .agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")))


def count_invalid_coordinates(observations: DataFrame) -> DataFrame:
    """A row can count twice, once per axis."""
    return observations.agg(
        (F.count_if(~F.col("latitude").between(-90.0, 90.0))
         + F.count_if(~F.col("longitude").between(-180.0, 180.0))).alias("invalid_coordinates"))

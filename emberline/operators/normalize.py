"""Normalization of feed rows into the observation shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import finite_number
from emberline.functions.parsing import (NORMALIZE_BRIGHTNESS_FIELDS, acquisition_time, blank_to_null,
                                         confidence_category, confidence_percent, first_present, flexible_time)

# Raw fields that become columns; everything else is metadata.
CORE_FIELDS = ("date", "time", "acq_date", "acq_time", "timestamp", "latitude", "longitude", "intensity",
               "confidence", "source", "satellite", "sensor", "metadata")


def _text(df: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*(blank_to_null(c) for c in present)) if present else F.lit(None).cast("string")


def _within(value: Column, limit: float) -> Column:
    return F.when(value.between(F.lit(-limit), F.lit(limit)), value)


def normalize_rows(raw: DataFrame) -> DataFrame:
    """Table form: coerce, fill the source, drop rows without place or time."""
    keep = [c for c in raw.columns if c == "line_no"]
    return raw.select(
        *keep,
        acquisition_time(_text(raw, "acq_date", "date"), _text(raw, "acq_time", "time")).alias("timestamp"),
        _within(finite_number(_text(raw, "latitude")), 90.0).alias("latitude"),
        _within(finite_number(_text(raw, "longitude")), 180.0).alias("longitude"),
        finite_number(_text(raw, *NORMALIZE_BRIGHTNESS_FIELDS)).alias("intensity"),
        confidence_percent(_text(raw, "confidence")).alias("confidence"),
        F.coalesce(_text(raw, "source", "satellite"), F.lit("UNKNOWN")).alias("source"),
    ).na.drop(subset=["latitude", "longitude", "timestamp"])


def normalize_flag_invalid(raw: DataFrame) -> DataFrame:
    """Row form: every row stays, bad coordinates become null and are flagged."""
    lat_text, lon_text = _text(raw, "latitude"), _text(raw, "longitude")
    lat, lon = _within(finite_number(lat_text), 90.0), _within(finite_number(lon_text), 180.0)
    extra = [c for c in raw.columns if c not in CORE_FIELDS and c != "line_no"]
    pairs = [part for c in extra for part in (F.lit(c), F.col(c).cast("string"))]
    pairs += [F.lit("confidence_category"), confidence_category(_text(raw, "confidence"))]
    keep = [c for c in raw.columns if c == "line_no"]
    return raw.select(
        *keep,
        flexible_time(_text(raw, "date", "timestamp", "acq_date"), _text(raw, "time", "acq_time")).alias("timestamp"),
        lat.alias("latitude"), lon.alias("longitude"),
        ((lat_text.isNotNull() & lat.isNull()) | (lon_text.isNotNull() & lon.isNull())).alias("invalid_coordinates"),
        finite_number(first_present([F.col(c) for c in NORMALIZE_BRIGHTNESS_FIELDS if c in raw.columns]
                                    or [F.lit(None).cast("string")])).alias("intensity"),
        confidence_percent(_text(raw, "confidence")).alias("confidence"),
        F.coalesce(_text(raw, "source"), _text(raw, "satellite"), F.lit("UNKNOWN")).alias("source"),
        F.coalesce(_text(raw, "sensor"), _text(raw, "satellite")).alias("sensor"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metadata"))

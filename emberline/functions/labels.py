"""Display labels and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of classes.
CLASS_LABELS = {
    "anomalous_thermal_pattern": "Anomalous Thermal Pattern (Statistical Outlier)",
    "within_capture_range": "Within Typical Capture Range",
    "industrial_thermal_source": "Industrial thermal source candidate",
    "persistent_thermal_source": "Persistent thermal source pattern",
    "industrial_fire": "Industrial fire candidate",
    "agricultural_burning": "Agricultural burning candidate",
    "natural_thermal_source": "Natural thermal source candidate",
    "temporary_thermal_event": "Short-lived thermal anomaly",
    "unknown": "Uncertain thermal anomaly",
    "other": "Other / uncertain",
}

# Display labels of statuses.
STATUS_LABELS = {
    "INSUFFICIENT_HISTORY": "Not enough historical data",
    "INSUFFICIENT_DATA": "Not enough observations",
    "DEMO_DATA": "Demonstration scenario",
    "NO_HISTORY": "No historical observations",
    "UNKNOWN": "Unknown",
}


def _lookup(labels: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def class_label(code: Column) -> Column:
    return (F.when(code.isNull() | (code == F.lit("")), F.lit("Not classified"))
            .otherwise(F.coalesce(_lookup(CLASS_LABELS, F.lower(code)), F.translate(code, "_", " "))))


def status_label(code: Column) -> Column:
    return (F.when(code.isNull() | (code == F.lit("")), F.lit("Unavailable"))
            .otherwise(F.coalesce(_lookup(STATUS_LABELS, code), F.lower(F.translate(code, "_", " ")))))


def timeline_time(ts: Column) -> Column:
    """``Sep 6, 2026 · 7:03 PM``"""
    return F.concat(F.date_format(ts, "MMM d, yyyy"), F.lit(" · "), F.date_format(ts, "h:mm a"))


def observation_time(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "MMM d, yyyy"), F.lit(", "), F.date_format(ts, "h:mm a"))


def compact_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")

"""Readable reasons for anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import display_round

# Limits used where the capture has no statistics of its own.
DEFAULT_P90 = {"max_frp": 6.0, "observation_count": 3.0, "max_intensity": 340.0, "duration_hours": 12.0}
DEFAULT_FRP_MEDIAN = 2.1
# Medians that changes are measured from where the capture has none.
CHANGE_MEDIANS = {"max_frp": 2.0, "max_intensity": 330.0}
# Output texts.
USUAL = "Thermal intensity and detection footprint fall within normal variation of this FIRMS capture"
UNUSUAL = "Multi-feature thermal and spatial combination deviates from the typical 92% envelope of this FIRMS capture"
CAVEAT = "Unsupervised anomaly score indicates relative statistical deviation; it does not determine fire cause or causality"


def _limits(stats: DataFrame) -> DataFrame:
    """One row with p90_* and the FRP median (one input row per feature)."""
    def pick(column: str, name: str, default: float) -> Column:
        return F.coalesce(F.max(F.when(F.col("feature") == name, F.col(column))), F.lit(default))

    return stats.agg(*(pick("p90", n, v).alias("p90_" + n) for n, v in DEFAULT_P90.items()),
                     pick("median", "max_frp", DEFAULT_FRP_MEDIAN).alias("median_frp"))


def _one(value: Column) -> Column:
    return F.format_string("%.1f", display_round(value, 1))


def anomaly_reasons(features: DataFrame, stats: DataFrame, anomalous: Column) -> DataFrame:
    """Ordered reasons per event against the capture's own p90 and medians."""
    f = features.join(F.broadcast(_limits(stats)))
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("max_frp") > c("p90_max_frp"), F.concat(
            F.lit("Unusually high fire radiative power (Peak FRP: "), _one(c("max_frp")), F.lit(" MW vs capture median "), _one(c("median_frp")), F.lit(" MW)"))),
        F.when(c("active_days") > 1, F.concat(
            F.lit("Multi-day temporal persistence ("), c("active_days").cast("long").cast("string"), F.lit(" active days observed across satellite overpasses)"))),
        F.when(c("observation_count") > c("p90_observation_count"), F.concat(
            F.lit("High detection cluster density ("), c("observation_count").cast("long").cast("string"), F.lit(" detections clustered in spatial footprint)"))),
        F.when(c("max_intensity") > c("p90_max_intensity"), F.concat(F.lit("Elevated peak brightness temperature ("), _one(c("max_intensity")), F.lit(" K)"))),
        F.when(c("night_fraction") >= 0.5, F.concat(
            F.lit("Predominantly nocturnal thermal detection ("), F.floor(c("night_fraction") * 100 + 1e-9).cast("string"), F.lit("% night satellite passes)"))),
        F.when(c("duration_hours") > c("p90_duration_hours"), F.concat(F.lit("Extended temporal duration ("), _one(c("duration_hours")), F.lit(" hours span)")))))
    default = F.array(F.when(anomalous, F.lit(UNUSUAL)).otherwise(F.lit(USUAL)))
    found = f.withColumn("reasons", reasons)
    return found.select("event_id", F.concat(F.when(F.size("reasons") > 0, c("reasons")).otherwise(default), F.array(F.lit(CAVEAT))).alias("reasoning"))


def anomaly_contributions(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(event_id, feature, value, probability_change): a row for each feature that stands out.

    The change is the FRP's distance from the median in medians, the intensity's distance
    in kelvin, and for the others the value itself.
    """
    medians = stats.agg(*(F.coalesce(F.max(F.when(F.col("feature") == n, F.col("median"))), F.lit(v)).alias("mid_" + n) for n, v in CHANGE_MEDIANS.items()))
    f = features.join(F.broadcast(_limits(stats))).join(F.broadcast(medians))  # one row each
    c = F.col
    changes = {
        "max_frp": (c("max_frp") > c("p90_max_frp"), display_round((c("max_frp") - c("mid_max_frp")) / F.greatest(F.lit(1.0), c("mid_max_frp")), 3)),
        "active_days": (c("active_days") > 1, c("active_days")),
        "observation_count": (c("observation_count") > c("p90_observation_count"), c("observation_count")),
        "max_intensity": (c("max_intensity") > c("p90_max_intensity"), display_round(c("max_intensity") - c("mid_max_intensity"), 1)),
        "night_fraction": (c("night_fraction") >= 0.5, c("night_fraction")),
        "duration_hours": (c("duration_hours") > c("p90_duration_hours"), display_round(c("duration_hours"), 1)),
    }
    rows = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("feature"), c(name).cast("double").alias("value"),
                                                           change.cast("double").alias("probability_change"))) for name, (test, change) in changes.items())))
    return f.select("event_id", F.inline(rows))

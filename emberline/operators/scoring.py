"""Rule-based class, confidence and risk of events, as columns over persistence metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.config import RULE_CLASSES
from emberline.functions.numeric import display_round

NO_RISK_TEXT = "No specific risk factors identified."
FORECAST_STATUS = "UNAVAILABLE_NO_VALIDATED_MODEL"


def _present(value: Column) -> Column:
    """Known and not zero."""
    return value.isNotNull() & (value != 0)


def _points(*rules: tuple[Column, float]) -> Column:
    """Sum of doubles in the order given (the order matters for the last bit)."""
    parts = [F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0)) for test, value in rules]
    return F.least(reduce(lambda a, b: a + b, parts, F.lit(0.0)), F.lit(1.0))


def classify_events(metrics: DataFrame) -> DataFrame:
    """Four additive scores, shared out to probabilities; the first best class wins."""
    n, days, score = F.col("total_detections"), F.col("active_days"), F.col("persistence_score")
    mean, trend = F.col("average_intensity"), F.col("trend")
    scores = {
        "INDUSTRIAL_THERMAL_SOURCE": _points(
            (score >= 5.0, 0.4), (days >= 3, 0.3), (trend == "STABLE", 0.2), (_present(mean) & (mean > 330), 0.1)),
        "PERSISTENT_THERMAL_SOURCE": _points(
            (score >= 3.0, 0.3), (days >= 2, 0.3), (n >= 5, 0.2), (trend.isin("STABLE", "INCREASING"), 0.2)),
        "AGRICULTURAL_BURNING": _points(
            (score.between(1.0, 5.0), 0.3), (days.between(1, 7), 0.3), (mean.between(300, 360), 0.2),
            (trend.isin("DECREASING", "STABLE"), 0.2)),
        "OTHER": _points((n <= 2, 0.5), (score < 1.0, 0.3), (trend == "UNKNOWN", 0.2)),
    }
    raw = metrics.select("*", *(column.alias("s_" + name) for name, column in scores.items()))
    total = reduce(lambda a, b: a + b, [F.col("s_" + name) for name in RULE_CLASSES])
    shared = raw.select(*metrics.columns, *(
        F.when(total > 0, F.col("s_" + name) / total).otherwise(F.lit(0.25)).alias("p_" + name) for name in RULE_CLASSES))
    best = F.greatest(*("p_" + name for name in RULE_CLASSES))
    choice = F.coalesce(*(F.when(F.col("p_" + name) == best, F.lit(name)) for name in RULE_CLASSES))
    probabilities = F.create_map(*(part for name in RULE_CLASSES for part in (F.lit(name), F.col("p_" + name))))
    return shared.select(*metrics.columns, F.when(n > 0, choice).otherwise("UNKNOWN").alias("classification"),
                         F.when(n > 0, probabilities).alias("probabilities"))


def classification_confidence(metrics: DataFrame) -> DataFrame:
    n, days, score = F.col("total_detections"), F.col("active_days"), F.col("persistence_score")
    mean, trend = F.col("average_intensity"), F.col("trend")
    confidence = F.least(
        F.when(n >= 10, 0.3).when(n >= 5, 0.2).when(n >= 2, 0.1).otherwise(0.0)
        + F.when(days >= 3, 0.2).when(days >= 1, 0.1).otherwise(0.0)
        + F.when(mean.isNotNull(), 0.2).otherwise(0.0)
        + F.when(trend != "UNKNOWN", 0.2).otherwise(0.0), F.lit(0.9))
    reasoning = F.array_compact(F.array(
        F.when(n >= 10, F.format_string("High detection count (%d observations)", n)),
        F.when(score >= 5.0, F.format_string("High persistence (%.1f detections/day)", score)),
        F.when(_present(mean), F.format_string("Average intensity: %.0fK", mean)),
        F.when(trend != "UNKNOWN", F.concat(F.lit("Temporal trend: "), trend)),
        F.when(days >= 3, F.format_string("Active for %d days", days))))
    return metrics.select("*", confidence.alias("class_confidence"), reasoning.alias("reasoning"))


def _ladder(steps: list[tuple[Column, float, Column]], weight: float) -> Column:
    """struct(factor, score, weight) of the first step that applies; the last is the default."""
    def made(score: float, text: Column) -> Column:
        return F.struct(text.alias("factor"), F.lit(score).alias("score"), F.lit(weight).alias("weight"))

    *tests, last = steps
    column = reduce(lambda acc, step: acc.when(step[0], made(step[1], step[2])), tests[1:],
                    F.when(tests[0][0], made(tests[0][1], tests[0][2])))
    return column.otherwise(made(last[1], last[2]))


def risk_scores(metrics: DataFrame) -> DataFrame:
    """Score 0-100, severity and the five weighted factors."""
    n, days, score = F.col("total_detections"), F.col("active_days"), F.col("persistence_score")
    mean, trend = F.col("average_intensity"), F.col("trend")
    always = F.lit(True)
    warm = _present(mean)

    def per_day(name: str) -> Column:
        return F.format_string(name + " persistence (%.1f/day)", score)

    def kelvin(name: str) -> Column:
        return F.format_string(name + " intensity (%.0fK)", mean)

    factors = [
        _ladder([(n >= 20, 25.0, F.lit("High detection count")), (n >= 10, 18.0, F.lit("Moderate detection count")),
                 (n >= 5, 10.0, F.lit("Low detection count")), (n >= 2, 5.0, F.lit("Minimal detections")),
                 (always, 1.0, F.lit("Single detection"))], 25.0),
        _ladder([(score >= 10.0, 25.0, per_day("High")), (score >= 5.0, 18.0, per_day("Moderate")),
                 (score >= 2.0, 10.0, per_day("Low")), (score >= 1.0, 5.0, per_day("Minimal")),
                 (always, 1.0, per_day("Minimal"))], 25.0),
        _ladder([(days >= 7, 15.0, F.format_string("Long duration (%d days)", days)),
                 (days >= 3, 10.0, F.format_string("Moderate duration (%d days)", days)),
                 (days >= 1, 5.0, F.format_string("Short duration (%d day)", days)),
                 (always, 1.0, F.lit("Single day event"))], 15.0),
        _ladder([(trend == "INCREASING", 20.0, F.lit("Escalating trend")), (trend == "STABLE", 10.0, F.lit("Stable trend")),
                 (trend == "DECREASING", 5.0, F.lit("Decreasing trend")), (always, 1.0, F.lit("Trend unknown"))], 20.0),
        _ladder([(warm & (mean >= 400), 15.0, kelvin("Very high")), (warm & (mean >= 350), 12.0, kelvin("High")),
                 (warm & (mean >= 300), 8.0, kelvin("Moderate")), (warm, 4.0, kelvin("Low")),
                 (always, 1.0, F.lit("Intensity unknown"))], 15.0),
    ]
    listed = metrics.withColumn("factors", F.array(*factors))
    raw = reduce(lambda a, b: a + b, [F.col("factors")[i]["score"] for i in range(5)])
    total = F.least(F.greatest(raw / F.lit(100.0) * F.lit(100.0), F.lit(0.0)), F.lit(100.0))
    severity = (F.when(F.col("risk_score") >= 75, "CRITICAL").when(F.col("risk_score") >= 50, "HIGH")
                .when(F.col("risk_score") >= 25, "MEDIUM").otherwise("LOW"))
    return listed.withColumn("risk_score", display_round(total, 1)).withColumn("severity", severity)


def risk_explanation(classified: DataFrame) -> DataFrame:
    """Sentences for a frame that has the metrics and the classification."""
    days, score = F.col("active_days"), F.col("persistence_score")
    mean, trend, kind = F.col("average_intensity"), F.col("trend"), F.col("classification")
    sentences = F.array_compact(F.array(
        F.when(trend == "INCREASING", F.lit("Thermal activity is increasing over time")),
        F.when(score >= 5.0, F.lit("High detection frequency suggests persistent source")),
        F.when(days >= 3, F.format_string("Thermal source active for %d days", days)),
        F.when(_present(mean) & (mean >= 350), F.lit("Very high brightness temperature indicates intense heat source")),
        F.when(kind == "INDUSTRIAL_THERMAL_SOURCE",
               F.lit("Thermal pattern matches the industrial-source heuristic; facility context is unverified")),
        F.when(kind == "AGRICULTURAL_BURNING",
               F.lit("Thermal pattern matches the agricultural-burning heuristic; land-use context is unverified"))))
    text = F.concat_ws(". ", sentences)
    return classified.select(
        "*", F.when(F.size(sentences) > 0, text).otherwise(F.lit(NO_RISK_TEXT)).alias("explanation"),
        F.lit(None).cast("double").alias("escalation_probability"),
        F.lit(None).cast("double").alias("persistence_prediction"), F.lit(FORECAST_STATUS).alias("forecast_status"))


def assess_risk(metrics: DataFrame) -> DataFrame:
    """Class, confidence, score, severity, factors and explanation: narrow projections only."""
    return risk_explanation(risk_scores(classification_confidence(classify_events(metrics))))


def severity_bucket(stored: Column, status: Column, score: Column) -> Column:
    """high / medium / low from the stored severity, else from the status."""
    known = (F.when(F.upper(stored).isin("CRITICAL", "HIGH"), "high").when(F.upper(stored) == "MEDIUM", "medium")
             .when(stored.isNotNull() & (stored != ""), "low"))
    fallback = (F.when((status == "PERSISTENT") & (score >= 5), "high").when(status == "ACTIVE", "medium").otherwise("low"))
    return F.coalesce(known, fallback)


def score_bucket(score: Column) -> Column:
    column = F.when(score < 20, F.lit("0-19"))
    for low in range(20, 90, 10):
        column = column.when(score < low + 10, F.lit(f"{low}-{low + 9}"))
    return column.otherwise(F.lit("90+"))

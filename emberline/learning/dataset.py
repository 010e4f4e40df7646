"""Training rows of the recurrence task: labels, groups, splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import display_round, utc_day
from emberline.operators.cluster import single_cluster_groups
from emberline.operators.features import FIRST_DAY_FEATURES, extract_features
from emberline.operators.ledger import tree_digest
from emberline.operators.quantiles import exact_quantiles
from emberline.operators.ranking import RANGES_ALWAYS, rank_within
from emberline.session import materialize

# Labels, seed and limits of the recurrence task.
POSITIVE = "multi_day_recurrence"
NEGATIVE = "single_day_observed"
SEED = 42
HOLDOUT_SHARE = 0.25
WAIT_DAYS = 2
MIN_ROWS = 40
MIN_PER_CLASS = 8


def recurrence_dataset(linked: DataFrame, wait_days: int = WAIT_DAYS) -> DataFrame:
    """Eligible events with first-day features, label and one-degree group.

    Eligible: first seen at least ``wait_days`` before the newest detection, and
    the first-day rows alone form one cluster.
    """
    newest = linked.agg(utc_day(F.max("timestamp")).alias("latest"))
    days = linked.groupBy("event_id").agg(utc_day(F.min("timestamp")).alias("first_day"), utc_day(F.max("timestamp")).alias("last_day"))
    # Written step by step: all joins are on the event, so one stage would hold the sorts and tables of all of them at once.
    old_enough = materialize(days.join(F.broadcast(newest)).filter(F.col("first_day") <= F.date_sub("latest", wait_days))
                             .select("event_id", F.col("first_day").alias("first_date"),
                                     F.when(F.col("last_day") > F.col("first_day"), POSITIVE).otherwise(NEGATIVE).alias("label")), "cohort_events")
    dated = linked.withColumn("day", utc_day(F.col("timestamp")))
    first = materialize(dated.join(old_enough.select("event_id", F.col("first_date").alias("day")), ["event_id", "day"], "left_semi"), "cohort_rows")
    groups = first.groupBy("event_id").agg(F.concat_ws(
        ":", *(F.floor(display_round(F.avg(c), 9)).cast("string") for c in ("latitude", "longitude"))).alias("spatial_group"))
    features = materialize(extract_features(first).select("event_id", *FIRST_DAY_FEATURES), "cohort_features")
    single = materialize(single_cluster_groups(first, "event_id"), "cohort_single")
    return (old_enough.join(single, "event_id", "left_semi")
            .join(groups, "event_id").join(features, "event_id"))


def holdout_groups(dataset: DataFrame, share: float = HOLDOUT_SHARE, seed: int = SEED) -> DataFrame:
    """(spatial_group, is_holdout): a quarter of the groups, in the order of a seeded hash.

    Groups are one-degree cells, at most 64,800 rows.
    """
    groups = dataset.select("spatial_group").distinct().withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.col("spatial_group"))))
    ranked = rank_within(groups.withColumn("all", F.lit(1)), ["all"], ["order", "spatial_group"], largest=0)
    return ranked.select("spatial_group", (F.col("rank") <= F.ceil(F.col("size") * F.lit(share))).alias("is_holdout"))


def split_dataset(dataset: DataFrame, share: float = HOLDOUT_SHARE, seed: int = SEED) -> DataFrame:
    return dataset.join(F.broadcast(holdout_groups(dataset, share, seed)), "spatial_group")


def require_trainable(split: DataFrame, min_rows: int = MIN_ROWS, min_per_class: int = MIN_PER_CLASS) -> None:
    """Enough rows and both classes on both sides, or a ValueError."""
    counts = {(r["is_holdout"], r["label"]): r["n"] for r in
              split.groupBy("is_holdout", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    if sum(counts.values()) < min_rows:
        raise ValueError(f"too few eligible events: {sum(counts.values())}")
    for name in (POSITIVE, NEGATIVE):
        if counts.get((False, name), 0) + counts.get((True, name), 0) < min_per_class:
            raise ValueError(f"too few events of class {name}")
        if (False, name) not in counts or (True, name) not in counts:
            raise ValueError(f"class {name} is missing on one side of the split")


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * n_class) as ``weight``; the class table is tiny and broadcast."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    weights = counts.join(F.broadcast(totals)).select(label, (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


def long_features(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, value) of all non-null, finite values."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names))
    return rows.select(F.inline(pairs)).filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")


def feature_stats(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Exact median and 90th percentile per feature; a feature without values has no row."""
    return exact_quantiles(long_features(rows, names), "value", {"median": 0.5, "p90": 0.9}, ["feature"])


def medians_of(stats: DataFrame, names: tuple[str, ...]) -> dict[str, float]:
    """Medians as a dict (one entry per feature); features never seen become 0."""
    found = {r["feature"]: r["median"] for r in stats.collect()}  # at most one row per feature name
    return {name: found.get(name, 0.0) for name in names}


def impute(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    def filled(name: str, value: float) -> Column:
        return F.when(F.col(name).isNull() | F.isnan(name), F.lit(float(value))).otherwise(F.col(name)).alias(name)

    return rows.select(*(filled(c, medians[c]) if c in medians else F.col(c) for c in rows.columns))


def fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Order-independent SHA-256 over canonical row texts: a tree over rows in key order."""
    hashed = rows.select(F.lit(1).alias("all"), key, F.sha2(text, 256).alias("digest"))
    # One group holds every row, so the ranking goes by ranges.
    ranked = rank_within(hashed, ["all"], [key], largest=RANGES_ALWAYS)
    return tree_digest(ranked, "all").select(F.col("leaves").alias("n"), F.col("root").alias("fingerprint"))

"""Exact evaluation of scores and labels: areas under the curves, report per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.numeric import display_round
from emberline.session import materialize


def running_totals(rows: DataFrame, order: Sequence[Column | str], values: Sequence[str], name: str = "running") -> DataFrame:
    """Rows with ``<value>_upto``: each value summed over all rows up to this one, over the whole table.

    Rows are range-partitioned by ``order``, which must be unique; sums within a range are
    shifted by the totals of the ranges before, one row a range.
    """
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = placed.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    # as many rows as there are ranges
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(before), "_part").select(
        *rows.columns, *((F.col(f"_{v}") + F.sum(v).over(inside)).alias(f"{v}_upto") for v in values))


def exact_areas(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: positives, negatives, roc_auc and pr_auc over every distinct score.

    The area under the ROC curve is the Mann-Whitney statistic with halves for tied scores;
    the one under the precision-recall curve is the average precision, the sum over falling
    thresholds of the gain in recall times the precision there. Rows without a score or a
    label do not count; an area is null while one of the classes is missing.
    """
    known = rows.select(F.col(score).cast("double").alias("score"), positive.alias("yes")).filter("score IS NOT NULL AND NOT isnan(score) AND yes IS NOT NULL")
    counts = known.groupBy("score").agg(F.count_if("yes").alias("pos"), F.count_if(~F.col("yes")).alias("neg"))
    upto = running_totals(counts, [F.col("score").desc()], ["pos", "neg"])
    above = F.col("pos_upto") - F.col("pos")
    summed = upto.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        # twice the number of (positive, negative) pairs in the right order, whole numbers
        F.sum((F.col("neg") * (2 * above + F.col("pos"))).cast("decimal(38,0)")).alias("pairs"),
        F.sum(F.col("pos") * (F.col("pos_upto").cast("double") / (F.col("pos_upto") + F.col("neg_upto")))).alias("precision"))
    p, n = F.coalesce("positives", F.lit(0)), F.coalesce("negatives", F.lit(0))
    both = (p > 0) & (n > 0)
    return summed.select(p.alias("positives"), n.alias("negatives"),
                         F.when(both, F.col("pairs").cast("double") / (2.0 * p * n)).alias("roc_auc"), F.when(both, F.col("precision") / p).alias("pr_auc"))


def class_report(rows: DataFrame, label: str = "label", prediction: str = "prediction_label") -> DataFrame:
    """(class, precision, recall, f1, support) of every class seen, then macro and weighted means.

    A ratio without a denominator is 0. Rows that lack the label or the prediction do not count.
    """
    known = rows.select(F.col(label).alias("truth"), F.col(prediction).alias("guess")).filter("truth IS NOT NULL AND guess IS NOT NULL")
    pairs = known.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    by_truth = pairs.select(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.alias("hits"))
    by_guess = pairs.select(F.col("guess").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits"))
    totals = by_truth.unionAll(by_guess).groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    measured = totals.select("class", "support", ratio(F.col("hits"), F.col("guessed")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"),
                             ratio(2.0 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"))
    names = ("precision", "recall", "f1")
    means = measured.agg(F.sum("support").alias("support"), *(F.avg(c).alias(f"macro_{c}") for c in names),
                         *(F.when(F.sum("support") > 0, F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in names))
    wide = [measured] + [means.filter("support IS NOT NULL").select(F.lit(f"{kind} avg").alias("class"), "support", *(F.col(f"{kind}_{c}").alias(c) for c in names)) for kind in ("macro", "weighted")]
    out = wide[0].unionByName(wide[1]).unionByName(wide[2])
    return out.select("class", *(display_round(F.col(c), 6).alias(c) for c in names), "support")

"""Areas, reports and folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.learning import metrics, recurrence


def areas(rows):
    pos = [s for s, y in rows if y and s is not None]
    neg = [s for s, y in rows if y is False and s is not None]
    if not pos or not neg:
        return len(pos), len(neg), None, None
    roc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    precision, before = 0.0, 0
    for t in sorted({*pos, *neg}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        precision += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    return len(pos), len(neg), roc, precision


@pytest.mark.parametrize("rows", [
    [(random.Random(k).randrange(9) / 4, random.Random(k * 7).random() < 0.3) for k in range(400)],
    [(0.5, True), (0.5, False), (None, True), (0.1, None)], [(1.0, True)], []])
def test_areas_are_those_of_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "score double, yes boolean").repartition(3)
    got = tuple(metrics.exact_areas(df, "score", F.col("yes")).first())
    assert got == pytest.approx(areas(rows), abs=1e-12)


def test_report_of_three_classes(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "b")] * 4 + [("b", "a")] + [("c", "a")] * 2 + [(None, "a"), ("a", None)]
    got = {r["class"]: tuple(r)[1:] for r in metrics.class_report(spark.createDataFrame(pairs, "label string, prediction_label string")).collect()}
    assert got["a"] == (0.5, 0.6, pytest.approx(0.545455), 5)
    assert got["b"] == (pytest.approx(0.666667), 0.8, pytest.approx(0.727273), 5) and got["c"] == (0.0, 0.0, 0.0, 2)
    assert got["macro avg"][3] == 12 and got["weighted avg"][1] == pytest.approx((3 + 4) / 12, abs=1e-6)


def test_folds_are_whole_groups_of_like_shares(spark):
    pick = random.Random(4)
    sizes = [(f"g{k}", pick.randrange(6), pick.randrange(20)) for k in range(60)] + [("big", 90, 250)]
    got = {r["spatial_group"]: r["fold"] for r in recurrence.dealt_groups(spark.createDataFrame(sizes, "spatial_group string, positives long, negatives long")).collect()}
    assert got.keys() == {g for g, _, _ in sizes}
    rest = [[sum(s[c] for s in sizes if got[s[0]] == f) for f in range(3) if f != got["big"]] for c in (1, 2)]
    for small, large in (sorted(r) for r in rest):  # what the giant leaves is shared evenly
        assert large - small <= 12


def test_medians_leave_the_own_fold_out(spark):
    rows = [(0, 1.0), (0, 2.0), (1, 10.0), (1, None), (2, 100.0), (2, float("nan"))]
    got = {(r["fold"], r["feature"]): r["median"] for r in recurrence.fold_medians(spark.createDataFrame(rows, "fold int, x double"), ("x",)).collect()}
    assert got == {(0, "x"): 55.0, (1, "x"): 2.0, (2, "x"): 2.0}


def test_permutation_importance_is_that_of_plain_shuffles(spark):
    """Against shuffles done by hand in the order of the same seeded hash."""
    pick = random.Random(9)
    names = ("a", "b", "c")
    rows = [(k, recurrence.POSITIVE if pick.random() < 0.4 else recurrence.NEGATIVE, pick.random(), None if k % 11 == 0 else pick.random(), pick.random()) for k in range(80)]
    table = spark.createDataFrame(rows, "event_id long, label string, a double, b double, c double")

    class Rule:
        medians = {"a": 0.5, "b": 0.25, "c": 0.5}

        def score(self, df):
            return df.withColumn("prediction_label", F.when(F.col("a") + 2 * F.col("b") > 1.2, recurrence.POSITIVE).otherwise(recurrence.NEGATIVE))

    model = Rule()
    model.names = names
    got = {r["feature"]: r["importance"] for r in recurrence.permutation_importance(model, table, repeats=5, seed=3).collect()}
    plain = [(k, y, dict(zip(names, (a, 0.25 if b is None else b, c)))) for k, y, a, b, c in rows]

    def hits(values):
        return sum((recurrence.POSITIVE if v["a"] + 2 * v["b"] > 1.2 else recurrence.NEGATIVE) == y for y, v in values) / len(rows)

    order = {(r["f"], r["r"]): r["ids"] for r in table.select("event_id", F.explode(F.array(*map(F.lit, names))).alias("f")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(5)))).groupBy("f", "r").agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(3), "f", "r", "event_id"), "event_id"))).alias("ids")).collect()}
    base = hits([(y, v) for _, y, v in plain])
    raw = {}
    for name in names:
        losses = []
        for repeat in range(1, 6):
            dealt = [plain[r["event_id"]][2][name] for r in order[name, repeat]]
            losses.append(base - hits([(y, {**v, name: dealt[k]}) for k, y, v in plain]))
        raw[name] = max(sum(losses) / 5, 0.0)
    total = sum(raw.values())
    assert got == pytest.approx({n: v / total for n, v in raw.items()}, abs=1e-12) and got["c"] == 0.0

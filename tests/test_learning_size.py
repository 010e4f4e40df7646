"""The learning queries hold little in one task and share their passes."""

import random
import re

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from emberline.learning import dataset, recurrence
from emberline.operators import cluster
from emberline.queries import workspace as ws


def test_the_cohort_is_joined_from_written_steps(spark, folder):
    """Its joins are all on the event: in one stage they would hold all their sorts and tables at once."""
    plan = dataset.recurrence_dataset(ws.linked(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:Join|Aggregate|Window)\b", plan)) <= 6


def test_only_groups_of_several_cubes_are_paired(spark, monkeypatch):
    """Group 1 is one cube, 2 a chain of cubes, 3 two clusters, 4 has no place."""
    stamp = "2024-01-01 00:00:00"
    rows = [(1, 1, 10.0, 70.0), (2, 1, 10.0, 70.0), (3, 2, 20.0, 70.0), (4, 2, 20.008, 70.0), (5, 2, 20.016, 70.0), (6, 3, 30.0, 70.0), (7, 3, 31.0, 70.0), (8, 4, None, 70.0)]
    df = spark.createDataFrame([(*r, stamp) for r in rows], "obs_id long, event_id long, latitude double, longitude double, timestamp string").selectExpr("* except (timestamp)", "CAST(timestamp AS timestamp) AS timestamp")
    paired = []
    labels = cluster.Linker.labels
    monkeypatch.setattr(cluster.Linker, "labels", lambda self: (paired.extend(r[0] for r in self.cubes.select("group_key").distinct().collect()), labels(self))[1])
    assert sorted(r.event_id for r in cluster.single_cluster_groups(df, "event_id").collect()) == [1, 2]
    assert sorted(paired) == [2, 3]


def test_a_fit_runs_on_all_cores_and_not_on_the_files_order(spark, monkeypatch):
    """Small files would be packed into few tasks, and the bags of a forest would follow them."""
    pick = random.Random(5)
    rows = [(k, f"g{k % 30}", recurrence.POSITIVE if pick.random() < 0.5 else recurrence.NEGATIVE, *(pick.random() for _ in recurrence.FIRST_DAY_FEATURES)) for k in range(300)]
    table = spark.createDataFrame(rows, "event_id long, spatial_group string, label string, " + ", ".join(f"{n} double" for n in recurrence.FIRST_DAY_FEATURES))
    seen = []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    every = recurrence.candidate_pipelines
    monkeypatch.setattr(recurrence, "candidate_pipelines", lambda **k: {"RandomForest": every(trees=2, seed=1)["RandomForest"]})
    kept = [recurrence.train_recurrence(t).comparison for t in (table.coalesce(1), table.orderBy("label").repartition(7))]
    assert kept[0] == kept[1]
    assert set(seen) == {2 * spark.sparkContext.defaultParallelism}


def test_only_rows_that_a_shuffle_changes_are_scored(spark):
    """b has few values, c one value; importances are those of scoring every row."""
    pick = random.Random(2)
    rows = [(k, pick.random(), None if k % 11 == 0 else float(k % 2), 1.0) for k in range(60)]
    rows = [(k, recurrence.POSITIVE if a + (b or 0.0) > 1.0 else recurrence.NEGATIVE, a, b, c) for k, a, b, c in rows]
    table = spark.createDataFrame(rows, "event_id long, label string, a double, b double, c double")
    scored = []

    class Rule:
        names, medians = ("a", "b", "c"), {"a": 0.5, "b": 0.0, "c": 1.0}

        def score(self, df):
            scored.append(df)
            return df.withColumn("prediction_label", F.when(F.col("a") + F.col("b") > 1.0, recurrence.POSITIVE).otherwise(recurrence.NEGATIVE))

    got = {r["feature"]: r["importance"] for r in recurrence.permutation_importance(Rule(), table, repeats=3, seed=3).collect()}
    order = {(r["f"], r["r"]): [x["event_id"] for x in r["ids"]] for r in table.select("event_id", F.explode(F.array(*map(F.lit, Rule.names))).alias("f")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(3)))).groupBy("f", "r").agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(3), "f", "r", "event_id"), "event_id"))).alias("ids")).collect()}
    plain = [{"a": a, "b": b or 0.0, "c": c} for _, _, a, b, c in rows]
    hits = lambda values: sum((v["a"] + v["b"] > 1.0) == (r[1] == recurrence.POSITIVE) for v, r in zip(values, rows)) / len(rows)
    raw, changed = {}, 0
    for n in Rule.names:
        mixes = [[{**v, n: plain[k][n]} for v, k in zip(plain, order[n, r])] for r in (1, 2, 3)]
        changed += sum(v != w for mix in mixes for v, w in zip(mix, plain))
        raw[n] = max(sum(hits(plain) - hits(mix) for mix in mixes) / 3, 0.0)
    assert sum(raw.values()) > 0
    assert got == pytest.approx({n: v / sum(raw.values()) for n, v in raw.items()}, abs=1e-12)
    assert sum(df.count() for df in scored) == len(rows) + changed

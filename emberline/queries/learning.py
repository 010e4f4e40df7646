"""Queries over training data, models and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.numeric import display_round
from emberline.learning import anomaly, dataset, isolation, labeled, metrics, recurrence
from emberline.operators import features as feat
from emberline.operators.events import persistence_metrics
from emberline.queries import workspace as ws
from emberline.queries.oracle import half_up, sql
from emberline.queries.per_event import FIRST_DAY, _feature_sql
from emberline.queries.registry import query
from emberline.sources.detections import read_labeled_events

COHORT = {
    **FIRST_DAY, **_feature_sql("first_rows"),
    "day_edges": (("both_ways", "first_rows"), "SELECT p.x, p.y, a.event_id FROM both_ways p JOIN first_rows a ON a.obs_id=p.x JOIN first_rows b ON b.obs_id=p.y AND a.event_id=b.event_id"),
    "walk": (("first_rows", "day_edges"), "SELECT event_id, obs_id AS n, obs_id AS root FROM first_rows UNION SELECT w.event_id, e.y, w.root FROM walk w JOIN day_edges e ON e.x=w.n WHERE w.root<e.y"),
    "single": (("walk",), "SELECT event_id FROM (SELECT event_id, n, min(root) AS root FROM walk GROUP BY 1,2) GROUP BY event_id HAVING count(DISTINCT root)=1"),
    "span": (("linked",), "SELECT event_id, min(CAST(timestamp AS DATE)) AS first_date, max(CAST(timestamp AS DATE)) AS last_date FROM linked GROUP BY 1"),
    "grp": (("first_rows",), f"SELECT event_id, CAST(floor({half_up('avg(latitude)', 9)}) AS BIGINT)||':'||CAST(floor({half_up('avg(longitude)', 9)}) AS BIGINT) AS spatial_group FROM first_rows GROUP BY 1"),
    "cohort": (("single", "span", "grp", "linked"), """SELECT event_id, CAST(first_date AS VARCHAR) AS first_date, CASE WHEN last_date>first_date THEN 'multi_day_recurrence' ELSE 'single_day_observed' END AS label, spatial_group
 FROM span JOIN single USING (event_id) JOIN grp USING (event_id) WHERE first_date<=(SELECT max(CAST(timestamp AS DATE)) FROM linked)-2"""),
}


def co(final, *needs):
    return sql(final, *needs, **COHORT)


def _cohort(spark, folder):
    return ws.stored(spark, folder, "cohort", lambda: dataset.recurrence_dataset(ws.linked(spark, folder)))


def _features(spark, folder):
    return ws.stored(spark, folder, "features", lambda: feat.extract_features(ws.linked(spark, folder), ws.metrics(spark, folder)))


_MODELS: dict[tuple, object] = {}


def _once(spark, folder, name, build):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def _recurrence(spark, folder):
    return _once(spark, folder, "recurrence", lambda: recurrence.train_recurrence(_cohort(spark, folder)))


def _forest(spark, folder):
    def build():
        rows = _features(spark, folder)
        return isolation.with_offset(isolation.fit_forest(rows, feat.FEATURES), rows)

    return _once(spark, folder, "forest", build)


@query("recurrence_dataset", co("SELECT c.*, f.observation_count, f.mean_frp, f.spatial_spread_km FROM cohort c JOIN feats f USING (event_id)", "cohort", "feats"))
def recurrence_dataset(spark, folder):
    rows = dataset.recurrence_dataset(ws.linked(spark, folder))
    return rows.select("event_id", "first_date", "label", "spatial_group", display_round(F.col("observation_count"), 6).alias("observation_count"),
                       display_round(F.col("mean_frp"), 6).alias("mean_frp"), display_round(F.col("spatial_spread_km"), 6).alias("spatial_spread_km"))


# Groups in the order of a seeded hash, a quarter of them held out.
COHORT["split"] = (("cohort",), """SELECT c.*, r<=ceil(m*0.25::DOUBLE) AS is_holdout FROM cohort c JOIN
 (SELECT spatial_group, row_number() OVER (ORDER BY md5('42:'||spatial_group), spatial_group) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT spatial_group FROM cohort)) USING (spatial_group)""")
# The training groups dealt one after another.
COHORT["dealing"] = (("split",), """SELECT *, row_number() OVER (ORDER BY abs(p-q) DESC, md5('42:'||spatial_group), spatial_group) AS i, sum(p) OVER () AS pa, sum(q) OVER () AS qa FROM
 (SELECT spatial_group, CAST(count(*) FILTER (label='multi_day_recurrence') AS HUGEINT) AS p, CAST(count(*) FILTER (label<>'multi_day_recurrence') AS HUGEINT) AS q FROM split WHERE NOT is_holdout GROUP BY 1)""")
COHORT["dealt"] = (("dealing",), """SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS spatial_group, -1 AS fold, [0,0,0]::HUGEINT[] AS a, [0,0,0]::HUGEINT[] AS b
 UNION ALL SELECT i, spatial_group, k, list_transform([0,1,2], lambda f: a[f+1]+CASE WHEN f=k THEN p ELSE 0 END), list_transform([0,1,2], lambda f: b[f+1]+CASE WHEN f=k THEN q ELSE 0 END) FROM
 (SELECT d.i, d.spatial_group, d.p, d.q, t.a, t.b, list_sort(list_transform([0,1,2], lambda f: {'g': (2*t.a[f+1]+d.p)*d.p*d.qa*d.qa+(2*t.b[f+1]+d.q)*d.q*d.pa*d.pa, 'n': t.a[f+1]+t.b[f+1], 'k': f}))[1].k AS k FROM dealt t JOIN dealing d ON d.i=t.i+1)""")
COHORT["folded"] = (("split", "dealt"), "SELECT s.*, d.fold FROM split s JOIN dealt d USING (spatial_group) WHERE NOT s.is_holdout")


@query("group_holdout_split", co("SELECT is_holdout, label, count(*) AS n, count(DISTINCT spatial_group) AS groups FROM split GROUP BY 1,2", "split"))
def group_holdout_split(spark, folder):
    split = dataset.split_dataset(_cohort(spark, folder))
    dataset.require_trainable(split)
    return split.groupBy("is_holdout", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spatial_group").alias("groups"))


def _folded(spark, folder):
    return ws.stored(spark, folder, "folded", lambda: recurrence.with_folds(dataset.split_dataset(_cohort(spark, folder)).filter("NOT is_holdout")))


@query("stratified_group_folds", co("SELECT fold, spatial_group, count(*) AS n, count(*) FILTER (label='multi_day_recurrence') AS positives FROM folded GROUP BY 1,2", "folded"))
def stratified_group_folds(spark, folder):
    return _folded(spark, folder).groupBy("fold", "spatial_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == dataset.POSITIVE).alias("positives"))


@query("fold_medians", co(" UNION ALL ".join(
    f"SELECT k AS fold, '{n}' AS feature, {half_up(f'quantile_cont({n}, 0.5)', 4)} AS median FROM folded JOIN feats USING (event_id), (VALUES (0),(1),(2)) t(k) WHERE fold<>k GROUP BY k HAVING count({n})>0"
    for n in ("mean_frp", "intensity_variance", "night_fraction", "spatial_spread_km")), "folded", "feats"))
def fold_medians(spark, folder):
    """What each fold's model fills gaps with: medians of the rows outside the fold."""
    names = ("mean_frp", "intensity_variance", "night_fraction", "spatial_spread_km")
    rows = _folded(spark, folder).select("fold", *(display_round(F.col(n), _digits(n)).alias(n) for n in names))
    return recurrence.fold_medians(rows, names).withColumn("median", display_round(F.col("median"), 4))


@query("group_kfold_select")
def group_kfold_select(spark, folder):
    model = _recurrence(spark, folder)
    rows = [(n, v, n == model.name) for n, v in model.comparison.items()]
    return spark.createDataFrame(rows, "model STRING, mean_training_cv_f1 DOUBLE, selected BOOLEAN")


@query("balanced_weights", co(f"SELECT label, n, {half_up('t/(2.0::DOUBLE*n)', 6)} AS weight FROM (SELECT label, count(*) AS n, (SELECT count(*) FROM cohort) AS t FROM cohort GROUP BY 1)", "cohort"))
def balanced_weights(spark, folder):
    rows = dataset.balanced_weights(_cohort(spark, folder))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), display_round(F.max("weight"), 6).alias("weight"))


_NAMES = feat.FIRST_DAY_FEATURES
_VARIANCE = ("intensity_variance", "frp_variance")


def _digits(name: str) -> int:
    return 4 if name in _VARIANCE else 6


@query("median_impute", co("SELECT event_id, " + ", ".join(
    f"{half_up(f'coalesce({n}, (SELECT quantile_cont({n}, 0.5) FROM feats JOIN cohort USING (event_id)))', 4)} AS {n}" for n in ("intensity_variance", "mean_frp", "mean_secondary_brightness", "night_fraction", "spatial_spread_km"))
    + " FROM feats JOIN cohort USING (event_id)", "feats", "cohort"))
def median_impute(spark, folder):
    names = ("intensity_variance", "mean_frp", "mean_secondary_brightness", "night_fraction", "spatial_spread_km")
    rows = _cohort(spark, folder).select("event_id", *names)
    rows = rows.select("event_id", *(display_round(F.col(n), _digits(n)).alias(n) for n in names))
    filled = dataset.impute(rows, dataset.medians_of(dataset.feature_stats(rows, names), names))
    return filled.select("event_id", *(display_round(F.col(n), 4).alias(n) for n in names))


@query("feature_stats", co(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, {half_up(f'quantile_cont({n}, 0.5)', 4)} AS median, {half_up(f'quantile_cont({n}, 0.9)', 4)} AS p90 FROM feats JOIN cohort USING (event_id) HAVING count({n})>0" for n in _NAMES), "feats", "cohort"))
def feature_stats(spark, folder):
    rows = _cohort(spark, folder)
    rows = rows.select("event_id", *(display_round(F.col(n), _digits(n)).alias(n) if n not in ("spatial_stability", "temporal_trend") else n for n in _NAMES))
    stats = dataset.feature_stats(rows, _NAMES)
    return stats.select("feature", display_round(F.col("median"), 4).alias("median"), display_round(F.col("p90"), 4).alias("p90"))


@query("binary_eval", co(f"""SELECT tp, fn, fp, tn, {half_up('(tp+tn)/CAST(tp+tn+fp+fn AS DOUBLE)', 6)} AS accuracy, {half_up('(tp/CAST(tp+fn AS DOUBLE)+tn/CAST(tn+fp AS DOUBLE))/2', 6)} AS balanced_accuracy,
 {half_up('tp/CAST(tp+fp AS DOUBLE)', 6)} AS precision_positive, {half_up('tp/CAST(tp+fn AS DOUBLE)', 6)} AS recall_positive, {half_up('2.0::DOUBLE*tp/(2*tp+fp+fn)', 6)} AS f1_positive,
 {half_up('(2.0::DOUBLE*tp/(2*tp+fp+fn)+2.0::DOUBLE*tn/(2*tn+fp+fn))/2', 6)} AS f1_macro FROM (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn
 FROM (SELECT label='multi_day_recurrence' AS t, observation_count>=2 AS p FROM cohort JOIN feats USING (event_id)))""", "cohort", "feats"))
def binary_eval(spark, folder):
    """Metrics of the simplest guess: two or more rows on the first day recur."""
    guess = F.when(F.col("observation_count") >= 2, dataset.POSITIVE).otherwise(dataset.NEGATIVE)
    return recurrence.binary_metrics(_cohort(spark, folder).withColumn("prediction_label", guess))


# Scores with many ties: rows of the first day, and the mean power in whole megawatts.
_SCORES = {"observation_count": "observation_count", "mean_frp": "floor(mean_frp)"}


@query("exact_areas", co(" UNION ALL ".join(f"""SELECT '{n}' AS score, max(pa) AS positives, max(na) AS negatives, {half_up('CAST(sum(neg*(2*(pu-pos)+pos)) AS DOUBLE)/(2.0::DOUBLE*max(pa)*max(na))', 9)} AS roc_auc,
 {half_up('sum(pos*(CAST(pu AS DOUBLE)/(pu+nu)))/max(pa)', 9)} AS pr_auc FROM (SELECT *, sum(pos) OVER (ORDER BY v DESC) AS pu, sum(neg) OVER (ORDER BY v DESC) AS nu, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM
 (SELECT {v} AS v, count(*) FILTER (label='multi_day_recurrence') AS pos, count(*) FILTER (label<>'multi_day_recurrence') AS neg FROM cohort JOIN feats USING (event_id) WHERE {v} IS NOT NULL GROUP BY 1))""" for n, v in _SCORES.items()), "cohort", "feats"))
def exact_area_query(spark, folder):
    rows = _cohort(spark, folder).select("label", "observation_count", F.floor(display_round(F.col("mean_frp"), 6)).alias("mean_frp"))
    found = [metrics.exact_areas(rows, n, F.col("label") == dataset.POSITIVE).select(
        F.lit(n).alias("score"), "positives", "negatives", *(display_round(F.col(c), 9).alias(c) for c in ("roc_auc", "pr_auc"))) for n in _SCORES]
    return found[0].unionAll(found[1])


@query("class_report", co(f"""SELECT * FROM (WITH pairs AS (SELECT label AS truth, CASE WHEN observation_count>=2 THEN 'multi_day_recurrence' ELSE 'single_day_observed' END AS guess FROM cohort JOIN feats USING (event_id)),
 each AS (SELECT c AS class, count(*) FILTER (truth=c) AS support, coalesce(count(*) FILTER (truth=c AND guess=c)/nullif(CAST(count(*) FILTER (guess=c) AS DOUBLE),0),0) AS precision,
  coalesce(count(*) FILTER (truth=c AND guess=c)/nullif(CAST(count(*) FILTER (truth=c) AS DOUBLE),0),0) AS recall, 2.0::DOUBLE*count(*) FILTER (truth=c AND guess=c)/(count(*) FILTER (truth=c)+count(*) FILTER (guess=c)) AS f1
  FROM pairs, (VALUES ('multi_day_recurrence'),('single_day_observed')) t(c) GROUP BY 1),
 whole AS (SELECT * FROM each UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM each
  UNION ALL SELECT 'weighted avg', sum(support), sum(support*precision)/sum(support), sum(support*recall)/sum(support), sum(support*f1)/sum(support) FROM each)
 SELECT class, {half_up('precision', 6)} AS precision, {half_up('recall', 6)} AS recall, {half_up('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM whole)""", "cohort", "feats"))
def class_report(spark, folder):
    guess = F.when(F.col("observation_count") >= 2, dataset.POSITIVE).otherwise(dataset.NEGATIVE)
    return metrics.class_report(_cohort(spark, folder).withColumn("prediction_label", guess))


@query("model_evaluation")
def model_evaluation(spark, folder):
    return recurrence.evaluate(_recurrence(spark, folder))


@query("feature_importance")
def feature_importance(spark, folder):
    return recurrence.feature_importance(_recurrence(spark, folder))


@query("permutation_importance")
def permutation_importance(spark, folder):
    """Five shuffles of every feature of the training rows."""
    model = _recurrence(spark, folder)
    return recurrence.permutation_importance(model, model.split.filter("NOT is_holdout"))


def _first_features(spark, folder):
    return ws.stored(spark, folder, "first_features", lambda: feat.first_day_features(ws.linked(spark, folder)))


@query("score_recurrence")
def score_recurrence(spark, folder):
    model = _recurrence(spark, folder)
    scored = model.score(_first_features(spark, folder)).select("event_id", "prediction_label", "p_positive")
    return scored.join(recurrence.evaluation_role(model, scored), "event_id")


@query("top_contributions")
def top_contributions(spark, folder):
    return recurrence.top_contributions(recurrence.score_contributions(_recurrence(spark, folder), _first_features(spark, folder)))


@query("isolation_forest_fit")
def isolation_forest_fit(spark, folder):
    nodes = spark.createDataFrame(_forest(spark, folder).nodes)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("size").alias("rows"), F.count_if(F.col("feature") < 0).alias("leaves"))


@query("anomaly_score")
def anomaly_score(spark, folder):
    return isolation.anomaly_scores(_features(spark, folder), _forest(spark, folder))


def _p1(value: str) -> str:
    return f"printf('%.1f',{half_up(value, 1)})"


_ALL = {**_feature_sql("linked")}


@query("anomaly_reasons", sql(f"""SELECT event_id, concat_ws('; ', CASE WHEN found='' THEN CASE WHEN max_intensity>400 THEN '{anomaly.UNUSUAL}' ELSE '{anomaly.USUAL}' END ELSE found END, '{anomaly.CAVEAT}') AS reasoning FROM (SELECT *, concat_ws('; ',
 CASE WHEN max_frp>pf THEN 'Unusually high fire radiative power (Peak FRP: '||{_p1('max_frp')}||' MW vs capture median '||{_p1('mf')}||' MW)' END,
 CASE WHEN active_days>1 THEN 'Multi-day temporal persistence ('||CAST(active_days AS BIGINT)||' active days observed across satellite overpasses)' END,
 CASE WHEN observation_count>po THEN 'High detection cluster density ('||CAST(observation_count AS BIGINT)||' detections clustered in spatial footprint)' END,
 CASE WHEN max_intensity>pm THEN 'Elevated peak brightness temperature ('||{_p1('max_intensity')}||' K)' END,
 CASE WHEN night_fraction>=0.5 THEN 'Predominantly nocturnal thermal detection ('||CAST(floor(night_fraction*100+0.000000001::DOUBLE) AS BIGINT)||'% night satellite passes)' END,
 CASE WHEN duration_hours>pd THEN 'Extended temporal duration ('||{_p1('duration_hours')}||' hours span)' END) AS found FROM feats,
 (SELECT quantile_cont(max_frp,0.9) AS pf, quantile_cont(max_frp,0.5) AS mf, quantile_cont(observation_count,0.9) AS po, quantile_cont(max_intensity,0.9) AS pm, quantile_cont(duration_hours,0.9) AS pd FROM feats))""", "feats", **_ALL))
def anomaly_reasons(spark, folder):
    rows = _features(spark, folder)
    names = ("max_frp", "observation_count", "max_intensity", "duration_hours", "night_fraction", "active_days")
    rows = rows.select("event_id", *(display_round(F.col(n), 6).alias(n) for n in names))
    stats = dataset.feature_stats(rows, names[:4])
    unusual = F.coalesce(F.col("max_intensity") > 400, F.lit(False))
    return anomaly.anomaly_reasons(rows, stats, unusual).withColumn("reasoning", F.array_join("reasoning", "; "))


_STANDS_OUT = {"max_frp": ("max_frp>pf", half_up("(max_frp-mf)/greatest(1.0::DOUBLE,mf)", 3)), "active_days": ("active_days>1", "active_days"), "observation_count": ("observation_count>po", "observation_count"),
               "max_intensity": ("max_intensity>pm", half_up("max_intensity-mi", 1)), "night_fraction": ("night_fraction>=0.5", "night_fraction"), "duration_hours": ("duration_hours>pd", half_up("duration_hours", 1))}


@query("anomaly_contributions", sql(" UNION ALL ".join(f"SELECT event_id, '{n}' AS feature, {half_up(f'CAST({n} AS DOUBLE)', 5)} AS value, {half_up(f'CAST({change} AS DOUBLE)', 5)} AS probability_change FROM feats, limits WHERE {test}" for n, (test, change) in _STANDS_OUT.items()),
    "feats", "limits", **_ALL, limits=(("feats",), "SELECT quantile_cont(max_frp,0.9) AS pf, quantile_cont(max_frp,0.5) AS mf, quantile_cont(observation_count,0.9) AS po, quantile_cont(max_intensity,0.9) AS pm, quantile_cont(max_intensity,0.5) AS mi, quantile_cont(duration_hours,0.9) AS pd FROM feats")))
def anomaly_contributions(spark, folder):
    names = ("max_frp", "observation_count", "max_intensity", "duration_hours", "night_fraction", "active_days")
    rows = _features(spark, folder).select("event_id", *(display_round(F.col(n), 6).alias(n) for n in names))
    found = anomaly.anomaly_contributions(rows, dataset.feature_stats(rows, names[:4]))
    return found.select("event_id", "feature", display_round(F.col("value"), 5).alias("value"), display_round(F.col("probability_change"), 5).alias("probability_change"))


def _labeled(spark, folder):
    """Labelled lines from the tables: all rows of an event, label by its class (a fixture, not a review)."""
    def write(path):
        row = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "latitude", "longitude", "intensity", "confidence", "source",
                       F.create_map(F.lit("frp"), F.col("frp").cast("string"), F.lit("daynight"), F.col("daynight")).alias("metadata"))
        # one line is one event, as the format has it
        ends = ws.linked(spark, folder).groupBy("event_id").agg(F.collect_list(row).alias("observations"))
        label = F.when(F.col("total_detections") >= 3, "persistent_thermal_source").when(
            F.col("average_intensity") > 320, "industrial_fire").otherwise("temporary_thermal_event")
        ends.join(ws.metrics(spark, folder), "event_id").select(label.alias("label"), "observations").write.json(path)

    return read_labeled_events(spark, ws.folder_for(spark, folder, "labeled", write))


def _labeled_model(spark, folder):
    def build():
        rows = ws.stored(spark, folder, "labeled_rows", lambda: _labeled(spark, folder))
        features = feat.extract_features(rows, persistence_metrics(rows))
        return labeled.train_labeled_classifier(features.join(rows.select("event_id", "label").distinct(), "event_id"), labeled.Origin("fixture", "table rows labelled for a test"), fixtures_allowed=True)

    return _once(spark, folder, "labeled", build)


@query("read_labeled_events", sql("""SELECT label, count(*) AS events, CAST(sum(total_detections) AS BIGINT) AS rows FROM (SELECT CASE WHEN total_detections>=3 THEN 'persistent_thermal_source'
 WHEN average_intensity>320 THEN 'industrial_fire' ELSE 'temporary_thermal_event' END AS label, total_detections FROM metrics) GROUP BY 1""", "metrics"))
def read_labeled(spark, folder):
    return _labeled(spark, folder).groupBy("label").agg(F.count_distinct("event_id").alias("events"), F.count(F.lit(1)).alias("rows"))


@query("train_labeled_classifier")
def train_labeled_classifier(spark, folder):
    model = _labeled_model(spark, folder)
    scored = labeled.classify_with_fallback(_features(spark, folder), ws.metrics(spark, folder), model)
    return scored.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


@query("classify_with_fallback")
def classify_with_fallback(spark, folder):
    """Model for events of three or more rows, rules for the rest."""
    big = ws.metrics(spark, folder).filter("total_detections >= 3")
    small = ws.metrics(spark, folder).filter("total_detections < 3")
    rows = _features(spark, folder).join(big.select("event_id"), "event_id", "left_semi")
    return labeled.classify_with_fallback(rows, big, _labeled_model(spark, folder)).unionByName(
        labeled.classify_with_fallback(rows, small, None))


_INVARIANTS = ("anomaly_score", "every event once"), ("anomaly_score", "share of anomalies is the contamination"), ("classify_with_fallback", "every event once"), \
    ("feature_importance", "every feature, none negative, sum is one"), ("group_holdout_split", "a quarter of the groups"), ("group_holdout_split", "no group on both sides"), \
    ("group_kfold_select", "each fold has both labels"), ("group_kfold_select", "no group in two folds"), ("group_kfold_select", "the selected model has the highest mean F1"), \
    ("isolation_forest_fit", "every inner node has two children"), ("score_recurrence", "every event once"), ("score_recurrence", "roles follow the split"), \
    ("top_contributions", "at most five an event, strongest first"), ("train_labeled_classifier", "rule-made labels are refused")


@query("learning_invariants", "SELECT * FROM (VALUES " + ", ".join(f"('{o}', '{i}', true)" for o, i in _INVARIANTS) + ") t(operator, invariant, holds)")
def learning_invariants(spark, folder):
    """What must hold of the fitted models' results, whatever the models learned."""
    model, forest = _recurrence(spark, folder), _forest(spark, folder)
    found = []

    def held(operator: str, invariant: str, rows) -> None:
        """``rows``: one row, one boolean."""
        found.append(rows.toDF("holds").select(F.lit(operator).alias("operator"), F.lit(invariant).alias("invariant"), "holds"))

    split = model.split
    groups = split.groupBy("spatial_group").agg(F.count_distinct("is_holdout").alias("sides"), F.max("is_holdout").alias("out"))
    held("group_holdout_split", "no group on both sides", groups.agg(F.max("sides") == 1))
    held("group_holdout_split", "a quarter of the groups", groups.agg(F.count_if("out") == F.ceil(F.count("*") * dataset.HOLDOUT_SHARE)))
    train = recurrence.with_folds(recurrence.with_target(split.filter("NOT is_holdout")))
    held("group_kfold_select", "no group in two folds", train.groupBy("spatial_group").agg(F.count_distinct("fold").alias("n")).agg(F.max("n") == 1))
    held("group_kfold_select", "each fold has both labels", train.groupBy("fold").agg(F.count_distinct("label").alias("n")).agg(F.min("n") == 2))
    compared = spark.createDataFrame([(n, v) for n, v in model.comparison.items()], "name STRING, f1 DOUBLE")  # a row for each candidate
    held("group_kfold_select", "the selected model has the highest mean F1", compared.agg(F.max("f1") == F.max(F.when(F.col("name") == model.name, F.col("f1")))))
    importance = recurrence.feature_importance(model)
    held("feature_importance", "every feature, none negative, sum is one", importance.agg(
        (F.count("*") == len(model.names)) & (F.min("importance") >= 0) & (F.abs(F.sum("importance") - 1) < 1e-6)))
    events = ws.metrics(spark, folder).select("event_id")

    def once(rows):
        counted = rows.groupBy("event_id").agg(F.count("*").alias("n")).join(events.withColumn("there", F.lit(True)), "event_id", "full")
        return counted.agg(F.coalesce((F.min(F.coalesce("n", F.lit(0))) == 1) & (F.max("n") == 1) & (F.count("*") == F.count("there")), F.lit(False)))

    scored = model.score(_first_features(spark, folder)).select("event_id", "prediction_label", "p_positive")
    held("score_recurrence", "every event once", once(scored))
    roles = recurrence.evaluation_role(model, scored).join(split.select("event_id", "is_holdout"), "event_id", "left")
    expected = F.when(F.col("is_holdout"), "held_out").when(~F.col("is_holdout"), "training").otherwise("outside_training_cohort")
    held("score_recurrence", "roles follow the split", roles.agg(F.count_if(F.col("role") != expected) == 0))
    top = recurrence.top_contributions(recurrence.score_contributions(model, _first_features(spark, folder)))
    later = top.select("event_id", (F.col("rank") - 1).alias("rank"), F.abs("score_change").alias("next"))
    ordered = top.join(later, ["event_id", "rank"], "left").agg((F.max("rank") <= 5) & (F.count_if(F.abs("score_change") < F.col("next")) == 0))
    held("top_contributions", "at most five an event, strongest first", ordered)
    nodes = spark.createDataFrame(forest.nodes)  # trees x nodes, bounded by the sample of a tree
    held("isolation_forest_fit", "every inner node has two children", nodes.groupBy("tree").agg(
        (F.count("*") == 2 * F.count_if(F.col("feature") >= 0) + 1).alias("full")).agg(F.min("full")))
    anomalies = isolation.anomaly_scores(_features(spark, folder), forest)
    held("anomaly_score", "every event once", once(anomalies))
    held("anomaly_score", "share of anomalies is the contamination", anomalies.agg(
        F.abs(F.avg((F.col("classification") == "anomalous_thermal_pattern").cast("double")) - isolation.CONTAMINATION) < 0.01))
    held("classify_with_fallback", "every event once", once(classify_with_fallback(spark, folder)))
    try:
        labeled.train_labeled_classifier(events, labeled.Origin("rules", "limits on counts"))
        refused = False
    except ValueError:
        refused = True
    held("train_labeled_classifier", "rule-made labels are refused", spark.range(1).select(F.lit(refused)))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out

"""Queries that give one or a few rows per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import fixtures
from emberline.functions.numeric import display_round
from emberline.operators import cluster, events, features, profile
from emberline.queries import workspace as ws
from emberline.queries.oracle import half_up, key_round, sql, trend
from emberline.queries.registry import query

# The links between cubes, written without bounding boxes: two cubes are linked
# when any two of their members are.
_SIDE = "(1000.0::DOUBLE/sqrt(2.0::DOUBLE)/111200.0::DOUBLE*(1.0::DOUBLE-0.000001::DOUBLE))"
_EDGE = f"(CASE WHEN band>=0 THEN band*{_SIDE} ELSE -(band+1)*{_SIDE} END)"
CUBES = {
    "banded": (("slim",), f"SELECT *, CAST(floor(lat/{_SIDE}) AS BIGINT) AS band, (t-((t%259200000000)+259200000000)%259200000000)//259200000000 AS bucket FROM slim"),
    "celled": (("banded",), f"SELECT *, CAST(floor(lon/({_SIDE}/cos(radians({_EDGE})))) AS BIGINT) AS col FROM banded"),
    "cubed": (("celled",), "SELECT obs_id, min(obs_id) OVER (PARTITION BY band, col, bucket) AS cube FROM celled"),
}


@query("neighbor_pairs", sql("""SELECT DISTINCT least(a.cube,b.cube) AS a_cube, greatest(a.cube,b.cube) AS b_cube
 FROM close_pairs p JOIN cubed a ON a.obs_id=p.x JOIN cubed b ON b.obs_id=p.y WHERE a.cube<>b.cube""", "close_pairs", "cubed", **CUBES))
def neighbor_pairs(spark, folder):
    """The linkage graph in its sparse form: linked cubes instead of all close pairs."""
    return cluster.linkage_graph(fixtures.observations(spark, folder)).distinct()


@query("cluster_events", sql(f"""SELECT event_id, {half_up('latitude', 6)} AS latitude, {half_up('longitude', 6)} AS longitude,
 start_time, end_time, observation_count FROM summary""", "summary"))
def cluster_events(spark, folder):
    found = cluster.cluster_events(fixtures.observations(spark, folder))
    return found.select("event_id", display_round(F.col("latitude"), 6).alias("latitude"),
                        display_round(F.col("longitude"), 6).alias("longitude"), "start_time", "end_time", "observation_count")


@query("assign_event_ids", sql(
    "SELECT o.obs_id, c.event_id FROM all_obs o LEFT JOIN component c USING (obs_id)", "all_obs", "component",
    all_obs=((), f"SELECT * EXCLUDE (loc) FROM ({fixtures.OBSERVATIONS.format(events='events')})"),
    obs=(("all_obs",), "SELECT * FROM all_obs WHERE confidence IS NULL OR confidence<>50")))
def assign_event_ids(spark, folder):
    """Rows whose position is unknown (here: confidence 50) keep a null event."""
    rows = fixtures.observations(spark, folder).withColumn(
        "latitude", F.when(F.col("confidence").isNull() | (F.col("confidence") != 50), F.col("latitude")))
    return cluster.assign_event_ids(rows, cluster.cluster_assignments(rows)).select("obs_id", "event_id")


@query("persistence_metrics", sql("SELECT * FROM metrics", "metrics"))
def persistence_metrics(spark, folder):
    return events.persistence_metrics(ws.linked(spark, folder))


@query("trend_half_split", sql("SELECT event_id, trend FROM metrics", "metrics"))
def trend_half_split(spark, folder):
    return events.trend_half_split(ws.linked(spark, folder))


NONNULL = {
    "warm": (("linked",), "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, obs_id) AS wrn, "
                          "count(*) OVER (PARTITION BY event_id) AS wsize FROM linked WHERE intensity IS NOT NULL"),
    "warm_means": (("warm",), "SELECT event_id, avg(CASE WHEN wrn<=wsize//2 THEN intensity END) AS f, "
                              "avg(CASE WHEN wrn>wsize//2 THEN intensity END) AS s FROM warm GROUP BY event_id"),
    "warm_trend": (("warm_means",), f"SELECT event_id, {trend('f', 's')} AS trend FROM warm_means"),
    "days": (("linked",), "SELECT DISTINCT event_id, CAST(timestamp AS DATE) AS day FROM linked"),
    "islands": (("days",), "SELECT event_id, day, day - CAST(row_number() OVER (PARTITION BY event_id ORDER BY day) AS INTEGER) AS island FROM days"),
    "runs": (("islands",), "SELECT event_id, max(run) AS consecutive_active_days, CAST(sum(run) AS BIGINT) AS active_days FROM "
                           "(SELECT event_id, island, count(*) AS run FROM islands GROUP BY ALL) GROUP BY event_id"),
    "temporal": (("linked", "warm_trend"), f"""SELECT b.event_id, first_detection, last_detection, active_days,
 {half_up('(epoch_us(last_detection)-epoch_us(first_detection))/3600000000.0::DOUBLE', 2)} AS event_duration_hours,
 {half_up('n/CAST(active_days AS DOUBLE)', 2)} AS detection_frequency, active_days AS recurrence, coalesce(trend,'UNKNOWN') AS temporal_trend
 FROM (SELECT event_id, count(*) AS n, min(timestamp) AS first_detection, max(timestamp) AS last_detection,
  count(DISTINCT CAST(timestamp AS DATE)) AS active_days FROM linked GROUP BY event_id) b LEFT JOIN warm_trend USING (event_id) WHERE n>=2"""),
    "intense": (("linked", "warm_trend"), f"""SELECT b.* EXCLUDE (n), coalesce(trend,'UNKNOWN') AS intensity_trend FROM (SELECT event_id, count(intensity) AS n,
 {half_up('avg(intensity)', 2)} AS mean_brightness_temperature, {half_up('max(intensity)', 2)} AS max_brightness_temperature,
 {half_up('min(intensity)', 2)} AS min_brightness_temperature, {half_up('var_pop(intensity)', 2)} AS intensity_variance,
 {half_up('avg(frp)', 2)} AS frp_mean, {half_up('max(frp)', 2)} AS frp_max, {half_up('min(frp)', 2)} AS frp_min
 FROM linked GROUP BY event_id) b LEFT JOIN warm_trend USING (event_id) WHERE n>=1"""),
    "spatial": (("linked",), f"""SELECT event_id, {half_up('avg(latitude)', 4)} AS centroid_lat, {half_up('avg(longitude)', 4)} AS centroid_lon,
 {half_up('(max(latitude)-min(latitude))*(max(longitude)-min(longitude))', 8)} AS spatial_spread,
 {half_up('var_pop(latitude)+var_pop(longitude)', 8)} AS spatial_variance,
 {half_up('1.0::DOUBLE/(1.0::DOUBLE+var_pop(latitude)+var_pop(longitude))', 8)} AS spatial_stability_index,
 count(DISTINCT ({key_round('latitude', 3)}, {key_round('longitude', 3)})) AS distinct_detections
 FROM linked GROUP BY event_id HAVING count(*)>=2"""),
    "kinds": (("linked", "runs"), f"""SELECT event_id, total_detections, active_days, consecutive_active_days,
 {half_up('total_detections/CAST(active_days AS DOUBLE)', 2)} AS persistence_score,
 CASE WHEN active_days>=3 AND consecutive_active_days>=2 THEN 'PERSISTENT' WHEN active_days>=2 THEN 'RECURRING' ELSE 'ONE_OFF' END AS persistence_type
 FROM (SELECT event_id, count(*) AS total_detections FROM linked GROUP BY event_id HAVING count(*)>=2) JOIN runs USING (event_id)"""),
    "sources": (("linked",), "SELECT event_id, string_agg(source||'='||n, ',' ORDER BY source) AS sources FROM "
                             "(SELECT event_id, source, count(*) AS n FROM linked GROUP BY ALL) GROUP BY event_id"),
    "quality": (("linked", "sources"), f"""SELECT b.*, 1.0::DOUBLE AS completeness, 'SUFFICIENT_HISTORY' AS status, sources FROM (SELECT event_id, count(*) AS observation_count,
 {half_up('avg(confidence)', 2)} AS confidence_mean, count(*) FILTER (confidence<50) AS confidence_low,
 count(*) FILTER (confidence>=50 AND confidence<80) AS confidence_medium, count(*) FILTER (confidence>=80) AS confidence_high,
 count(*) FILTER (confidence IS NULL) AS confidence_null FROM linked GROUP BY event_id) b JOIN sources USING (event_id)"""),
}


def nn(final, *needs):
    return sql(final, *needs, **NONNULL)


def _flat_map(column: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("trend_nonnull_halves", nn("SELECT event_id, trend FROM warm_trend", "warm_trend"))
def trend_nonnull_halves(spark, folder):
    return events.trend_nonnull_halves(ws.linked(spark, folder))


@query("profile_temporal", nn("SELECT * FROM temporal", "temporal"))
def profile_temporal(spark, folder):
    return profile.profile_temporal(ws.linked(spark, folder))


@query("profile_intensity", nn("SELECT * FROM intense", "intense"))
def profile_intensity(spark, folder):
    return profile.profile_intensity(ws.linked(spark, folder))


@query("profile_spatial", nn("SELECT * FROM spatial", "spatial"))
def profile_spatial(spark, folder):
    return profile.profile_spatial(ws.linked(spark, folder))


@query("profile_persistence", nn("""SELECT *, persistence_score AS recurrence_frequency, CASE persistence_type WHEN 'PERSISTENT' THEN 'persistent'
 WHEN 'RECURRING' THEN 'intermittent' ELSE 'one-off' END AS detection_pattern FROM kinds""", "kinds"))
def profile_persistence(spark, folder):
    return profile.profile_persistence(ws.linked(spark, folder))


@query("max_consecutive_days", nn("SELECT * FROM runs", "runs"))
def max_consecutive_days(spark, folder):
    return events.max_consecutive_days(ws.linked(spark, folder))


@query("profile_quality", nn("SELECT * FROM quality", "quality"))
def profile_quality(spark, folder):
    return profile.profile_quality(ws.linked(spark, folder)).withColumn("sources", _flat_map("source_distribution")).drop(
        "source_distribution")


_FLAT = """SELECT q.event_id, first_detection, last_detection, t.active_days, event_duration_hours AS duration_hours,
 detection_frequency, recurrence, temporal_trend AS temporal_pattern, temporal_trend AS trend,
 mean_brightness_temperature AS average_intensity, max_brightness_temperature AS max_intensity,
 min_brightness_temperature AS min_intensity, intensity_variance, intensity_trend, frp_mean, frp_max,
 centroid_lat, centroid_lon, spatial_spread, spatial_variance, spatial_stability_index, distinct_detections,
 persistence_score, consecutive_active_days, persistence_type, observation_count, confidence_mean, confidence_low,
 confidence_medium, confidence_high, confidence_null, sources, completeness AS data_completeness,
 CASE WHEN observation_count>=3 THEN 'SUFFICIENT_HISTORY' ELSE 'INSUFFICIENT_HISTORY' END AS baseline_status,
 coalesce(detection_frequency, 0.0::DOUBLE) AS frequency
 FROM quality q LEFT JOIN temporal t USING (event_id) LEFT JOIN intense i USING (event_id) LEFT JOIN spatial s USING (event_id)
 LEFT JOIN kinds k USING (event_id)"""


@query("profile_flatten_sink", nn(_FLAT, "quality", "temporal", "intense", "spatial", "kinds"))
def profile_flatten_sink(spark, folder):
    flat = profile.flatten_profile(profile.thermal_profile(ws.linked(spark, folder)))
    return flat.withColumn("sources", _flat_map("source_distribution")).drop("source_distribution")


@query("thermal_profile", nn("""SELECT q.event_id, observation_count, CASE WHEN observation_count>=3 THEN 'SUFFICIENT_HISTORY' ELSE 'INSUFFICIENT_HISTORY' END AS baseline_status,
 CASE WHEN t.event_id IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END AS temporal_status,
 CASE WHEN i.event_id IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END AS intensity_status,
 CASE WHEN s.event_id IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END AS spatial_status,
 CASE WHEN k.event_id IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END AS persistence_status,
 temporal_trend, event_duration_hours, mean_brightness_temperature, frp_mean, spatial_stability_index, persistence_type, completeness
 FROM quality q LEFT JOIN temporal t USING (event_id) LEFT JOIN intense i USING (event_id) LEFT JOIN spatial s USING (event_id)
 LEFT JOIN kinds k USING (event_id)""", "quality", "temporal", "intense", "spatial", "kinds"))
def thermal_profile(spark, folder):
    return profile.thermal_profile(ws.linked(spark, folder)).select(
        "event_id", "observation_count", "baseline_status",
        *(F.col(f"{n}_features.status").alias(f"{n}_status") for n in ("temporal", "intensity", "spatial", "persistence")),
        F.col("temporal_features.temporal_trend").alias("temporal_trend"),
        F.col("temporal_features.event_duration_hours").alias("event_duration_hours"),
        F.col("intensity_features.mean_brightness_temperature").alias("mean_brightness_temperature"),
        F.col("intensity_features.frp_mean").alias("frp_mean"),
        F.col("spatial_features.spatial_stability_index").alias("spatial_stability_index"),
        F.col("persistence_features.persistence_type").alias("persistence_type"),
        F.col("data_quality.completeness").alias("completeness"))


@query("event_listing_agg", sql(f"""SELECT event_id, count(*) AS observation_count, {half_up('avg(intensity)', 6)} AS average_intensity,
 {half_up('avg(confidence)', 6)} AS average_confidence, CASE WHEN count(DISTINCT source)=1 THEN min(source) ELSE 'MULTIPLE' END AS source
 FROM linked GROUP BY event_id""", "linked"))
def event_listing_agg(spark, folder):
    return events.listing_aggregates(ws.linked(spark, folder)).select(
        "event_id", "observation_count", display_round(F.col("average_intensity"), 6).alias("average_intensity"),
        display_round(F.col("average_confidence"), 6).alias("average_confidence"), "source")


@query("event_summary_dna", sql("""SELECT event_id, trend AS persistence, printf('%.1f detections/day', floor(persistence_score*10+0.5)/10) AS frequency,
 average_intensity AS intensity, spatial_stability, trend, total_detections, active_days FROM metrics""", "metrics"))
def event_summary_dna(spark, folder):
    return events.summary_dna(ws.metrics(spark, folder))


@query("confidence_category_first", sql("""SELECT event_id, arg_min(confidence_category, (epoch_us(timestamp), obs_id)) FILTER (confidence_category IS NOT NULL) AS confidence_category
 FROM linked GROUP BY event_id""", "linked"))
def confidence_category_first(spark, folder):
    return events.confidence_category_first(ws.linked(spark, folder))


def _feature_sql(source: str) -> dict:
    return {
        "fm": ((source,), f"""SELECT event_id, count(*) AS n, count(DISTINCT CAST(timestamp AS DATE)) AS days,
 avg(CASE WHEN frn<=fsize//2 THEN intensity END) AS f, avg(CASE WHEN frn>fsize//2 THEN intensity END) AS s,
 var_pop(latitude)+var_pop(longitude) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, obs_id) AS frn,
  count(*) OVER (PARTITION BY event_id) AS fsize FROM {source}) GROUP BY event_id"""),
        "centre": ((source,), f"SELECT event_id, avg(latitude) AS clat, avg(longitude) AS clon, count(*) AS cn FROM {source} GROUP BY event_id"),
        "far": ((source, "centre"), f"""SELECT event_id, sqrt(max(pow(111.2::DOUBLE*(latitude-clat),2)+pow(111.2::DOUBLE*cos(radians(clat))*(longitude-clon),2))) AS spread
 FROM {source} JOIN centre USING (event_id) WHERE cn>=2 GROUP BY event_id"""),
        "feats": ((source, "fm", "far"), f"""SELECT b.event_id, {half_up('b.observation_count', 6)} AS observation_count, {half_up('days', 6)} AS active_days,
 {half_up('n/CAST(days AS DOUBLE)', 2)} AS persistence_score, {half_up('duration_hours', 6)} AS duration_hours,
 CASE WHEN n<4 THEN NULL ELSE CASE {trend('f', 's')} WHEN 'DECREASING' THEN -1.0::DOUBLE WHEN 'STABLE' THEN 0.0::DOUBLE WHEN 'INCREASING' THEN 1.0::DOUBLE END END AS temporal_trend,
 CASE WHEN n>1 THEN {half_up('v', 8)} END AS spatial_stability,
 {half_up('mean_intensity', 6)} AS mean_intensity, {half_up('max_intensity', 6)} AS max_intensity, {half_up('intensity_variance', 4)} AS intensity_variance,
 {half_up('mean_confidence', 6)} AS mean_confidence, {half_up('mean_frp', 6)} AS mean_frp, {half_up('max_frp', 6)} AS max_frp, {half_up('frp_variance', 4)} AS frp_variance,
 {half_up('mean_secondary_brightness', 6)} AS mean_secondary_brightness, {half_up('mean_scan', 6)} AS mean_scan, {half_up('mean_track', 6)} AS mean_track,
 {half_up('night_fraction', 6)} AS night_fraction, {half_up('spread', 6)} AS spatial_spread_km, {half_up('days', 6)} AS recurrence_days
 FROM (SELECT event_id, CAST(count(*) AS DOUBLE) AS observation_count,
  CASE WHEN count(*)>=2 THEN (epoch_us(max(timestamp))-epoch_us(min(timestamp)))/3600000000.0::DOUBLE END AS duration_hours,
  avg(intensity) AS mean_intensity, max(intensity) AS max_intensity, CASE WHEN count(intensity)>=2 THEN var_pop(intensity) END AS intensity_variance,
  avg(confidence) AS mean_confidence, avg(frp) AS mean_frp, max(frp) AS max_frp, CASE WHEN count(frp)>=2 THEN var_pop(frp) END AS frp_variance,
  avg(coalesce(bright_ti5, bright_t31)) AS mean_secondary_brightness, avg(scan) AS mean_scan, avg(track) AS mean_track,
  avg(CASE daynight WHEN 'N' THEN 1.0::DOUBLE WHEN 'D' THEN 0.0::DOUBLE END) AS night_fraction FROM {source} GROUP BY event_id) b
 JOIN fm USING (event_id) LEFT JOIN far USING (event_id)"""),
    }


FIRST_DAY = {"first_rows": (("linked",), "SELECT * EXCLUDE (day, first_day) FROM (SELECT *, CAST(timestamp AS DATE) AS day, "
                                          "min(CAST(timestamp AS DATE)) OVER (PARTITION BY event_id) AS first_day FROM linked) WHERE day=first_day")}


def _rounded(df):
    return df.select("event_id", *(
        (F.col(c) if c in ("persistence_score", "spatial_stability", "temporal_trend") else display_round(F.col(c), 4 if c.endswith("variance") else 6)).alias(c)
        for c in df.columns if c != "event_id"))


@query("extract_features", sql("SELECT * FROM feats", "feats", **_feature_sql("linked")))
def extract_features(spark, folder):
    return _rounded(features.extract_features(ws.linked(spark, folder), ws.metrics(spark, folder)).drop(
        "historical_activity", "facility_distance_km"))


@query("first_day_features", sql(f"SELECT event_id, {', '.join(features.FIRST_DAY_FEATURES)} FROM feats", "feats",
                                 **FIRST_DAY, **_feature_sql("first_rows")))
def first_day_features(spark, folder):
    return _rounded(features.first_day_features(ws.linked(spark, folder)))


@query("first_day_rows", sql("SELECT obs_id, event_id, timestamp FROM first_rows", "first_rows", **FIRST_DAY))
def first_day_rows(spark, folder):
    return events.first_day_rows(ws.linked(spark, folder)).select("obs_id", "event_id", "timestamp")


@query("day_one_cluster_check", sql("""SELECT DISTINCT event_id FROM (SELECT event_id, min(root) AS root FROM walk GROUP BY event_id, n)
 GROUP BY event_id HAVING count(DISTINCT root)=1""", "walk", **FIRST_DAY,
    day_edges=(("close_pairs", "first_rows"), "SELECT p.x, p.y, a.event_id FROM both_ways p JOIN first_rows a ON a.obs_id=p.x JOIN first_rows b ON b.obs_id=p.y AND a.event_id=b.event_id"),
    walk=(("first_rows", "both_ways", "day_edges"), "SELECT event_id, obs_id AS n, obs_id AS root FROM first_rows UNION "
          "SELECT w.event_id, e.y, w.root FROM walk w JOIN day_edges e ON e.x=w.n WHERE w.root<e.y")))
def day_one_cluster_check(spark, folder):
    return cluster.single_cluster_groups(events.first_day_rows(ws.linked(spark, folder)), "event_id")


@query("event_daily_history_first", sql("""SELECT event_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, min(timestamp) AS timestamp,
 max(CASE WHEN drn=1 THEN intensity END) AS intensity, max(CASE WHEN drn=1 THEN confidence END) AS confidence, count(*) AS observation_count FROM
 (SELECT *, row_number() OVER (PARTITION BY event_id, CAST(timestamp AS DATE) ORDER BY timestamp, obs_id) AS drn FROM linked) GROUP BY event_id, CAST(timestamp AS DATE)""", "linked"))
def event_daily_history_first(spark, folder):
    return events.daily_history_first(ws.linked(spark, folder))


@query("event_daily_history_avg", sql(f"""SELECT event_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, min(timestamp) AS timestamp,
 {half_up('avg(intensity)', 2)} AS intensity, {half_up('avg(confidence)', 2)} AS confidence, count(*) AS observation_count FROM linked
 GROUP BY event_id, CAST(timestamp AS DATE)""", "linked"))
def event_daily_history_avg(spark, folder):
    return events.daily_history_avg(ws.linked(spark, folder))


@query("first_last_observation", sql("""SELECT event_id, max(CASE WHEN rn=1 THEN obs_id END) AS first_obs, max(CASE WHEN rn=1 THEN timestamp END) AS first_time,
 max(CASE WHEN rn=size THEN obs_id END) AS last_obs, max(CASE WHEN rn=size THEN timestamp END) AS last_time, max(CASE WHEN rn=size THEN intensity END) AS last_intensity
 FROM ranked GROUP BY event_id""", "ranked"))
def first_last_observation(spark, folder):
    return events.first_last_observation(ws.linked(spark, folder)).select(
        "event_id", F.col("first.obs_id").alias("first_obs"), F.col("first.timestamp").alias("first_time"),
        F.col("last.obs_id").alias("last_obs"), F.col("last.timestamp").alias("last_time"),
        F.col("last.intensity").alias("last_intensity"))


@query("persistent_sources", sql("""SELECT event_id, observation_count, 'CONFIRMED' AS persistence_type, observation_count AS persistence_score,
 greatest(1, observation_count//2) AS active_days_estimate FROM summary WHERE observation_count>=3""", "summary"))
def persistent_sources(spark, folder):
    return events.persistent_sources(ws.events(spark, folder).select("event_id", "observation_count"))


@query("lifecycle_status", sql("SELECT event_id, end_time, active_days, observation_count, status FROM ev", "ev"))
def lifecycle_status(spark, folder):
    return events.event_table(ws.metrics(spark, folder), cluster.summarize_events(ws.linked(spark, folder))).select(
        "event_id", "end_time", "active_days", "observation_count", "status")


@query("event_stable_id", sql("""SELECT event_id, base+row_number() OVER (PARTITION BY base ORDER BY event_id)-1 AS stable_id FROM
 (SELECT event_id, 100000+CAST('0x'||substr(sha256(source||'|'||printf('%.5f',latitude)||'|'||printf('%.5f',longitude)||'|'||strftime(timestamp,'%Y-%m-%dT%H:%M:%S.%f')||'+00:00'),1,8) AS BIGINT) AS base
  FROM ranked WHERE rn=1)""", "ranked"))
def event_stable_id(spark, folder):
    return events.stable_event_ids(ws.linked(spark, folder))


@query("flatten_observations", sql("SELECT event_id, obs_id, timestamp, intensity FROM linked", "linked"))
def flatten_observations(spark, folder):
    """Members of all events in one relation."""
    return ws.linked(spark, folder).select("event_id", "obs_id", "timestamp", "intensity")


@query("recount_event_observations", sql("SELECT event_id, count(*) AS observation_count FROM linked WHERE confidence IS NOT NULL GROUP BY event_id", "linked"))
def recount_event_observations(spark, folder):
    """Counts from real links after the rows without confidence were unlinked."""
    from emberline.operators.merge import recount_events
    rows = ws.linked(spark, folder).withColumn("event_id", F.when(F.col("confidence").isNotNull(), F.col("event_id")))
    return recount_events(ws.events(spark, folder), rows).filter("observation_count > 0").select("event_id", "observation_count")

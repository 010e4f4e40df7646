"""Queries over stored tables: quality, merging, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import fixtures
from emberline.operators import merge, quality
from emberline.operators.cluster import Linker, summarize_events
from emberline.queries import workspace as ws
from emberline.queries.oracle import half_up, key_round, sql
from emberline.queries.registry import query

# Rows of unknown confidence count as not linked here, so that orphans exist.
LOOSE = {
    "loose": (("linked",), "SELECT * REPLACE (CASE WHEN confidence IS NULL THEN NULL ELSE event_id END AS event_id) FROM linked"),
    "loose_n": (("summary", "loose"), "SELECT s.event_id, count(l.obs_id) AS n FROM summary s LEFT JOIN loose l USING (event_id) GROUP BY 1"),
}


def lo(final, *needs):
    return sql(final, *needs, **LOOSE)


def _loose(spark, folder):
    return ws.linked(spark, folder).withColumn("event_id", F.when(F.col("confidence").isNotNull(), F.col("event_id")))


@query("event_observations", sql("SELECT l.obs_id, l.event_id, e.status, e.start_time FROM linked l JOIN ev e USING (event_id)", "linked", "ev"))
def event_observations(spark, folder):
    return quality.event_observations(ws.events(spark, folder), ws.linked(spark, folder)).select("obs_id", "event_id", "status", "start_time")


@query("events_with_observations", lo("SELECT event_id FROM loose_n WHERE n>0", "loose_n"))
def events_with_observations(spark, folder):
    return quality.events_with_observations(ws.events(spark, folder), _loose(spark, folder)).select("event_id")


@query("orphan_events", lo("SELECT event_id FROM loose_n WHERE n=0", "loose_n"))
def orphan_events(spark, folder):
    return quality.orphan_events(ws.events(spark, folder), _loose(spark, folder)).select("event_id")


@query("observations_per_event", lo("SELECT * FROM loose_n", "loose_n"))
def observations_per_event(spark, folder):
    return quality.observations_per_event(ws.events(spark, folder), _loose(spark, folder))


@query("count_mismatches", lo("SELECT event_id, observation_count, n AS actual FROM loose_n JOIN summary USING (event_id) WHERE observation_count<>n", "loose_n", "summary"))
def count_mismatches(spark, folder):
    return quality.count_mismatches(ws.events(spark, folder), _loose(spark, folder))


@query("confidence_histogram", sql("""SELECT bucket, count(confidence) AS n FROM (VALUES ('0-20'),('20-40'),('40-60'),('60-80'),('80-100')) b(bucket)
 LEFT JOIN obs ON bucket=CASE WHEN confidence<20 THEN '0-20' WHEN confidence<40 THEN '20-40' WHEN confidence<60 THEN '40-60' WHEN confidence<80 THEN '60-80' WHEN confidence IS NOT NULL THEN '80-100' END GROUP BY 1""", "obs"))
def confidence_histogram(spark, folder):
    return quality.confidence_histogram(fixtures.observations(spark, folder))


_RECUR = (f"SELECT {key_round('latitude', 3)} AS latitude, {key_round('longitude', 3)} AS longitude, count(*) AS detection_count, count(DISTINCT CAST(timestamp AS DATE)) AS unique_days, "
          "min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM obs GROUP BY 1,2 HAVING count(*)>=2 AND count(DISTINCT CAST(timestamp AS DATE))>=2")


@query("recurring_locations", sql(f"SELECT * FROM ({_RECUR}) ORDER BY detection_count DESC, latitude, longitude LIMIT 10", "obs"))
def recurring_locations(spark, folder):
    return quality.recurring_locations(fixtures.observations(spark, folder))


@query("date_span", sql("""SELECT min(timestamp) AS "start", max(timestamp) AS "end", CAST(floor((epoch_us(max(timestamp))-epoch_us(min(timestamp)))/86400000000.0::DOUBLE) AS BIGINT)+1 AS span_days,
 count(DISTINCT CAST(timestamp AS DATE)) AS unique_dates FROM obs""", "obs"))
def date_span(spark, folder):
    return quality.date_span(fixtures.observations(spark, folder))


@query("data_quality_report", lo(f"""SELECT count(*) AS observation_count, count(*) AS coordinates_valid, 0 AS missing_latitude, count(*) AS critical_valid, max(timestamp) AS latest_observation,
 (SELECT CAST(coalesce(sum(n-1),0) AS BIGINT) FROM (SELECT count(*) AS n FROM obs GROUP BY {key_round('latitude', 4)}, {key_round('longitude', 4)}, timestamp)) AS duplicates, 0 AS invalid_coordinates,
 (SELECT count(*) FROM summary) AS total_events, (SELECT count(*) FROM loose_n WHERE n=0) AS orphan_events,
 (SELECT count(*) FROM loose_n JOIN summary USING (event_id) WHERE n<>observation_count) AS count_mismatches, (SELECT count(*) FROM ({_RECUR})) AS recurring_locations,
 count(DISTINCT CAST(timestamp AS DATE)) AS unique_dates, count(*) FILTER (source='MODIS_NRT') AS modis, count(*) FILTER (confidence>=80) AS confident FROM obs""", "obs", "summary", "loose_n"))
def data_quality_report(spark, folder):
    report = quality.data_quality_report(fixtures.observations(spark, folder), ws.events(spark, folder), _loose(spark, folder))
    return report.select("observation_count", "coordinates_valid", "missing_latitude", "critical_valid", "latest_observation", "duplicates", "invalid_coordinates",
                         "total_events", "orphan_events", "count_mismatches", "recurring_locations", "unique_dates",
                         F.col("source_distribution")["MODIS_NRT"].alias("modis"), F.col("confidence_distribution")["80-100"].alias("confident"))


@query("local_quality", sql("""SELECT count(*) AS total_observations, count(*) FILTER (confidence<50) AS confidence_low, count(*) FILTER (confidence>=50 AND confidence<80) AS confidence_medium,
 count(*) FILTER (confidence>=80) AS confidence_high, count(DISTINCT CAST(timestamp AS DATE)) AS days, (SELECT count(*) FROM metrics WHERE active_days>1) AS recurring_locations,
 (SELECT count(DISTINCT CAST(start_time AS DATE)) FROM summary) AS start_days FROM obs""", "obs", "metrics", "summary"))
def local_quality(spark, folder):
    return quality.local_quality(fixtures.observations(spark, folder), ws.events(spark, folder))


@query("events_by_start_day", sql("SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, count(*) AS events FROM summary GROUP BY 1", "summary"))
def events_by_start_day(spark, folder):
    return quality.events_by_start_day(ws.events(spark, folder))


@query("obs_per_event_histogram", lo("SELECT n, count(*) AS events, count(*) FILTER (start_time=end_time) AS instant_events FROM loose_n JOIN summary USING (event_id) GROUP BY 1", "loose_n", "summary"))
def obs_per_event_histogram(spark, folder):
    return quality.size_histogram(ws.events(spark, folder), _loose(spark, folder))


@query("start_hour_histogram", sql("SELECT extract(hour FROM start_time) AS hour, count(*) AS events FROM summary GROUP BY 1", "summary"))
def start_hour_histogram(spark, folder):
    return quality.start_hour_histogram(ws.events(spark, folder))


@query("recurring_cells", sql(f"SELECT {key_round('latitude', 2)} AS latitude, {key_round('longitude', 2)} AS longitude, count(*) AS detection_count FROM obs GROUP BY 1,2 HAVING count(*)>=2 AND count(DISTINCT CAST(timestamp AS DATE))>=2", "obs"))
def recurring_cells(spark, folder):
    return quality.location_recurrence(fixtures.observations(spark, folder), 2).select("latitude", "longitude", "detection_count")


from emberline.queries.scoring import RISK  # noqa: E402


@query("ml_readiness_audit", sql(f"""SELECT (SELECT count(*) FROM obs) AS observations, (SELECT max(timestamp) FROM obs) AS last_time, (SELECT count(*) FROM obs WHERE intensity IS NULL) AS missing_intensity,
 (SELECT count(*) FROM obs WHERE confidence IS NULL) AS missing_confidence, (SELECT count(frp) FROM obs) AS with_frp, (SELECT count(track) FROM obs) AS with_track,
 (SELECT count(coalesce(bright_ti5, bright_t31)) FROM obs) AS with_secondary, (SELECT min(latitude) FROM obs) AS lat_min, (SELECT max(longitude) FROM obs) AS lon_max,
 count(*) AS events, count(*) FILTER (total_detections>=3) AS events_3, count(*) FILTER (total_detections>=5) AS events_5, count(*) FILTER (total_detections>=10) AS events_10,
 min(risk_score) AS score_min, max(risk_score) AS score_max, {half_up('avg(risk_score)', 4)} AS score_avg, count(*) FILTER (severity='LOW') AS severity_low, count(*) FILTER (severity='MEDIUM') AS severity_medium FROM risked""", "obs", "risked", **RISK))
def ml_readiness_audit(spark, folder):
    audit = quality.readiness_audit(fixtures.observations(spark, folder), ws.events(spark, folder), ws.risk(spark, folder))
    return audit.select("observations", "last_time", "missing_intensity", "missing_confidence", "with_frp", "with_track", "with_secondary", "lat_min", "lon_max",
                        "events", "events_3", "events_5", "events_10", "score_min", "score_max", "score_avg", "severity_low", "severity_medium")


@query("source_share", sql(f"SELECT source, count(*) AS n, {half_up('count(*)*100.0::DOUBLE/(SELECT count(*) FROM obs)', 1)} AS share_pct FROM obs GROUP BY 1", "obs"))
def source_share(spark, folder):
    return quality.source_share(fixtures.observations(spark, folder))


# The stored side holds what was known before the cut-off; the whole table arrives.
CUT = "2024-01-20 00:00:00"
OLD = {
    "old_obs": (("obs",), f"SELECT * FROM obs WHERE timestamp<TIMESTAMP '{CUT}'"),
    "old_pairs": (("both_ways", "old_obs"), "SELECT x, y FROM both_ways WHERE x IN (SELECT obs_id FROM old_obs) AND y IN (SELECT obs_id FROM old_obs)"),
    "old_reach": (("old_obs", "old_pairs"), "SELECT obs_id AS n, obs_id AS root FROM old_obs UNION SELECT e.y, r.root FROM old_reach r JOIN old_pairs e ON e.x=r.n WHERE r.root<e.y"),
    "old_linked": (("old_obs", "old_reach"), "SELECT o.*, c.event_id FROM old_obs o JOIN (SELECT n AS obs_id, min(root) AS event_id FROM old_reach GROUP BY 1) c USING (obs_id)"),
    "old_summary": (("old_linked",), "SELECT event_id, avg(latitude) AS latitude, avg(longitude) AS longitude, min(timestamp) AS start_time, max(timestamp) AS end_time FROM old_linked GROUP BY 1"),
}


def old(final, *needs):
    return sql(final, *needs, **OLD)


def _old_linked(spark, folder):
    def build():
        rows = fixtures.observations(spark, folder).filter(F.col("timestamp") < F.lit(CUT).cast("timestamp"))
        return Linker(rows).attach(rows)

    return ws.stored(spark, folder, "old_linked", build)


@query("match_existing_events", old("""SELECT s.event_id, min(o.event_id) AS stored_id, CASE WHEN min(o.event_id) IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM summary s
 LEFT JOIN old_summary o ON o.start_time=s.start_time AND o.end_time=s.end_time AND abs(o.latitude-s.latitude)<=0.001 AND abs(o.longitude-s.longitude)<=0.001 GROUP BY s.event_id""", "summary", "old_summary"))
def match_existing_events(spark, folder):
    return merge.match_existing_events(summarize_events(ws.linked(spark, folder)), summarize_events(_old_linked(spark, folder))).select(
        "event_id", "stored_id", "outcome")


@query("merge_capture_into_events", old("""SELECT l.event_id, count(*) AS members, count(o.event_id) AS known_members, CASE WHEN min(o.event_id)=max(o.event_id) THEN min(o.event_id) END AS stored_id,
 CASE WHEN count(DISTINCT o.event_id)=0 THEN 'created' WHEN count(DISTINCT o.event_id)=1 THEN 'adopted' ELSE 'conflict' END AS outcome
 FROM linked l LEFT JOIN old_linked o USING (source, timestamp, latitude, longitude, sensor) GROUP BY 1""", "linked", "old_linked"))
def merge_capture_into_events(spark, folder):
    return merge.merge_capture_into_events(ws.linked(spark, folder), _old_linked(spark, folder))


_UPSERT = """SELECT coalesce(s.obs_id,b.obs_id) AS obs_id, timestamp, latitude, longitude, source, CASE WHEN b.obs_id IS NULL THEN s.intensity ELSE b.intensity END AS intensity,
 CASE WHEN s.obs_id IS NULL THEN 'inserted' WHEN b.obs_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome
 FROM old_obs s FULL JOIN (SELECT * REPLACE (intensity+1 AS intensity) FROM obs WHERE timestamp>=TIMESTAMP '2024-01-10 00:00:00') b USING (timestamp, latitude, longitude, source)"""


def _batch(spark, folder):
    """Re-delivery from 10 January on, with corrected intensities, twice per row."""
    fresh = fixtures.observations(spark, folder).filter(F.col("timestamp") >= F.lit("2024-01-10 00:00:00").cast("timestamp"))
    first = fresh.withColumn("line_no", F.col("obs_id") * 2)
    again = fresh.withColumn("line_no", F.col("obs_id") * 2 + 1).withColumn("intensity", F.col("intensity") + 1)
    return first.unionByName(again)


def _upserted(spark, folder):
    stored = fixtures.observations(spark, folder).filter(F.col("timestamp") < F.lit(CUT).cast("timestamp"))
    return merge.upsert_observations(stored, _batch(spark, folder))


@query("upsert_observations", old(_UPSERT, "old_obs", "obs"))
def upsert_observations(spark, folder):
    return _upserted(spark, folder).select("obs_id", "timestamp", "latitude", "longitude", "source", "intensity", "outcome")


@query("upsert_counts", old(f"SELECT count(*) FILTER (outcome='inserted') AS inserted, count(*) FILTER (outcome='updated') AS updated FROM ({_UPSERT})", "old_obs", "obs"))
def upsert_counts(spark, folder):
    return merge.upsert_counts(_upserted(spark, folder))


@query("observation_sink", sql("SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, source, count(*) AS n, min(obs_id) AS first_id FROM obs WHERE timestamp>=TIMESTAMP '2024-01-15' GROUP BY 1,2", "obs"))
def observation_sink(spark, folder):
    """Written partitioned by day and source, read back with pruned partitions."""
    from emberline.sources.tables import read_observations, write_observations
    path = ws.folder_for(spark, folder, "observation_sink", lambda path: write_observations(fixtures.observations(spark, folder), path))
    stored = read_observations(spark, path).filter(F.col("date") >= F.lit("2024-01-15").cast("date"))
    return stored.groupBy("date", "source").agg(F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first_id"))



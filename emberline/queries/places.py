"""Queries over places and periods: radius joins, history, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import fixtures
from emberline.functions.geo import Area
from emberline.functions.numeric import display_round
from emberline.functions.parsing import metadata_number, metadata_text
from emberline.operators import geojoin, history, listing, quality
from emberline.operators.nearest import nearest_rows
from emberline.queries import workspace as ws
from emberline.queries.oracle import half_up, sql
from emberline.queries.registry import query
from emberline.sources import layout

PLACES = {
    "box": (("points", "linked"), """SELECT p.point_id, l.* FROM points p JOIN linked l ON l.latitude BETWEEN p.latitude-50.0::DOUBLE/111.0::DOUBLE AND p.latitude+50.0::DOUBLE/111.0::DOUBLE
 AND l.longitude BETWEEN p.longitude-50.0::DOUBLE/(111.0::DOUBLE*cos(radians(p.latitude))) AND p.longitude+50.0::DOUBLE/(111.0::DOUBLE*cos(radians(p.latitude)))"""),
    "circle": (("points", "linked"), """SELECT p.point_id, l.* FROM points p JOIN linked l ON sqrt(pow((l.latitude-p.latitude)*111.0::DOUBLE,2)
 +pow((l.longitude-p.longitude)*111.0::DOUBLE*cos(radians(p.latitude)),2))<=50"""),
    "near_fac": (("summary", "facilities"), """SELECT * FROM (SELECT s.event_id, f.facility_id, f.name, f.type, sqrt(pow((f.latitude-s.latitude)*111.0::DOUBLE,2)
 +pow((f.longitude-s.longitude)*111.0::DOUBLE*cos(radians(s.latitude)),2)) AS km FROM summary s JOIN facilities f ON abs(f.latitude-s.latitude)<0.1) WHERE km<=5"""),
    "hours_n": (("box",), "SELECT point_id, extract(hour FROM timestamp) AS k, count(*) AS n FROM box GROUP BY ALL"),
    "days_n": (("box",), "SELECT point_id, dayname(timestamp) AS k, count(*) AS n FROM box GROUP BY ALL"),
    "peaks": (("hours_n", "days_n"), """SELECT h.point_id, peak_hour, peak_day FROM (SELECT point_id, k AS peak_hour FROM hours_n QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n DESC, k)=1) h
 JOIN (SELECT point_id, k AS peak_day FROM days_n QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n DESC, k)=1) d USING (point_id)"""),
    "box_sources": (("box",), "SELECT point_id, string_agg(source||'='||n, ',' ORDER BY source) AS sources FROM (SELECT point_id, source, count(*) AS n FROM box GROUP BY ALL) GROUP BY point_id"),
    "stats": (("box", "peaks", "box_sources", "points"), f"""SELECT p.point_id, coalesce(observation_count,0) AS observation_count, unique_days, range_start, range_end, intensity_mean, intensity_max, intensity_min, intensity_std,
 peak_hour, peak_day, sources, CASE WHEN observation_count>=5 THEN 'SUFFICIENT_HISTORY' WHEN observation_count>=2 THEN 'INSUFFICIENT_HISTORY' ELSE 'NO_HISTORY' END AS baseline_status
 FROM points p LEFT JOIN (SELECT point_id, count(*) AS observation_count, count(DISTINCT CAST(timestamp AS DATE)) AS unique_days, min(timestamp) AS range_start, max(timestamp) AS range_end,
 {half_up('avg(intensity)', 2)} AS intensity_mean, {half_up('max(intensity)', 2)} AS intensity_max, {half_up('min(intensity)', 2)} AS intensity_min, {half_up('stddev_pop(intensity)', 2)} AS intensity_std
 FROM box GROUP BY point_id) b USING (point_id) LEFT JOIN peaks USING (point_id) LEFT JOIN box_sources USING (point_id)"""),
    "hours": (("summary",), "SELECT event_id, (epoch_us(end_time)-epoch_us(start_time))/3600000000.0::DOUBLE AS hours FROM summary"),
    "mean_hours": (("box", "hours"), f"SELECT point_id, {half_up('avg(hours)', 2)} AS mean_duration FROM (SELECT DISTINCT point_id, event_id FROM box) JOIN hours USING (event_id) GROUP BY point_id"),
    "baseline": (("stats", "mean_hours"), f"""SELECT point_id, baseline_status AS status, observation_count,
 CASE WHEN baseline_status='SUFFICIENT_HISTORY' THEN {half_up('observation_count/CAST(unique_days AS DOUBLE)', 2)} END AS expected_detection_frequency,
 CASE WHEN observation_count>=2 THEN intensity_min END AS expected_intensity_min, CASE WHEN observation_count>=2 THEN intensity_max END AS expected_intensity_max,
 CASE WHEN observation_count>=2 THEN intensity_mean END AS expected_intensity_mean, CASE WHEN observation_count>=2 THEN unique_days END AS expected_recurrence,
 CASE WHEN baseline_status='SUFFICIENT_HISTORY' THEN mean_duration END AS expected_duration,
 CASE WHEN observation_count>=2 THEN peak_hour END AS peak_hour, CASE WHEN observation_count>=2 THEN peak_day END AS peak_day FROM stats LEFT JOIN mean_hours USING (point_id)"""),
    "current": (("box",), "SELECT * FROM box WHERE timestamp>=(SELECT max(timestamp) FROM linked)-INTERVAL 1 DAY"),
    "now": (("current",), "SELECT point_id, count(*) AS c, avg(intensity) AS m, CASE WHEN count(*)>=2 THEN (epoch_us(max(timestamp))-epoch_us(min(timestamp)))/3600000000.0::DOUBLE END AS h FROM current GROUP BY point_id"),
}


def pl(final, *needs):
    return sql(final, *needs, **PLACES)


def _sources(df):
    shown = F.transform(F.array_sort(F.map_entries("source_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("sources", F.array_join(shown, ",")).drop("source_distribution")


@query("radius_box_join", pl("SELECT point_id, obs_id FROM box", "box"))
def radius_box_join(spark, folder):
    return geojoin.radius_box_join(fixtures.query_points(spark, folder), fixtures.observations(spark, folder)).select("point_id", "obs_id")


@query("radius_circle_join", pl("SELECT point_id, obs_id FROM circle", "circle"))
def radius_circle_join(spark, folder):
    return geojoin.radius_circle_join(fixtures.query_points(spark, folder), fixtures.observations(spark, folder)).select("point_id", "obs_id")


@query("facilities_nearby", pl(f"SELECT event_id, facility_id, name, type, {half_up('km', 6)} AS distance_km FROM near_fac", "near_fac"))
def facilities_nearby(spark, folder):
    near = geojoin.facilities_nearby(ws.events(spark, folder), fixtures.facilities(spark, folder))
    return near.withColumn("distance_km", display_round(F.col("distance_km"), 6))


@query("curve_layout_box", sql("SELECT obs_id, latitude, longitude, timestamp FROM obs WHERE latitude BETWEEN 8.0 AND 15.5 AND longitude BETWEEN 69.0 AND 70.0 AND timestamp>=TIMESTAMP '2024-01-10' AND timestamp<TIMESTAMP '2024-01-25'", "obs"))
def curve_layout_box(spark, folder):
    """A box and a time range, from the files of the curve layout that may hold them."""
    path = ws.folder_for(spark, folder, "curve_layout", lambda path: layout.write_by_cell(fixtures.observations(spark, folder), path, 16))
    return layout.read_box(spark, path, Area(69.0, 8.0, 70.0, 15.5), "2024-01-10 00:00:00", "2024-01-25 00:00:00", ["obs_id", "latitude", "longitude", "timestamp"])


@query("nearest_facilities", pl(f"""SELECT event_id, place, facility_id, {half_up('km', 6)} AS distance_km FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY km, facility_id) AS INT) AS place FROM
 (SELECT s.event_id, f.facility_id, sqrt(pow((f.latitude-s.latitude)*111.0::DOUBLE,2)+pow((f.longitude-s.longitude)*111.0::DOUBLE*cos(radians(s.latitude)),2)) AS km FROM summary s, facilities f)) WHERE place<=3""", "summary", "facilities"))
def nearest_facilities(spark, folder):
    """The three nearest of a catalogue of any size, by going down its quadtree."""
    found = nearest_rows(ws.events(spark, folder), fixtures.facilities(spark, folder), 3)
    return found.withColumn("distance_km", display_round(F.col("distance_km"), 6))


@query("context_features", pl(f"""SELECT s.event_id, historical_activity, facility_distance_km FROM summary s LEFT JOIN
 (SELECT b.event_id, CAST(sum(n) AS DOUBLE) AS historical_activity FROM (SELECT event_id, floor(latitude/0.1::DOUBLE+0.5::DOUBLE)+i AS a, floor(longitude/0.1::DOUBLE+0.5::DOUBLE)+j AS b FROM summary, (VALUES (-1),(0),(1)) x(i), (VALUES (-1),(0),(1)) y(j)) b
  JOIN (SELECT floor(latitude/0.1::DOUBLE+0.5::DOUBLE) AS a, floor(longitude/0.1::DOUBLE+0.5::DOUBLE) AS b, count(*) AS n FROM linked GROUP BY 1,2) c ON b.a=c.a AND b.b=c.b GROUP BY 1) USING (event_id)
 LEFT JOIN (SELECT event_id, {half_up('min(km)', 6)} AS facility_distance_km FROM near_fac GROUP BY 1) USING (event_id)""", "summary", "linked", "near_fac"))
def context_features(spark, folder):
    context = geojoin.context_features(ws.events(spark, folder), ws.linked(spark, folder), fixtures.facilities(spark, folder))
    return context.withColumn("facility_distance_km", display_round(F.col("facility_distance_km"), 6))


@query("region_filter", sql("SELECT obs_id, latitude, longitude FROM obs WHERE latitude BETWEEN 6.5 AND 35.5 AND longitude BETWEEN 68.0 AND 97.5", "obs"))
def region_filter(spark, folder):
    return listing.region_filter(fixtures.observations(spark, folder)).select("obs_id", "latitude", "longitude")


_SHIFTED = {"moved": (("summary",), "SELECT event_id, latitude-5 AS latitude, longitude, start_time, observation_count FROM summary")}


@query("outside_region", sql(f"""SELECT event_id, {half_up('latitude', 6)} AS latitude, {half_up('longitude', 6)} AS longitude, start_time, observation_count FROM moved
 WHERE NOT (latitude BETWEEN 6.5 AND 35.5 AND longitude BETWEEN 68.0 AND 97.5)""", "moved", **_SHIFTED))
def outside_region(spark, folder):
    """All events moved five degrees south, so that some leave the region."""
    moved = ws.events(spark, folder).withColumn("latitude", F.col("latitude") - 5)
    return quality.outside_region(moved, ws.linked(spark, folder)).select(
        "event_id", display_round(F.col("latitude"), 6).alias("latitude"), display_round(F.col("longitude"), 6).alias("longitude"),
        "start_time", "observation_count")


@query("purge_outside_region", sql("""SELECT (SELECT count(*) FROM summary WHERE NOT latitude BETWEEN 10 AND 25) AS deleted, (SELECT count(*) FROM summary WHERE latitude BETWEEN 10 AND 25) AS kept,
 (SELECT count(*) FROM linked JOIN summary s USING (event_id) WHERE NOT s.latitude BETWEEN 10 AND 25) AS unlinked""", "summary", "linked"))
def purge_outside_region(spark, folder):
    e, rows = ws.events(spark, folder), ws.linked(spark, folder)
    kept, after = quality.purge_outside(e, rows, F.col("latitude").between(10.0, 25.0))
    total = e.agg(F.count(F.lit(1)).alias("total"))
    counts = kept.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(total)).join(
        F.broadcast(after.agg(F.count_if(F.col("event_id").isNull()).alias("unlinked"))))
    return counts.select((F.col("total") - F.col("kept")).alias("deleted"), "kept", "unlinked")


@query("time_range_filter", sql("SELECT obs_id, timestamp FROM obs WHERE timestamp>=TIMESTAMP '2024-01-05 00:00:00' AND timestamp<TIMESTAMP '2024-01-12 00:00:00'", "obs"))
def time_range_filter(spark, folder):
    return history.time_range(fixtures.observations(spark, folder), "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("obs_id", "timestamp")


@query("recent_observations", sql("SELECT obs_id, timestamp FROM obs WHERE timestamp>=(SELECT max(timestamp) FROM obs)-INTERVAL 48 HOUR", "obs"))
def recent_observations(spark, folder):
    return history.recent(fixtures.observations(spark, folder), 48).select("obs_id", "timestamp")


@query("spacetime_point", sql("""SELECT obs_id, latitude, longitude, extract(hour FROM timestamp) AS hour, CAST(floor((epoch_us(timestamp)-epoch_us(TIMESTAMP '2024-01-01'))/86400000000.0::DOUBLE) AS BIGINT) AS day_index FROM obs""", "obs"))
def spacetime_point(spark, folder):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    day = F.floor((F.unix_micros("timestamp") - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("long")
    return fixtures.observations(spark, folder).select("obs_id", "latitude", "longitude", F.hour("timestamp").alias("hour"), day.alias("day_index"))


@query("bbox_and_centroid", sql(f"""SELECT source, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max,
 {half_up('avg(latitude)', 6)} AS centroid_lat, {half_up('avg(longitude)', 6)} AS centroid_lon FROM obs GROUP BY source""", "obs"))
def bbox_and_centroid(spark, folder):
    return fixtures.observations(spark, folder).groupBy("source").agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"),
        F.max("longitude").alias("lon_max"), display_round(F.avg("latitude"), 6).alias("centroid_lat"),
        display_round(F.avg("longitude"), 6).alias("centroid_lon"))


_JSON = """CASE WHEN obs_id%2=0 THEN '{"frp": "'||coalesce(CAST(CAST(frp AS DECIMAL(12,4)) AS VARCHAR(20)),'nan')||'", "daynight": "'||coalesce(daynight,'')||'"}'
 ELSE '{"metadata": {"frp": '||coalesce(CAST(CAST(frp AS DECIMAL(12,4)) AS VARCHAR(20)),'null')||', "daynight": "'||coalesce(daynight,'')||'"}}' END AS metadata"""


@query("metadata_json_get", sql("""SELECT obs_id, TRY_CAST(CASE WHEN f<>'nan' THEN f END AS DOUBLE) AS frp, d AS daynight FROM (SELECT obs_id,
 coalesce(json_extract_string(metadata,'$.frp'), json_extract_string(metadata,'$.metadata.frp')) AS f,
 coalesce(json_extract_string(metadata,'$.daynight'), json_extract_string(metadata,'$.metadata.daynight')) AS d FROM js)""", "js", js=(("obs",), f"SELECT obs_id, {_JSON} FROM obs")))
def metadata_json_get(spark, folder):
    """Metadata text in the flat and in the nested layout, a number or a text inside."""
    js = fixtures.observations(spark, folder).selectExpr("obs_id", _JSON.replace("VARCHAR(20)", "STRING"))
    m = F.col("metadata")
    return js.select("obs_id", metadata_number(m, "frp").alias("frp"), metadata_text(m, "daynight").alias("daynight"))


@query("daily_counts", sql("SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM obs GROUP BY 1", "obs"))
def daily_counts(spark, folder):
    return history.daily_counts(fixtures.observations(spark, folder))


@query("weekly_counts", sql("SELECT extract(week FROM timestamp) AS week, count(*) AS n FROM obs GROUP BY 1", "obs"))
def weekly_counts(spark, folder):
    return history.weekly_counts(fixtures.observations(spark, folder))


@query("monthly_counts", sql("SELECT extract(month FROM timestamp) AS month, count(*) AS n FROM obs GROUP BY 1", "obs"))
def monthly_counts(spark, folder):
    return history.monthly_counts(fixtures.observations(spark, folder))


def _dist(column: str, source: str) -> str:
    return (f"SELECT {half_up(f'avg({column})', 2)} AS mean, {half_up(f'quantile_cont({column}, 0.5)', 2)} AS median, {half_up(f'stddev_pop({column})', 2)} AS std, "
            f"{half_up(f'min({column})', 2)} AS min, {half_up(f'max({column})', 2)} AS max, {half_up(f'quantile_cont({column}, 0.25)', 2)} AS q25, {half_up(f'quantile_cont({column}, 0.75)', 2)} AS q75 FROM {source}")


@query("intensity_distribution", sql(_dist("intensity", "obs"), "obs"))
def intensity_distribution(spark, folder):
    return history.intensity_distribution(fixtures.observations(spark, folder))


@query("event_duration_distribution", pl("SELECT mean, median, std FROM (" + _dist("hours", "hours") + ")", "hours"))
def event_duration_distribution(spark, folder):
    return history.event_duration_distribution(ws.events(spark, folder))


@query("activity_peaks", sql("""SELECT (SELECT k FROM hn ORDER BY n DESC, k LIMIT 1) AS peak_hour, (SELECT k FROM dn ORDER BY n DESC, k LIMIT 1) AS peak_day,
 (SELECT string_agg(k||'='||n, ',' ORDER BY k) FROM hn) AS hourly, (SELECT string_agg(k||'='||n, ',' ORDER BY k) FROM dn) AS daily""", "hn", "dn",
    hn=(("obs",), "SELECT extract(hour FROM timestamp) AS k, count(*) AS n FROM obs GROUP BY 1"), dn=(("obs",), "SELECT dayname(timestamp) AS k, count(*) AS n FROM obs GROUP BY 1")))
def activity_peaks(spark, folder):
    one = history.activity_peaks(fixtures.observations(spark, folder))

    def shown(name):
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")

    return one.select("peak_hour", "peak_day", shown("hourly_distribution").alias("hourly"), shown("daily_distribution").alias("daily"))


@query("source_distribution", sql("SELECT source AS value, count(*) AS n FROM obs GROUP BY 1", "obs"))
def source_distribution(spark, folder):
    return history.value_histogram(fixtures.observations(spark, folder), "source")


@query("confidence_values", sql("SELECT confidence AS value, count(*) AS n FROM obs GROUP BY 1", "obs"))
def confidence_values(spark, folder):
    return history.value_histogram(fixtures.observations(spark, folder), "confidence")


@query("historical_statistics", pl(f"""SELECT count(*) AS observation_count, count(DISTINCT CAST(timestamp AS DATE)) AS unique_days, min(latitude) AS lat_min, max(longitude) AS lon_max,
 {half_up('avg(latitude)', 6)} AS centroid_lat, {half_up('count(*)/CAST(count(DISTINCT CAST(timestamp AS DATE)) AS DOUBLE)', 2)} AS detection_frequency,
 (SELECT count(*) FROM summary) AS event_count, CASE WHEN count(*)>=10 THEN 'SUFFICIENT_HISTORY' ELSE 'INSUFFICIENT_HISTORY' END AS status,
 (SELECT extract(hour FROM timestamp) AS k FROM linked GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
 {half_up('quantile_cont(intensity, 0.5)', 2)} AS intensity_median, (SELECT {half_up('quantile_cont(hours, 0.5)', 2)} FROM hours) AS duration_median,
 (SELECT string_agg(d||'='||n, ',' ORDER BY d) FROM (SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS d, count(*) AS n FROM linked GROUP BY 1)) AS daily_activity FROM linked""", "linked", "summary", "hours"))
def historical_statistics(spark, folder):
    one = history.historical_statistics(ws.linked(spark, folder), ws.events(spark, folder))
    daily = F.array_join(F.transform(F.array_sort(F.map_entries("daily_activity")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return one.select("observation_count", "unique_days", "lat_min", "lon_max", display_round(F.col("centroid_lat"), 6).alias("centroid_lat"),
                      "detection_frequency", "event_count", "status", "peak_hour", F.col("intensity_distribution.median").alias("intensity_median"),
                      F.col("duration_distribution.median").alias("duration_median"), daily.alias("daily_activity"))


@query("location_statistics", pl("SELECT * FROM stats", "stats"))
def location_statistics(spark, folder):
    stats = history.location_statistics(fixtures.query_points(spark, folder), ws.linked(spark, folder))
    return _sources(stats).drop("hourly_distribution", "daily_distribution")


@query("location_baseline", pl("SELECT * FROM baseline", "baseline"))
def location_baseline(spark, folder):
    return history.location_baseline(fixtures.query_points(spark, folder), ws.linked(spark, folder), ws.events(spark, folder))


def _verdict(now: str, low: str, high: str) -> str:
    return f"CASE WHEN {now} IS NULL OR {high} IS NULL THEN NULL WHEN {now}>{high} THEN 'elevated' WHEN {now}>={low} THEN 'normal' ELSE 'below_baseline' END"


@query("compare_to_baseline", pl(f"""SELECT *, CASE WHEN baseline_status<>'SUFFICIENT_HISTORY' THEN 'INSUFFICIENT_HISTORY' WHEN current_count IS NULL THEN 'NO_DATA'
 WHEN 'elevated' IN (coalesce(frequency_status,''), coalesce(intensity_status,''), coalesce(duration_status,'')) THEN 'ELEVATED_RELATIVE_TO_BASELINE'
 WHEN coalesce(frequency_status, intensity_status, duration_status) IS NOT NULL THEN 'NORMAL' ELSE 'INSUFFICIENT_DATA' END AS status FROM
 (SELECT point_id, status AS baseline_status, c AS current_count, {half_up('(c-ef)/ef*100.0::DOUBLE', 1)} AS frequency_pct, {_verdict('c', 'ef*0.5::DOUBLE', 'ef*1.5::DOUBLE')} AS frequency_status,
 {half_up('m-em', 2)} AS intensity_deviation_k, {half_up('(m-em)/em*100.0::DOUBLE', 1)} AS intensity_pct, {_verdict('m', 'em-10', 'em+10')} AS intensity_status,
 CASE WHEN ed>0 THEN {half_up('(h-ed)/ed*100.0::DOUBLE', 1)} END AS duration_pct, {_verdict('h', 'ed*0.5::DOUBLE', 'ed*1.5::DOUBLE')} AS duration_status
 FROM (SELECT b.*, n.*  EXCLUDE (point_id), expected_detection_frequency AS ef, expected_intensity_mean AS em, expected_duration AS ed FROM baseline b LEFT JOIN now n USING (point_id)))""", "baseline", "now"))
def compare_to_baseline(spark, folder):
    points, rows = fixtures.query_points(spark, folder), ws.linked(spark, folder)
    baseline = history.location_baseline(points, rows, ws.events(spark, folder))
    return history.compare_to_baseline(geojoin.radius_box_join(points, history.recent(rows, 24)), baseline)


@query("local_statistics", sql("""SELECT (SELECT count(*) FROM win) AS total_observations, count(*) AS total_events, count(*) FILTER (status<>'RESOLVED') AS active_locations,
 count(*) FILTER (status='PERSISTENT') AS persistent_sources FROM ev WHERE event_id IN (SELECT event_id FROM win)""", "ev", "win",
    win=(("linked",), "SELECT * FROM linked WHERE timestamp>=TIMESTAMP '2024-01-20'")))
def local_statistics(spark, folder):
    return history.local_statistics(history.time_range(ws.linked(spark, folder), "2024-01-20 00:00:00"), ws.events(spark, folder))


@query("local_daily_statistics", sql(f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, source, count(*) AS n, {half_up('avg(intensity)', 2)} AS average_intensity FROM obs GROUP BY 1,2", "obs"))
def local_daily_statistics(spark, folder):
    return history.daily_source_statistics(fixtures.observations(spark, folder))


@query("local_location_statistics", pl(f"""SELECT p.point_id, coalesce(n,0) AS observation_count, average_intensity, max_intensity, min_intensity, coalesce(d,0) AS active_days, sources FROM points p
 LEFT JOIN (SELECT point_id, count(*) AS n, {half_up('avg(intensity)', 2)} AS average_intensity, max(intensity) AS max_intensity, min(intensity) AS min_intensity, count(DISTINCT CAST(timestamp AS DATE)) AS d FROM circle GROUP BY 1) c USING (point_id)
 LEFT JOIN (SELECT point_id, string_agg(source||'='||n, ',' ORDER BY source) AS sources FROM (SELECT point_id, source, count(*) AS n FROM circle GROUP BY ALL) GROUP BY 1) s USING (point_id)""", "points", "circle"))
def local_location_statistics(spark, folder):
    return _sources(history.local_location_statistics(fixtures.query_points(spark, folder), fixtures.observations(spark, folder)))


@query("daily_full_outer", sql("""SELECT CAST(coalesce(a.day,b.day) AS VARCHAR) AS day, coalesce(o,0) AS observations, coalesce(e,0) AS events FROM
 (SELECT CAST(timestamp AS DATE) AS day, count(*) AS o FROM obs GROUP BY 1) a FULL JOIN (SELECT CAST(start_time AS DATE) AS day, count(*) AS e FROM summary GROUP BY 1) b USING (day)""", "obs", "summary"))
def daily_full_outer(spark, folder):
    return history.daily_full_outer(fixtures.observations(spark, folder), ws.events(spark, folder))


@query("union_days", sql("SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day FROM obs UNION SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) FROM summary", "obs", "summary"))
def union_days(spark, folder):
    return history.union_days(fixtures.observations(spark, folder), ws.events(spark, folder))


@query("feed_status", sql(f"""SELECT n AS observation_count, (SELECT count(*) FROM summary) AS event_count, t AS latest_observation, {half_up('age', 2)} AS age_hours,
 CASE WHEN age<=24 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM (SELECT count(*) AS n, max(timestamp) AS t, (epoch_us(TIMESTAMP '2024-02-01')-epoch_us(max(timestamp)))/3600000000.0::DOUBLE AS age FROM obs)""", "obs", "summary"))
def feed_status(spark, folder):
    return history.feed_status(fixtures.observations(spark, folder), ws.events(spark, folder), F.lit("2024-02-01 00:00:00").cast("timestamp"))

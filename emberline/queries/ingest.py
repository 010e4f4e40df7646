"""Queries over raw detections: parsing, validation, normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import fixtures
from emberline.functions import parsing
from emberline.functions.geo import in_box, parse_area
from emberline.operators import normalize, validate
from emberline.queries.oracle import half_up, key_round, sql
from emberline.queries.registry import query
from emberline.session import cut_lineage

NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches(trim({text}), {NUMBER}) THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def clock(text: str) -> str:
    padded = f"lpad({text},4,'0')"
    return (f"CASE WHEN {text}='' THEN '00:00:00' WHEN regexp_matches({text},'^\\d{{1,4}}$') THEN substr({padded},1,2)||':'||substr({padded},3,2)||':00' "
            f"WHEN regexp_matches({text},'^\\d{{6}}$') THEN substr({text},1,2)||':'||substr({text},3,2)||':'||substr({text},5,2) END")


def day(text: str) -> str:
    return (f"CASE WHEN regexp_matches({text},'^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {text} "
            f"WHEN regexp_matches({text},'^\\d{{8}}$') THEN substr({text},1,4)||'-'||substr({text},5,2)||'-'||substr({text},7,2) END")


MISSING = "('','-','na','n/a','null')"


def measured(text: str, low: str, high: str) -> tuple[str, str]:
    present = f"CASE WHEN lower(trim({text})) NOT IN {MISSING} THEN trim({text}) END"
    value = f"CASE WHEN ({number(text)}) BETWEEN {low} AND {high} THEN ({number(text)}) END"
    error = (f"CASE WHEN ({present}) IS NULL OR ({value}) IS NOT NULL THEN NULL WHEN ({number(text)}) IS NOT NULL "
             f"OR regexp_matches(lower(trim({text})),'^[+-]?(nan|inf|infinity)$') THEN 'OUT_OF_RANGE' ELSE 'MALFORMED' END")
    return value, error


def _checked_sql() -> str:
    columns = []
    for name, text, low, high in (("lat", "latitude", "-90", "90"), ("lon", "longitude", "-180", "180"),
                                  ("br", "bright_ti4", "200", "500"), ("fr", "frp", "0", "15000"),
                                  ("sc", "scan", "0", "20"), ("tr", "track", "0", "20"), ("co", "confidence", "0", "100")):
        value, error = measured(text, low, high)
        columns += [f"{value} AS {name}_v", f"{error} AS {name}_e"]
    moment = f"TRY_CAST(({day('trim(acq_date)')})||' '||({clock('trim(acq_time)')}) AS TIMESTAMP)"
    return f"SELECT *, {', '.join(columns)}, {moment} AS ts, lower(trim(confidence)) AS conf FROM raw"


EXTRA = {
    "parsed": (("raw",), _checked_sql()),
    "flags": (("parsed",), """SELECT *,
 (lat_e IS NOT NULL OR lon_e IS NOT NULL OR coalesce(lat_v=0 AND lon_v=0, false)) AS bad_coordinates,
 ts IS NULL AS bad_timestamp, br_e IS NOT NULL AS bad_brightness, fr_e IS NOT NULL AS bad_frp,
 (sc_e IS NOT NULL OR coalesce(sc_v<=0, false)) AS bad_scan, (tr_e IS NOT NULL OR coalesce(tr_v<=0, false)) AS bad_track,
 conf IN ('','-','unknown','na','n/a','null') AS missing_confidence,
 (conf NOT IN ('','-','unknown','na','n/a','null','h','n','l') AND co_e IS NOT NULL) AS bad_confidence FROM parsed"""),
    "reasoned": (("flags",), """SELECT *, NOT bad_coordinates AND (lat_v IS NULL OR lon_v IS NULL) AS missing_coordinates,
 CASE WHEN bad_coordinates THEN 'INVALID_COORDINATES' WHEN lat_v IS NULL OR lon_v IS NULL THEN 'MISSING_COORDINATES'
  WHEN bad_timestamp THEN 'INVALID_TIMESTAMP' WHEN bad_brightness THEN 'INVALID_BRIGHTNESS' WHEN bad_frp THEN 'INVALID_FRP'
  WHEN bad_scan THEN 'INVALID_SCAN' WHEN bad_track THEN 'INVALID_TRACK' WHEN bad_confidence THEN 'INVALID_CONFIDENCE' END AS reason0 FROM flags"""),
    "validated": (("reasoned",), f"""SELECT *, CASE WHEN reason0 IS NULL AND row_number() OVER
 (PARTITION BY reason0, {key_round('lat_v', 4)}, {key_round('lon_v', 4)}, ts, source ORDER BY line_no)>1 THEN 'DUPLICATE_OBSERVATION' ELSE reason0 END AS reason FROM reasoned"""),
}


def check(final: str, *needs: str) -> str:
    return sql(final, *needs, **EXTRA)


def _validated(spark, folder):
    return validate.validate_rows(fixtures.raw_detections(spark, folder))


@query("parse_acq_time", check("SELECT line_no, ts AS timestamp FROM parsed", "parsed"))
def parse_acq_time(spark, folder):
    return fixtures.raw_detections(spark, folder).select(
        "line_no", parsing.acquisition_time(F.col("acq_date"), F.col("acq_time")).alias("timestamp"))


@query("parse_confidence", check(f"""SELECT line_no,
 CASE conf WHEN 'h' THEN 100.0::DOUBLE WHEN 'n' THEN 50.0::DOUBLE WHEN 'l' THEN 0.0::DOUBLE ELSE co_v END AS score, co_v AS strict,
 CASE conf WHEN 'h' THEN 'high' WHEN 'n' THEN 'nominal' WHEN 'l' THEN 'low' END AS category FROM parsed""", "parsed"))
def parse_confidence(spark, folder):
    c = F.col("confidence")
    return fixtures.raw_detections(spark, folder).select(
        "line_no", parsing.confidence_score(c).alias("score"), parsing.confidence_percent(c).alias("strict"),
        parsing.confidence_category(c).alias("category"))


@query("coalesce_brightness", check("""SELECT line_no, coalesce(nullif(trim(bright_ti4),''), nullif(trim(b2),''), nullif(trim(frp),'')) AS brightness
 FROM (SELECT *, CASE WHEN line_no%4=0 THEN ' ' ELSE NULL END AS b2 FROM raw)""", "raw"))
def coalesce_brightness(spark, folder):
    raw = fixtures.raw_detections(spark, folder).withColumn(
        "b2", F.when(F.col("line_no") % 4 == 0, F.lit(" ")))
    return raw.select("line_no", parsing.first_present([F.col("bright_ti4"), F.col("b2"), F.col("frp")]).alias("brightness"))


@query("range_check_measurement", check("SELECT line_no, fr_v AS frp_value, fr_e AS frp_error, br_v AS brightness_value, br_e AS brightness_error, "
                                         "tr_v AS track_value, tr_e AS track_error FROM parsed", "parsed"))
def range_check_measurement(spark, folder):
    raw = fixtures.raw_detections(spark, folder).select(
        "line_no", parsing.measurement([F.col("frp")], 0.0, 15000.0).alias("f"),
        parsing.measurement([F.col("bright_ti4")], 200.0, 500.0).alias("b"),
        parsing.measurement([F.col("track")], 0.0, 20.0).alias("t"))
    return raw.select("line_no", F.col("f.value").alias("frp_value"), F.col("f.error").alias("frp_error"),
                      F.col("b.value").alias("brightness_value"), F.col("b.error").alias("brightness_error"),
                      F.col("t.value").alias("track_value"), F.col("t.error").alias("track_error"))


@query("normalize_rows", check(f"""SELECT line_no, ts AS timestamp, lat_v AS latitude, lon_v AS longitude, {number('bright_ti4')} AS intensity,
 co_v AS confidence, source FROM parsed WHERE ts IS NOT NULL AND lat_v IS NOT NULL AND lon_v IS NOT NULL""", "parsed"))
def normalize_rows(spark, folder):
    return normalize.normalize_rows(fixtures.raw_detections(spark, folder))


@query("normalize_flag_invalid", check(f"""SELECT line_no, ts AS timestamp, lat_v AS latitude, lon_v AS longitude,
 ((trim(latitude)<>'' AND lat_v IS NULL) OR (trim(longitude)<>'' AND lon_v IS NULL)) AS invalid_coordinates, {number('bright_ti4')} AS intensity,
 co_v AS confidence, source, satellite AS sensor, scan AS meta_scan, daynight AS meta_daynight,
 CASE conf WHEN 'h' THEN 'high' WHEN 'n' THEN 'nominal' WHEN 'l' THEN 'low' END AS meta_category FROM parsed""", "parsed"))
def normalize_flag_invalid(spark, folder):
    return normalize.normalize_flag_invalid(fixtures.raw_detections(spark, folder)).select(
        "line_no", "timestamp", "latitude", "longitude", "invalid_coordinates", "intensity", "confidence", "source", "sensor",
        F.col("metadata")["scan"].alias("meta_scan"), F.col("metadata")["daynight"].alias("meta_daynight"),
        F.col("metadata")["confidence_category"].alias("meta_category"))


@query("validate_rows", check("SELECT line_no, reason0 AS reason, lat_v AS latitude, lon_v AS longitude, ts AS timestamp, br_v AS brightness, "
                              "fr_v AS frp FROM reasoned", "reasoned"))
def validate_rows(spark, folder):
    return validate.check_rows(fixtures.raw_detections(spark, folder)).select(
        "line_no", "reason", F.col("p_lat_value").alias("latitude"), F.col("p_lon_value").alias("longitude"),
        F.col("p_time").alias("timestamp"), F.col("p_brightness_value").alias("brightness"), F.col("p_frp_value").alias("frp"))


@query("dedup_observations", check("SELECT line_no, lat_v AS latitude, lon_v AS longitude, ts AS timestamp, source FROM validated WHERE reason IS NULL",
                                   "validated"))
def dedup_observations(spark, folder):
    return validate.accepted_observations(_validated(spark, folder)).select("line_no", "latitude", "longitude", "timestamp", "source")


_MISSING = ("coordinates", "brightness", "frp", "scan", "track", "confidence")


@query("validation_report", check("""SELECT count(*) AS records_received, count(*) FILTER (reason IS NULL) AS records_accepted,
 count(*) FILTER (reason IS NOT NULL) AS records_rejected, count(*) FILTER (reason='DUPLICATE_OBSERVATION') AS duplicates_removed,
 count(*) FILTER (bad_timestamp) AS invalid_timestamps, count(*) FILTER (bad_coordinates) AS invalid_coordinates,
 count(*) FILTER (bad_brightness) AS invalid_brightness, count(*) FILTER (bad_frp) AS invalid_frp, count(*) FILTER (bad_scan) AS invalid_scan,
 count(*) FILTER (bad_track) AS invalid_track, count(*) FILTER (bad_confidence) AS invalid_confidence,
 count(*) FILTER (missing_coordinates) AS missing_coordinates, count(*) FILTER (br_v IS NULL AND br_e IS NULL) AS missing_brightness,
 count(*) FILTER (fr_v IS NULL AND fr_e IS NULL) AS missing_frp, count(*) FILTER (sc_v IS NULL AND sc_e IS NULL) AS missing_scan,
 count(*) FILTER (tr_v IS NULL AND tr_e IS NULL) AS missing_track, count(*) FILTER (missing_confidence) AS missing_confidence,
 min(ts) FILTER (reason IS NULL) AS earliest_observation, max(ts) FILTER (reason IS NULL) AS latest_observation,
 (SELECT string_agg(reason||'='||n, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM validated WHERE reason IS NOT NULL GROUP BY reason)) AS rejection_reasons
 FROM validated""", "validated"))
def validation_report(spark, folder):
    report = validate.validation_report(_validated(spark, folder))
    reasons = F.transform(F.array_sort(F.map_entries("rejection_reasons")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    missing = [F.coalesce(F.col("missing_values")[n], F.lit(0)).alias("missing_" + n) for n in _MISSING]
    return report.select(*(c for c in report.columns if c not in ("missing_values", "rejection_reasons")), *missing,
                         F.array_join(reasons, ",").alias("rejection_reasons"))


@query("quarantine_split", check("SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS side, coalesce(reason,'') AS reason, "
                                 "count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_sum FROM validated GROUP BY ALL", "validated"))
def quarantine_split(spark, folder):
    both = _validated(spark, folder)
    accepted = validate.accepted_observations(both).select(F.lit("accepted").alias("side"), F.lit("").alias("reason"), "line_no")
    rejected = validate.quarantined_rows(both).select(F.lit("rejected").alias("side"), "reason", "line_no")
    return accepted.unionAll(rejected).groupBy("side", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_sum"))


_WITH_COPIES = "SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE confidence>=90"


@query("count_duplicates", sql(f"""SELECT CAST(coalesce(sum(n-1),0) AS BIGINT) AS duplicates FROM
 (SELECT count(*) AS n FROM ({_WITH_COPIES}) GROUP BY {key_round('latitude', 4)}, {key_round('longitude', 4)}, timestamp)""", "obs"))
def count_duplicates(spark, folder):
    rows = fixtures.observations(spark, folder)
    return validate.count_duplicates(rows.unionAll(rows.filter("confidence >= 90")))


@query("count_invalid_coordinates", check(f"""SELECT count(*) FILTER (abs(a)>90) + count(*) FILTER (abs(o)>180) AS invalid_coordinates
 FROM (SELECT {number('latitude')}*4 AS a, {number('longitude')} AS o FROM raw)""", "raw"))
def count_invalid_coordinates(spark, folder):
    raw = fixtures.raw_detections(spark, folder)
    return validate.count_invalid_coordinates(raw.select(
        (parsing.finite_number(F.col("latitude")) * 4).alias("latitude"), parsing.finite_number(F.col("longitude")).alias("longitude")))


@query("area_spec_filter", sql("SELECT obs_id, latitude, longitude FROM obs WHERE longitude BETWEEN 69.0 AND 70.5 AND latitude BETWEEN 12.25 AND 24.5", "obs"))
def area_spec_filter(spark, folder):
    area = parse_area("69,12.25,70.5,24.5")
    rows = fixtures.observations(spark, folder)
    return rows.filter(in_box(F.col("latitude"), F.col("longitude"), area.south, area.north, area.west, area.east)).select(
        "obs_id", "latitude", "longitude")

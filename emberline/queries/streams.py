"""Queries that run the streaming jobs over the tables to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import fixtures
from emberline.functions.numeric import display_round
from emberline.queries import workspace as ws
from emberline.queries.ingest import EXTRA
from emberline.queries.oracle import half_up, sql
from emberline.queries.registry import query
from emberline.session import scratch_path
from emberline.streaming import jobs
from emberline.streaming.lifecycle import stream_lifecycle


def _arriving(spark, folder):
    """The events table as a file stream, as detections."""
    schema = fixtures.table(spark, folder, "events").schema
    return fixtures.derive_observations(spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet"))


_CELL = "CAST(floor(latitude/0.1::DOUBLE+0.5::DOUBLE) AS BIGINT) AS cell_lat, CAST(floor(longitude/0.1::DOUBLE+0.5::DOUBLE) AS BIGINT) AS cell_lon"
_MARK = "(SELECT max(timestamp) FROM obs)-INTERVAL 5 DAY"


@query("stream_ingest", sql("SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS side, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_sum FROM validated GROUP BY 1", "validated", **EXTRA))
def stream_ingest(spark, folder):
    names = "line_no LONG, latitude STRING, longitude STRING, acq_date STRING, acq_time STRING, bright_ti4 STRING, frp STRING, scan STRING, track STRING, confidence STRING, daynight STRING, source STRING, satellite STRING"
    landed = ws.folder_for(spark, folder, "landed", lambda path: fixtures.raw_detections(spark, folder).coalesce(1).write.option("header", True).csv(path))
    good, bad = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    jobs.run_writer(spark, jobs.stream_ingest(jobs.stream_detections_csv(spark, landed, names), good, bad), "ingest")
    accepted = spark.read.parquet(good).select(F.lit("accepted").alias("side"), "line_no")
    rejected = spark.read.parquet(bad).select(F.lit("rejected").alias("side"), "line_no")
    return accepted.unionAll(rejected).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_sum"))


@query("stream_dedup", sql("SELECT obs_id, timestamp, source FROM obs", "obs"))
def stream_dedup(spark, folder):
    """Every detection is delivered twice."""
    rows = _arriving(spark, folder)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.run_available(jobs.stream_dedup(twice), "dedup").select("obs_id", "timestamp", "source")


@query("stream_upsert", sql(f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS n, {half_up('sum(intensity+1)', 4)} AS total FROM obs GROUP BY 1", "obs"))
def stream_upsert(spark, folder):
    """Two runs into one table: all detections, then all again with a correction."""
    path = scratch_path(spark, "upserted")
    rows = _arriving(spark, folder)
    jobs.run_writer(spark, jobs.stream_upsert(rows, path), "upsert")
    corrected = rows.withColumn("intensity", F.col("intensity") + 1)
    again = corrected.writeStream.foreachBatch(jobs.upsert_sink(corrected.columns, path, first_version=100))
    jobs.run_writer(spark, again, "upsert-again")
    stored = jobs.current_table(spark, path, rows.columns)
    return stored.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("n"), display_round(F.sum("intensity"), 4).alias("total"))


@query("stream_location_sessions", sql(f"""SELECT cell_lat, cell_lon, min(timestamp) AS session_start, max(timestamp) AS last_detection, count(*) AS detections, max(intensity) AS max_intensity FROM
 (SELECT *, sum(fresh) OVER (PARTITION BY cell_lat, cell_lon ORDER BY timestamp, obs_id) AS session FROM (SELECT *, CASE WHEN epoch_us(timestamp)-lag(epoch_us(timestamp)) OVER (PARTITION BY cell_lat, cell_lon ORDER BY timestamp, obs_id)<=259200000000 THEN 0 ELSE 1 END AS fresh
  FROM (SELECT *, {_CELL} FROM obs))) GROUP BY cell_lat, cell_lon, session HAVING max(timestamp)+INTERVAL 72 HOUR<={_MARK}""", "obs"))
def stream_location_sessions(spark, folder):
    """Closed sessions: those the watermark has passed."""
    return jobs.run_available(jobs.stream_location_sessions(_arriving(spark, folder)), "sessions")


_LIMIT = 259200000
LIFECYCLE = {
    "gaps": (("obs",), f"""SELECT *, epoch_ms(timestamp) AS ms, CASE WHEN epoch_ms(timestamp)-lag(epoch_ms(timestamp)) OVER (PARTITION BY cell_lat, cell_lon ORDER BY timestamp, obs_id)>{_LIMIT} THEN 1 ELSE 0 END AS fresh FROM (SELECT *, {_CELL} FROM obs)"""),
    "episodes": (("gaps",), "SELECT *, sum(fresh) OVER (PARTITION BY cell_lat, cell_lon ORDER BY timestamp, obs_id) AS episode FROM gaps"),
    "steps": (("episodes",), """SELECT *, row_number() OVER (PARTITION BY cell_lat, cell_lon, episode ORDER BY timestamp, obs_id) AS n, dense_rank() OVER (PARTITION BY cell_lat, cell_lon, episode ORDER BY CAST(timestamp AS DATE)) AS d,
 max(episode) OVER (PARTITION BY cell_lat, cell_lon) AS newest FROM episodes"""),
}


@query("stream_lifecycle", sql(f"""SELECT cell_lat, cell_lon, 'ACTIVE' AS status, n AS detections, d AS active_days FROM steps WHERE n=1
 UNION ALL SELECT cell_lat, cell_lon, 'PERSISTENT', min(n), arg_min(d, n) FROM steps WHERE n>=3 AND d>=2 GROUP BY cell_lat, cell_lon, episode
 UNION ALL SELECT cell_lat, cell_lon, 'RESOLVED', max(n), max(d) FROM steps GROUP BY cell_lat, cell_lon, episode, newest HAVING episode<newest OR max(ms)+{_LIMIT}<=epoch_ms({_MARK})""", "obs", "steps", **LIFECYCLE))
def stream_lifecycle_query(spark, folder):
    """Three micro-batches in order of time."""
    def deal(path):
        events = fixtures.table(spark, folder, "events")
        stamp = F.unix_micros(F.col("ts").cast("timestamp"))
        low, high = events.agg(F.min(stamp), F.max(stamp)).first()
        for k in range(3):  # written one after the other, so that they arrive in this order
            part = F.least(F.floor((stamp - low) * 3 / F.lit(high - low + 1)), F.lit(2))
            events.filter(part == k).coalesce(1).write.mode("append").parquet(path)

    dealt = ws.folder_for(spark, folder, "events-in-three", deal)
    schema = fixtures.table(spark, folder, "events").schema
    rows = fixtures.derive_observations(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(dealt))
    return jobs.run_available(stream_lifecycle(rows), "lifecycle").select(
        "cell_lat", "cell_lon", "status", "detections", "active_days")


@query("stream_daily_counts", sql(f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, source, count(*) AS n, {half_up('avg(intensity)', 4)} AS average_intensity FROM obs GROUP BY 1,2", "obs"))
def stream_daily_counts(spark, folder):
    """Update mode: the newest state of every day, open days included."""
    out = jobs.run_available(jobs.stream_daily_counts(_arriving(spark, folder)), "daily", "update")
    newest = out.groupBy("day", "source").agg(F.max_by(F.struct("n", "average_intensity"), "batch_id").alias("s"))
    return newest.select("day", "source", "s.n", display_round(F.col("s.average_intensity"), 4).alias("average_intensity"))


@query("stream_recent_rate", sql(f"""SELECT window_end, w.cell_lat, w.cell_lon, n, {half_up('expected', 6)} AS expected_per_day, n>expected*1.5::DOUBLE AS elevated FROM
 (SELECT date_trunc('hour', timestamp)+INTERVAL 1 HOUR*(1+k) AS window_end, cell_lat, cell_lon, count(*) AS n FROM placed, range(24) r(k) GROUP BY 1,2,3) w
 JOIN (SELECT cell_lat, cell_lon, avg(n) AS expected FROM (SELECT cell_lat, cell_lon, CAST(timestamp AS DATE), count(*) AS n FROM placed GROUP BY 1,2,3) GROUP BY 1,2) b USING (cell_lat, cell_lon)
 WHERE window_end<={_MARK}""", "obs", "placed", placed=(("obs",), f"SELECT *, {_CELL} FROM obs")))
def stream_recent_rate(spark, folder):
    baseline = ws.stored(spark, folder, "cell_rate", lambda: jobs.cell_daily_rate(fixtures.observations(spark, folder)))
    out = jobs.run_available(jobs.stream_recent_rate(_arriving(spark, folder), baseline), "rate")
    return out.withColumn("expected_per_day", display_round(F.col("expected_per_day"), 6))

"""Detection-shaped views derived from the driver tables.

No driver table holds detections, so they are derived row by row. The SQL text
is the same for Spark and for the checking engine; ``{events}`` and the like
stand for the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import prepare_session

OBSERVATIONS = """
SELECT event_id AS obs_id, ts AS timestamp, loc,
 CAST(7 AS DOUBLE)+CAST(loc%270 AS DOUBLE)/CAST(10 AS DOUBLE)+CAST(event_id%5-2 AS DOUBLE)*CAST(0.003 AS DOUBLE) AS latitude,
 CAST(69 AS DOUBLE)+(CAST(loc-loc%270 AS DOUBLE)/CAST(270 AS DOUBLE))/CAST(10 AS DOUBLE)+CAST(event_id%7-3 AS DOUBLE)*CAST(0.002 AS DOUBLE) AS longitude,
 CASE WHEN event_id%17=0 THEN NULL ELSE CAST(295 AS DOUBLE)+value*CAST(0.5 AS DOUBLE) END AS intensity,
 CASE WHEN event_id%5=4 THEN NULL ELSE CAST(event_id%101 AS DOUBLE) END AS confidence,
 CASE WHEN event_id%5<>4 THEN NULL WHEN event_id%3=0 THEN 'high' WHEN event_id%3=1 THEN 'nominal' ELSE 'low' END AS confidence_category,
 CASE WHEN user_id%2=0 THEN 'VIIRS_NOAA20_NRT' ELSE 'MODIS_NRT' END AS source,
 CASE WHEN user_id%2=0 THEN 'VIIRS' ELSE 'MODIS' END AS sensor,
 CASE WHEN event_id%13=0 THEN NULL ELSE value/CAST(5 AS DOUBLE) END AS frp,
 CAST(0.4 AS DOUBLE)+CAST(event_id%5 AS DOUBLE)*CAST(0.1 AS DOUBLE) AS scan,
 CASE WHEN event_id%37=0 THEN NULL ELSE CAST(0.3 AS DOUBLE)+CAST(event_id%4 AS DOUBLE)*CAST(0.1 AS DOUBLE) END AS track,
 CASE WHEN user_id%2=0 AND event_id%11<>0 THEN CAST(280 AS DOUBLE)+CAST(event_id%23 AS DOUBLE) ELSE NULL END AS bright_ti5,
 CASE WHEN user_id%2=1 AND event_id%11<>0 THEN CAST(290 AS DOUBLE)+CAST(event_id%19 AS DOUBLE) ELSE NULL END AS bright_t31,
 CASE WHEN event_id%29=0 THEN NULL WHEN extract(hour from ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight
FROM (SELECT *, user_id*8+CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS loc FROM {events})
"""

RAW_DETECTIONS = """
SELECT d.line_no,
 CASE WHEN d.obs_id%97=0 THEN 'NaN' WHEN d.obs_id%67=0 THEN '0' WHEN d.obs_id%103=0 THEN '' ELSE CAST(d.latitude AS STRING) END AS latitude,
 CASE WHEN d.obs_id%67=0 THEN '0' WHEN d.obs_id%101=0 THEN '200.5' ELSE CAST(d.longitude AS STRING) END AS longitude,
 CASE WHEN d.obs_id%109=0 THEN '2024/01/01' ELSE substr(CAST(d.timestamp AS STRING),1,10) END AS acq_date,
 CASE WHEN d.obs_id%89=0 THEN '9999' ELSE CAST(extract(hour from d.timestamp)*100+extract(minute from d.timestamp) AS STRING) END AS acq_time,
 CASE WHEN d.obs_id%71=0 THEN '600' WHEN d.obs_id%127=0 THEN '1d' ELSE coalesce(CAST(d.intensity AS STRING),'') END AS bright_ti4,
 CASE WHEN d.obs_id%83=0 THEN '-1' ELSE coalesce(CAST(CAST(d.frp AS DECIMAL(12,4)) AS STRING),'n/a') END AS frp,
 CASE WHEN d.obs_id%79=0 THEN '-1' WHEN d.obs_id%37=0 THEN '' ELSE '0.5' END AS scan,
 CASE WHEN d.obs_id%107=0 THEN 'inf' ELSE '0.4' END AS track,
 CASE WHEN d.obs_id%73=0 THEN 'unverified' WHEN d.obs_id%5=0 THEN 'h' WHEN d.obs_id%5=1 THEN 'n' WHEN d.obs_id%5=2 THEN 'l' WHEN d.obs_id%5=3 THEN CAST(d.obs_id%101 AS STRING) ELSE '-' END AS confidence,
 d.daynight, d.source, d.sensor AS satellite
FROM (SELECT o.*, obs_id*2 AS line_no FROM ({observations}) o UNION ALL SELECT o.*, obs_id*2+1 AS line_no FROM ({observations}) o WHERE obs_id%61=0) d
"""

FACILITIES = """
SELECT s_suppkey AS facility_id, s_name AS name,
 CASE s_nationkey%5 WHEN 0 THEN 'power_plant' WHEN 1 THEN 'factory' WHEN 2 THEN 'refinery' WHEN 3 THEN 'landmark' ELSE 'other' END AS type,
 CAST(7 AS DOUBLE)+CAST((s_suppkey*7)%270 AS DOUBLE)/CAST(10 AS DOUBLE)+CAST(0.02 AS DOUBLE) AS latitude,
 CAST(69.01 AS DOUBLE)+CAST(s_suppkey%5 AS DOUBLE)/CAST(10 AS DOUBLE) AS longitude FROM {supplier}
"""

QUERY_POINTS = """
SELECT n_nationkey AS point_id, n_name AS name, CAST(7 AS DOUBLE)+CAST(n_nationkey AS DOUBLE) AS latitude,
 CAST(69 AS DOUBLE)+CAST(n_regionkey AS DOUBLE)/CAST(10 AS DOUBLE) AS longitude FROM {nation}
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derive_observations(events: DataFrame) -> DataFrame:
    """The observation view over any events-shaped frame, batch or stream."""
    spark = events.sparkSession
    view = spark.sql(OBSERVATIONS, events=events)
    return view.drop("loc").withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return derive_observations(table(spark, folder, "events"))


def raw_detections(spark: SparkSession, folder: str) -> DataFrame:
    text = RAW_DETECTIONS.replace("{observations}", OBSERVATIONS)
    return spark.sql(text, events=table(spark, folder, "events"))


def facilities(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(FACILITIES, supplier=table(spark, folder, "supplier"))


def query_points(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(QUERY_POINTS, nation=table(spark, folder, "nation"))

"""Structured Streaming jobs over arriving detections.

Every job takes a streaming frame and gives a streaming frame or a ready writer,
so the caller chooses trigger and rate (``maxFilesPerTrigger`` and the like bound
what one micro-batch holds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions.geo import floor_long
from emberline.operators.merge import OBSERVATION_KEY, upsert_observations
from emberline.operators.validate import accepted_observations, duplicate_key, quarantined_rows, validate_rows
from emberline.session import broadcast_if_small, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "5 days"
SESSION_GAP = "72 hours"
CELL_DEGREES = 0.1
BLOCK_CELLS = 10

def with_cell(rows: DataFrame, side: float = CELL_DEGREES) -> DataFrame:
    """Cells centred on multiples of the side."""
    return (rows.withColumn("cell_lat", floor_long(F.col("latitude") / F.lit(side) + F.lit(0.5)))
            .withColumn("cell_lon", floor_long(F.col("longitude") / F.lit(side) + F.lit(0.5))))

def with_block(cells: DataFrame) -> DataFrame:
    """Blocks of BLOCK_CELLS by BLOCK_CELLS cells, which share a row of state."""
    return cells.withColumns({f"block_{axis}": floor_long(F.col(f"cell_{axis}") / F.lit(BLOCK_CELLS)) for axis in ("lat", "lon")})

def stream_detections_csv(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("header", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)

def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: a repeated batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def known_rejected(checked: DataFrame, accepted_path: str, batch_id: int) -> DataFrame:
    """Valid rows that an earlier batch accepted become duplicates; a repeated batch does not meet its own output.

    Only the accepted rows of the batch's span of time are read.
    """
    try:
        stored = checked.sparkSession.read.parquet(accepted_path)
    except AnalysisException:  # nothing accepted yet
        return checked
    low, high = checked.filter("reason IS NULL").agg(F.min("p_time"), F.max("p_time")).first()
    if low is None:
        return checked
    key = duplicate_key("latitude", "longitude", "timestamp")
    earlier = (stored.filter((F.col("batch_id") < batch_id) & F.col("timestamp").between(F.lit(low) - F.expr("INTERVAL 1 HOUR"), F.lit(high) + F.expr("INTERVAL 1 HOUR")))
               .select(*key, "source").distinct().withColumn("_known", F.lit(True)))
    keyed = checked.select("*", *duplicate_key("p_lat_value", "p_lon_value", "p_time"))
    joined = keyed.join(earlier, ["key_lat", "key_lon", "key_time", "source"], "left")
    again = F.col("reason").isNull() & F.col("_known")
    return joined.withColumn("reason", F.when(again, "DUPLICATE_OBSERVATION").otherwise(F.col("reason"))).select(*checked.columns)


def stream_ingest(raw: DataFrame, accepted_path: str, rejected_path: str, order: str = "line_no") -> DataStreamWriter:
    """Validate each micro-batch; accepted rows and quarantine go to their own tables.

    A detection that an earlier batch accepted is a duplicate, so the result does not
    depend on how the rows were dealt to batches.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        numbered = batch if order in batch.columns else batch.withColumn(order, F.monotonically_increasing_id())
        checked = known_rejected(validate_rows(numbered, order), accepted_path, batch_id).persist()
        try:
            _write_batch(accepted_observations(checked), accepted_path, batch_id)
            _write_batch(quarantined_rows(checked), rejected_path, batch_id)
        finally:
            checked.unpersist()

    return raw.writeStream.foreachBatch(sink)


def stream_dedup(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Re-delivered detections are dropped while the look-back window is open."""
    keyed = rows.select("*", *duplicate_key("latitude", "longitude", "timestamp"))
    return (keyed.withWatermark("timestamp", lateness)
            .dropDuplicatesWithinWatermark(["key_lat", "key_lon", "key_time", "source"]).drop("key_lat", "key_lon", "key_time"))


def current_table(spark: SparkSession, path: str, columns: list[str], dates: DataFrame | None = None,
                  before: int | None = None) -> DataFrame | None:
    """Newest version of every day of a versioned table, or of the given days only."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # the first batch finds no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None
    if before is not None:
        stored = stored.filter(F.col("version") < before)
    if dates is not None:
        stored = stored.join(F.broadcast(dates), "date", "left_semi")
    newest = stored.groupBy("date").agg(F.max("version").alias("version"))
    return stored.join(F.broadcast(newest), ["date", "version"], "left_semi").select(*columns)


def upsert_sink(columns: list[str], path: str, first_version: int = 1):
    """Batch function: keyed upsert into a table of day partitions.

    Only the days a batch touches are read and written anew, as version =
    first_version + batch_id; readers take the newest version of a day. A
    repeated batch writes the same folders again.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = first_version + batch_id
        dated = batch.withColumn("date", F.to_date("timestamp"))
        # Days of one batch: a handful, at most the look-back window and backfills.
        days = dated.select("date").distinct()
        known = current_table(spark, path, columns, days, before=version)
        if known is None:
            known = spark.createDataFrame([], batch.schema)
        fresh = batch.withColumn("line_no", F.monotonically_increasing_id())
        merged = upsert_observations(known, fresh, OBSERVATION_KEY, order="line_no").drop("outcome")
        (merged.select(*columns).withColumn("date", F.to_date("timestamp")).withColumn("version", F.lit(version).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "version").parquet(path))

    return sink


def stream_upsert(rows: DataFrame, path: str) -> DataStreamWriter:
    return rows.writeStream.foreachBatch(upsert_sink(rows.columns, path))


def stream_location_sessions(rows: DataFrame, gap: str = SESSION_GAP, lateness: str = LATENESS, side: float = CELL_DEGREES) -> DataFrame:
    """Activity sessions per location cell: silence longer than the gap ends a session."""
    cells = with_cell(rows, side).withWatermark("timestamp", lateness)
    return (cells.groupBy(F.session_window("timestamp", gap).alias("session"), "cell_lat", "cell_lon")
            .agg(F.count(F.lit(1)).alias("detections"), F.max("intensity").alias("max_intensity"), F.max("timestamp").alias("last_detection"))
            .select("cell_lat", "cell_lon", F.col("session.start").alias("session_start"), "last_detection", "detections", "max_intensity"))


def stream_daily_counts(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return (rows.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", "1 day").alias("w"), "source")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("average_intensity"))
            .select(F.to_date("w.start").alias("day"), "source", "n", "average_intensity"))


def sliding_counts(hours: int = 24):
    """The state function of one block of cells: the hourly counts that windows still to come need.

    A window ends on a whole hour and holds the ``hours`` before. Once the watermark has reached
    its end it is emitted, with the cell's other finished windows, as one row of two lists.
    """
    names = ["cell_lat", "cell_lon", "hour"]

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() // 3_600_000
        # windows that ended before a block's first row came are closed to it
        *known, done = state.get if state.exists else ([], [], [], [], now)
        counts = pd.DataFrame(dict(zip([*names, "n"], known, strict=True)), dtype="int64")
        if not state.hasTimedOut:
            fresh = pd.concat(list(parts))
            fresh = fresh[["cell_lat", "cell_lon"]].assign(hour=fresh["timestamp"].to_numpy().astype("datetime64[h]").astype("int64"), n=1)
            counts = pd.concat([counts, fresh]).groupby(names, as_index=False)["n"].sum()
        left = counts[counts["hour"] + hours > now]
        if len(left):
            state.update((*(left[c].tolist() for c in (*names, "n")), now))
            # a timeout comes when the watermark is past this stamp
            state.setTimeoutTimestamp((max(int(left["hour"].min()), now) + 1) * 3_600_000 - 1)
        elif state.exists:
            state.remove()
        spread = counts.loc[counts.index.repeat(hours)].assign(end=(counts["hour"].to_numpy()[:, None] + np.arange(1, hours + 1)).ravel())
        spread = spread[(spread["end"] > done) & (spread["end"] <= now)]
        if len(spread):
            totals = spread.groupby(["cell_lat", "cell_lon", "end"], as_index=False)["n"].sum()
            yield totals.groupby(["cell_lat", "cell_lon"], as_index=False).agg(ends=("end", list), counts=("n", list))

    return step


def stream_recent_rate(rows: DataFrame, baseline: DataFrame, lateness: str = LATENESS, side: float = CELL_DEGREES) -> DataFrame:
    """Detections per cell in sliding 24-hour windows against a static daily rate.

    ``baseline``: cell_lat, cell_lon, expected_per_day. The state is one row per block of cells with
    their hourly counts instead of one per cell and window. A detection is late when the last window
    it belongs to has ended, so the watermark is that of the detection's time.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cells = with_cell(rows, side).select("cell_lat", "cell_lon", F.col("timestamp"), (F.col("timestamp") + F.expr("INTERVAL 24 HOURS")).alias("until"))
    counts = with_block(cells.withWatermark("until", f"{lateness} 24 hours")).groupBy("block_lat", "block_lon").applyInPandasWithState(
        sliding_counts(24), "cell_lat LONG, cell_lon LONG, ends ARRAY<LONG>, counts ARRAY<LONG>",
        "cell_lat ARRAY<LONG>, cell_lon ARRAY<LONG>, hours ARRAY<LONG>, counts ARRAY<LONG>, done LONG", "append", GroupStateTimeout.EventTimeTimeout)
    windows = counts.join(broadcast_if_small(baseline), ["cell_lat", "cell_lon"]).select(
        "cell_lat", "cell_lon", "expected_per_day", F.inline(F.arrays_zip("ends", "counts")).alias("end", "n"))
    elevated = F.col("n") > F.col("expected_per_day") * F.lit(1.5)
    return windows.select(F.timestamp_seconds(F.col("end") * 3600).alias("window_end"), "cell_lat", "cell_lon", "n", "expected_per_day", elevated.alias("elevated"))


def cell_daily_rate(rows: DataFrame, side: float = CELL_DEGREES) -> DataFrame:
    """Mean detections per active day of each cell, the static side of the rate job."""
    per_day = with_cell(rows, side).groupBy("cell_lat", "cell_lon", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("cell_lat", "cell_lon").agg(F.avg("n").alias("expected_per_day"))


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process what is there, then read the written table back.

    Update mode keeps the newest row per batch under ``batch_id``.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, name + "-progress")).trigger(availableNow=True)
    if output_mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(output_mode).foreachBatch(lambda df, batch_id: _write_batch(df, path, batch_id)).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def run_writer(spark: SparkSession, writer: DataStreamWriter, name: str) -> None:
    query = writer.option("checkpointLocation", scratch_path(spark, name + "-progress")).trigger(availableNow=True).start()
    query.awaitTermination()



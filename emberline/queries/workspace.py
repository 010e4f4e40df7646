"""Tables that many queries read: written once per session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import fixtures
from emberline.operators.cluster import Linker, summarize_events
from emberline.operators.events import event_table, persistence_metrics
from emberline.operators.scoring import assess_risk
from emberline.session import materialize, prepare_session, scratch_path

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _TABLES:
        prepare_session(spark)
        _TABLES[key] = materialize(build(), name)
    return _TABLES[key]


def linked(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with their event_id."""
    def build() -> DataFrame:
        rows = fixtures.observations(spark, folder)
        return Linker(rows).attach(rows)

    return stored(spark, folder, "linked", build)


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "metrics", lambda: persistence_metrics(linked(spark, folder)))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Event summaries with score and lifecycle status."""
    return stored(spark, folder, "events", lambda: event_table(
        metrics(spark, folder), summarize_events(linked(spark, folder))).select(
        "event_id", "latitude", "longitude", "start_time", "end_time", "observation_count", "active_days",
        "persistence_score", "trend", "average_intensity", "status"))


def risk(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "risk", lambda: assess_risk(metrics(spark, folder)))


def as_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the newest timestamp of the data."""
    return linked(spark, folder).agg(F.max("timestamp").alias("as_of"))


_RESULTS: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """Anything built once per session and data folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _RESULTS:
        prepare_session(spark)
        _RESULTS[key] = build()
    return _RESULTS[key]


_FOLDERS: dict[tuple[str, str, str], str] = {}


def folder_for(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> str:
    """A folder in the shared space, written once per session and data folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _FOLDERS:
        path = scratch_path(spark, name)
        write(path)
        _FOLDERS[key] = path
    return _FOLDERS[key]

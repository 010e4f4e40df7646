"""The whole ingestion run: raw rows to stored detections, events and risk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.geo import in_region
from emberline.operators import listing, merge, scoring, validate
from emberline.operators.cluster import Linker, summarize_events
from emberline.operators.events import event_table, lifecycle_status, persistence_metrics, persistent_sources, stable_event_ids, with_as_of
from emberline.operators.history import recent
from emberline.operators.incremental import Added, EventStore
from emberline.operators.merge import OBSERVATION_KEY
from emberline.session import broadcast_if_small, discard, materialize


@dataclass
class IngestionRun:
    validated: DataFrame
    stored: DataFrame
    linked: DataFrame
    events: DataFrame
    risk: DataFrame
    summary: DataFrame


def stable_observation_id() -> Column:
    """The same 64-bit id for a detection in every run, from its identity; runs number their lines anew."""
    return F.xxhash64(*OBSERVATION_KEY)


def require_unique_ids(rows: DataFrame) -> DataFrame:
    """Refuse a table in which two detections share an id."""
    if not rows.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("two detections share an obs_id")
    return rows


def _inside(accepted: DataFrame, region: Callable[[Column, Column], Column] | None) -> DataFrame:
    return accepted if region is None else accepted.filter(region(F.col("latitude"), F.col("longitude")))


def run_ingestion(raw: DataFrame, stored: DataFrame | None = None, stored_events: DataFrame | None = None,
                  window_hours: float | None = 48, order: str = "line_no", stored_risk: DataFrame | None = None,
                  region: Callable[[Column, Column], Column] | None = in_region) -> IngestionRun:
    """Validate, keep the region (all accepted rows without one), upsert, cluster the recent window, match, relink, recount, assess.

    ``window_hours`` None clusters everything stored. A cluster that matches a stored event
    takes its id; its rows are linked to that id in the stored table, counts come from the
    links, and the touched events' risk replaces the stored one. Stored events that no row
    of the window belongs to any more stay with their other rows, or go if they have none.
    """
    validated = materialize(validate.validate_rows(raw, order), "validated")
    accepted = validate.accepted_observations(validated).drop("metadata")
    inside = _inside(accepted, region).withColumn("obs_id", stable_observation_id())
    if stored is None:
        # a key comes once: later rows with it were rejected as duplicates
        merged = merge.latest_per_key(inside, merge.OBSERVATION_KEY, order).withColumn("outcome", F.lit("inserted"))
    else:
        merged = merge.upsert_observations(stored, inside, order=order)
    merged = require_unique_ids(materialize(merged.drop(order), "stored_observations"))
    rows = merged if window_hours is None else recent(merged, window_hours)
    clustered = materialize(Linker(rows).attach(rows), "clustered_observations")
    clusters = summarize_events(clustered)
    if stored_events is None:
        matched = clusters.select("event_id", F.lit(None).cast("long").alias("stored_id"), F.lit("created").alias("outcome"))
    else:
        matched = merge.match_existing_events(clusters, stored_events).select("event_id", "stored_id", "outcome")
        # one stored event is taken by one cluster, that with the smallest id
        first = F.min("event_id").over(Window.partitionBy("stored_id"))
        taken = F.col("stored_id").isNotNull() & (F.col("event_id") == F.col("first"))
        matched = matched.withColumn("first", first).select("event_id", F.when(taken, F.col("stored_id")).alias("stored_id"),
                                                            F.when(taken, "updated").otherwise("created").alias("outcome"))
    matched = materialize(matched, "matched_events")
    linked = materialize(clustered.join(broadcast_if_small(matched.select("event_id", "stored_id")), "event_id")
                         .withColumn("event_id", F.coalesce("stored_id", "event_id")).drop("stored_id"), "linked_observations")
    metrics = materialize(persistence_metrics(linked), "event_metrics")
    events = materialize(event_table(metrics, summarize_events(linked)), "event_table")
    risk = scoring.assess_risk(metrics)
    if stored_events is not None:
        fresh = linked.select("obs_id", F.col("event_id").alias("fresh_id"))
        before = F.col("event_id") if "event_id" in merged.columns else F.lit(None).cast("long")
        merged = materialize(merged.withColumn("event_id", before).join(fresh, "obs_id", "left")
                             .withColumn("event_id", F.coalesce("fresh_id", "event_id")).drop("fresh_id"), "relinked_observations")
        events = merge.recount_events(merge.replace_rows(stored_events, events), merged).filter("observation_count > 0")
        if stored_risk is not None:
            risk = merge.replace_rows(stored_risk, risk)
    else:
        merged = merged.join(linked.select("obs_id", "event_id"), "obs_id", "left")
    lasting = persistent_sources(summarize_events(linked).select("event_id", "observation_count"), config.PERSISTENCE_MIN_DETECTIONS)
    report = validate.validation_report(validated)
    parts = [
        merge.upsert_counts(merged),
        matched.agg(F.count_if(F.col("outcome") == "created").alias("events_created"), F.count_if(F.col("outcome") == "updated").alias("events_updated")),
        lasting.agg(F.count(F.lit(1)).alias("persistent_sources"))]
    one = report
    for part in parts:
        one = one.join(F.broadcast(part))  # one row each
    summary = one.select(
        F.when(F.col("records_accepted") > 0, "success").otherwise("failed").alias("status"),
        F.col("records_received").alias("observations_fetched"), F.col("inserted").alias("observations_stored"),
        F.col("updated").alias("observations_updated"), F.col("records_rejected").alias("observations_failed"),
        "events_created", "events_updated", "persistent_sources", F.col("invalid_coordinates").alias("observations_invalid_coordinates"),
        F.coalesce(F.col("rejection_reasons")["MISSING_COORDINATES"], F.lit(0)).alias("observations_missing_critical_fields"),
        F.col("duplicates_removed").alias("observations_duplicate"))
    return IngestionRun(validated, merged, linked, events, risk, summary)


def ingest_batch(store: EventStore, raw: DataFrame, order: str = "line_no",
                 region: Callable[[Column, Column], Column] | None = in_region) -> Added:
    """Validate, keep the region (all accepted rows without one), link with what is stored, and renew the events that changed.

    The batch meets only the stored partitions within its reach. Every event that won or
    lost a row or a value is computed anew from all its rows, so none keeps an old end,
    size or risk; an event that lasts longer than any batch keeps its id. Rows of one time
    come by ``order``, as in a run over the whole feed: ids are hashes and say nothing of it.
    """
    validated = materialize(validate.validate_rows(raw, order), "validated")
    accepted = validate.accepted_observations(validated).drop("metadata")
    inside = _inside(accepted, region).withColumn("obs_id", stable_observation_id())
    # a key comes once: later rows with it were rejected as duplicates
    batch = require_unique_ids(materialize(inside, "ingested_batch"))
    run = store.link(batch)
    ahead = store.seen_with(run)
    touched = materialize(ahead.touched(run), "touched_events")
    linked = materialize(ahead.members(touched), "touched_rows")
    metrics = materialize(persistence_metrics(linked, order=[c for c in ("timestamp", order, "obs_id") if c in linked.columns]), "touched_metrics")
    # whether an event has ended depends on the newest row of all; see stored_events
    store.put(run, "events", event_table(metrics, summarize_events(linked)).drop("status"))
    store.put(run, "risk", scoring.assess_risk(metrics))
    store.publish(run)
    discard(validated, batch, touched, linked, metrics)
    return run


def stored_events(store: EventStore) -> DataFrame:
    """All stored events with their status as of the newest stored row."""
    events = with_as_of(store.newest("events"), "end_time")
    return events.withColumn("status", lifecycle_status(F.col("end_time"), F.col("as_of"), F.col("active_days"), F.col("observation_count"))).drop("as_of")


def replay_capture(raw: DataFrame, order: str = "line_no") -> DataFrame:
    """A capture as ranked events: validate, cluster, stable ids, status, place, risk."""
    validated = materialize(validate.validate_rows(raw, order), "capture_validated")
    rows = validate.accepted_observations(validated).drop("metadata").withColumnRenamed("line_no", "obs_id")
    linked = materialize(Linker(rows).attach(rows), "capture_linked")
    metrics = persistence_metrics(linked)
    scored = scoring.assess_risk(metrics)
    events = event_table(scored.drop("factors", "probabilities", "reasoning"), summarize_events(linked))
    named = listing.name_places(events).join(stable_event_ids(linked), "event_id")
    return listing.rank_events(named)

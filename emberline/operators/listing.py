"""Ranked, filtered and paged views over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.ranking import RANGES_ALWAYS, rank_within
from emberline import config
from emberline.functions.geo import in_region
from emberline.functions.labels import class_label
from emberline.functions.places import location_name, nearest_hub
from emberline.operators.scoring import severity_bucket
from emberline.session import broadcast_if_small


def events_by_status(events: DataFrame, status: str) -> DataFrame:
    if status.upper() not in config.EVENT_STATUSES:
        raise ValueError(f"status must be one of {config.EVENT_STATUSES}")
    return events.filter(F.col("status") == F.lit(status.upper()))


def region_filter(rows: DataFrame) -> DataFrame:
    return rows.filter(in_region(F.col("latitude"), F.col("longitude")))


def name_places(events: DataFrame) -> DataFrame:
    named = events.withColumn("hub", nearest_hub(F.col("latitude"), F.col("longitude")))
    return named.withColumn("location_name", location_name(F.col("latitude"), F.col("longitude"), F.col("hub"))).drop("hub")


def rank_events(scored: DataFrame) -> DataFrame:
    """Highest risk first, then the latest; the id settles the rest."""
    return scored.orderBy(F.col("risk_score").desc(), F.col("end_time").desc(), F.col("event_id"))


def ranked_events(scored: DataFrame) -> DataFrame:
    """Every event with its exact position in that ranking, numbered by ranges rather than in one task."""
    keyed = scored.select("*", F.lit(1).alias("_all"), (-F.col("risk_score")).alias("_risk"), (-F.unix_micros("end_time")).alias("_end"))
    ranked = rank_within(keyed, ["_all"], ["_risk", "_end", "event_id"], rank="position", size="_size", largest=RANGES_ALWAYS)
    return ranked.drop("_all", "_risk", "_end", "_size")


def paginate(events: DataFrame, page: int = 1, page_size: int = config.PAGE_SIZE, key: str = "event_id") -> DataFrame:
    if page < 1 or not 1 <= page_size <= config.MAX_PAGE_SIZE:
        raise ValueError("page starts at 1, page_size is 1 to 100")
    return events.orderBy(key).offset((page - 1) * page_size).limit(page_size)


def paginate_with_total(events: DataFrame, page: int = 1, page_size: int = config.PAGE_SIZE) -> DataFrame:
    total = events.agg(F.count(F.lit(1)).alias("total"))
    return paginate(events, page, page_size).join(F.broadcast(total))


def write_ranked(scored: DataFrame, path: str) -> None:
    """Stored in rank order by ranges, so that the files and row groups of a page are next to each other."""
    order = [F.col("risk_score").desc(), F.col("end_time").desc(), F.col("event_id")]
    scored.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def seek_page(scored: DataFrame, page_size: int = config.PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """The next ranked events behind a cursor (risk_score, end_time, event_id); None is the beginning.

    What lies before the cursor is not sorted or skipped: the bound on the score reaches the
    files, and only the first ``page_size`` rows behind it are kept by each task. Scores and
    times must be known, as they are in the stored tables.
    """
    if not 1 <= page_size <= config.MAX_PAGE_SIZE:
        raise ValueError("page_size is 1 to 100")
    if after is not None:
        score, end, event = F.lit(float(after[0])), F.lit(after[1]).cast("timestamp"), F.lit(int(after[2]))
        behind = (F.col("risk_score") < score) | ((F.col("risk_score") == score) & ((F.col("end_time") < end) | ((F.col("end_time") == end) & (F.col("event_id") > event))))
        scored = scored.filter((F.col("risk_score") <= score) & behind)
    return rank_events(scored).limit(page_size)


def cursor_of(page: DataFrame) -> tuple | None:
    """The cursor behind a page: its last row; None behind an empty page."""
    row = page.select("risk_score", "end_time", "event_id").orderBy("risk_score", "end_time", F.col("event_id").desc()).first()
    return None if row is None else tuple(row)


def stored_or_computed(events: DataFrame, stored: DataFrame, computed: DataFrame, names: Sequence[str], flag: str = "is_computed") -> DataFrame:
    """Events with ``names`` of their stored row as a whole, else of the computed one; ``flag`` tells which.

    A stored row counts although some of its values are null: the two are never mixed.
    """
    held = stored.select("event_id", F.struct(*names).alias("_stored"))
    made = computed.select("event_id", F.struct(*names).alias("_computed"))
    joined = events.join(held, "event_id", "left").join(made, "event_id", "left")
    chosen = F.coalesce("_stored", "_computed")
    return joined.select(*events.columns, *(chosen[n].alias(n) for n in names), F.col("_stored").isNull().alias(flag))


def with_stored_risk(events: DataFrame, stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Stored assessment where there is one, else the computed one."""
    return stored_or_computed(events, stored, computed, ("risk_score", "severity"))


def stored_detail(events: DataFrame, stored: dict[str, DataFrame], computed: dict[str, DataFrame], names: dict[str, Sequence[str]]) -> DataFrame:
    """Events with their profile, prediction and risk, each as it is stored or else computed, and a flag for each."""
    out = events
    for part, columns in names.items():
        out = stored_or_computed(out, stored[part], computed[part], columns, f"{part}_is_computed")
    return out


def hotspot_markers(events: DataFrame, stored_risk: DataFrame, severity: str | None = None) -> DataFrame:
    """Markers inside the region with their severity bucket; no limit yet."""
    markers = severity_markers(region_filter(events), stored_risk)
    return markers if severity is None else markers.filter(F.col("risk_severity") == F.lit(severity.lower()))


def severity_markers(events: DataFrame, stored_risk: DataFrame) -> DataFrame:
    """Markers of all given events with their severity bucket."""
    risk = stored_risk.select("event_id", F.col("risk_score").alias("stored_score"), F.col("severity").alias("stored_severity"))
    joined = events.join(risk, "event_id", "left")
    return joined.select(
        "event_id", "latitude", "longitude", "status", "observation_count", "persistence_score", "trend",
        F.coalesce("stored_score", "persistence_score").alias("risk_score"),
        severity_bucket(F.col("stored_severity"), F.col("status"), F.col("persistence_score")).alias("risk_severity"),
        F.col("end_time").alias("last_detection"))


def map_hotspots(events: DataFrame, stored_risk: DataFrame, severity: str | None = None,
                 limit: int = config.HOTSPOT_LIMIT) -> DataFrame:
    if not 1 <= limit <= config.MAX_HOTSPOT_LIMIT:
        raise ValueError("limit must be 1 to 1000")
    markers = hotspot_markers(events, stored_risk, severity)
    return markers.orderBy(F.col("risk_score").desc(), F.col("event_id")).limit(limit)


def hotspot_summary(markers: DataFrame) -> DataFrame:
    return markers.agg(*(F.count_if(F.col("risk_severity") == name).alias(name) for name in ("high", "medium", "low")))


def is_outlier(anomaly_score: Column, kind: Column) -> Column:
    return F.coalesce(anomaly_score < 0, F.lit(False)) | F.coalesce(kind == "anomalous_thermal_pattern", F.lit(False))


def search_events(cards: DataFrame, text: str = "", status: str = "ALL", severity: str = "ALL",
                  classification: str = "ALL", outliers: str = "ALL") -> DataFrame:
    """Case-insensitive text search with filters, over events that carry their labels."""
    found = cards.filter(F.lower(card_text()).contains(text.strip().lower()))
    return filter_cards(found, status, severity, classification, outliers)


def card_text() -> Column:
    """What a search looks at."""
    return F.concat_ws(" ", F.col("event_id").cast("string"), F.coalesce("location_name", F.lit("")),
                       F.format_string("%.4f %.4f", "latitude", "longitude"), class_label(F.col("classification")))


def filter_cards(found: DataFrame, status: str = "ALL", severity: str = "ALL", classification: str = "ALL", outliers: str = "ALL") -> DataFrame:
    if status != "ALL":
        found = found.filter(F.col("status") == status)
    if severity != "ALL":
        found = found.filter(F.upper("risk_severity") == severity)
    if classification != "ALL":
        found = found.filter(F.col("classification") == classification)
    if outliers != "ALL":
        odd = is_outlier(F.col("anomaly_score"), F.col("classification"))
        found = found.filter(odd if outliers == "OUTLIERS" else ~odd)
    return found


def search_page(found: DataFrame, page: int = 1, page_size: int = config.LIST_PAGE_SIZE) -> DataFrame:
    ordered = found.orderBy(F.coalesce("risk_score", F.lit(-1.0)).desc(), F.col("event_id"))
    return ordered.offset((page - 1) * page_size).limit(page_size)


def priority_details(markers: DataFrame, details: DataFrame) -> DataFrame:
    """High-severity markers by score with the event's detail attached where known."""
    high = markers.filter("risk_severity = 'high'").select("event_id", "risk_score")
    return high.join(details, "event_id", "left").orderBy(F.coalesce("risk_score", F.lit(0.0)).desc(), F.col("event_id"))


def event_detail(events: DataFrame, linked: DataFrame, risk: DataFrame, event_id: int | None = None) -> DataFrame:
    """Members with their event's attributes, one row per member.

    Long form on purpose: an event may have more members than one row can hold.
    """
    heads = events if event_id is None else events.filter(F.col("event_id") == event_id)
    members = linked if event_id is None else linked.filter(F.col("event_id") == event_id)
    head = heads.select("event_id", "status", "persistence_score", "trend").join(
        risk.select("event_id", "risk_score", "severity", "classification"), "event_id", "left")
    if event_id is not None:
        head = broadcast_if_small(head)
    return members.select("event_id", "obs_id", "timestamp", "latitude", "longitude", "intensity", "confidence",
                          "source").join(head, "event_id")


def evidence_chain(metrics: DataFrame, events: DataFrame, risk: DataFrame) -> DataFrame:
    """Readable statements per event with its class and risk."""
    def known(name: str, fmt: str) -> Column:
        return F.coalesce(F.format_string(fmt, F.col(name)), F.lit("N/A"))

    joined = (metrics.join(events.select("event_id", "status"), "event_id")
              .join(risk.select("event_id", "classification", "risk_score", "severity"), "event_id"))
    chain = F.array(
        F.format_string("%d detections over %d day(s)", F.col("total_detections"), F.col("active_days")),
        F.concat(F.lit("Thermal intensity: "), F.when(F.col("average_intensity").isNull(), "N/A").otherwise(
            known("average_intensity", "%.2f")), F.lit(" K")),
        F.concat(F.lit("Trend: "), F.col("trend")),
        F.concat(F.lit("Spatial stability: "), F.when(F.col("spatial_stability").isNull(), "N/A").otherwise(
            known("spatial_stability", "%.8f"))),
        F.concat(F.lit("Event status: "), F.col("status")))
    return joined.select("event_id", "classification", "risk_score", "severity", chain.alias("evidence_chain"))

"""Stateful lifecycle of locations: ACTIVE, PERSISTENT, RESOLVED after silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline import config
from emberline.streaming.jobs import CELL_DEGREES, LATENESS, ROCKSDB, with_block, with_cell

CHANGES = "cell_lat LONG, cell_lon LONG, status STRING, detections LONG, active_days LONG, last_detection TIMESTAMP"
HOUR_MS = 3_600_000


EPISODES = "cells ARRAY<STRUCT<cell_lat: LONG, cell_lon: LONG, detections: LONG, first_ms: LONG, last_ms: LONG, lasting: BOOLEAN, seen: ARRAY<LONG>>>"


def lifecycle_step(silence_ms: int, min_days: int, min_detections: int):
    """The state function of one block of cells: the open episode of each, with the days seen in it.

    Rows are taken in event time. A gap above the silence limit closes the episode, as
    does a timeout when no row comes; either gives RESOLVED and clears the state. Only
    changes are emitted: ACTIVE at an episode's first detection, PERSISTENT when it has
    enough days and detections. A late row joins the open episode unless it lies more
    than the limit before its start: then it belongs to a closed one and is left out.
    The state travels with the block's rows, once each way, however many rows there are.
    """
    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(r[0], r[1]): [r[2], r[3], r[4], r[5], set(r[6])] for r in state.get[0]} if state.exists else {}
        changes: list[tuple] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("timestamp")
            stamps = rows["timestamp"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            for lat, lon, stamp in zip(rows["cell_lat"].tolist(), rows["cell_lon"].tolist(), stamps, strict=True):
                count, first, last, lasting, seen = held.get((lat, lon)) or (0, 0, 0, False, set())
                if count and stamp < first - silence_ms:
                    continue
                if count and stamp - last > silence_ms:
                    changes.append((lat, lon, "RESOLVED", count, len(seen), last))
                    count, lasting, seen = 0, False, set()
                if count == 0:
                    first = last = stamp
                count, first, last = count + 1, min(first, stamp), max(last, stamp)
                seen.add(stamp // (24 * HOUR_MS))
                if count == 1:
                    changes.append((lat, lon, "ACTIVE", count, len(seen), last))
                if not lasting and len(seen) >= min_days and count >= min_detections:
                    lasting = True
                    changes.append((lat, lon, "PERSISTENT", count, len(seen), last))
                held[lat, lon] = [count, first, last, lasting, seen]
        watermark = state.getCurrentWatermarkMs()
        for lat, lon in [cell for cell, episode in held.items() if episode[2] + silence_ms <= watermark]:
            count, _, last, _, seen = held.pop((lat, lon))
            changes.append((lat, lon, "RESOLVED", count, len(seen), last))
        if held:
            state.update(([(*cell, *episode[:4], sorted(episode[4])) for cell, episode in held.items()],))
            # a timeout comes when the watermark is past this stamp
            state.setTimeoutTimestamp(min(episode[2] for episode in held.values()) + silence_ms - 1)
        elif state.exists:
            state.remove()
        if changes:
            out = pd.DataFrame(changes, columns=["cell_lat", "cell_lon", "status", "detections", "active_days", "last_detection"])
            yield out.assign(last_detection=out["last_detection"].to_numpy("int64").astype("datetime64[ms]"))

    return step


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keeps what does not fit into memory on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_lifecycle(rows: DataFrame, resolved_hours: float = config.RESOLVED_AFTER_HOURS, min_days: int = config.PERSISTENT_MIN_DAYS,
                     min_detections: int = config.PERSISTENCE_MIN_DETECTIONS, lateness: str = LATENESS,
                     side: float = CELL_DEGREES) -> DataFrame:
    """Status changes per location cell, in event time."""
    use_rocksdb(rows.sparkSession)
    keyed = with_block(with_cell(rows, side).select("cell_lat", "cell_lon", "timestamp").withWatermark("timestamp", lateness))
    return keyed.groupBy("block_lat", "block_lon").applyInPandasWithState(
        lifecycle_step(int(resolved_hours * HOUR_MS), min_days, min_detections), CHANGES, EPISODES, "append", GroupStateTimeout.EventTimeTimeout)

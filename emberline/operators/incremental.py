"""Clustering that is kept up to date: new detections join the stored events they touch.

An ``EventStore`` is a folder of append-only tables. A batch of detections is linked only
against the stored cubes of the time buckets it reaches (its own and the neighbours), so
no other partition is read or written:

* ``rows``: the located detections with their cell, partitioned by time bucket; the event
  is the one they had when they came.
* ``updates``: re-delivered detections, newer values of stored rows.
* ``cubes``: for each (cell, bucket) the box, size and sums of the rows of one batch, with
  the event; boxes of several batches are merged when read.
* ``aliases``: events that a later batch joined to another one, with the survivor. Rows and
  cubes keep the old id; it is resolved when they are read.
* ``activity``, ``daily``: days and counts of each batch by event, and its detections by day;
  merged when read, so neither needs a member again.
* ``events``, ``risk``: newest version of each touched event, written by the caller.

Detections never go away, so components only grow: cubes of the batch and the events of
stored cubes are the nodes, links that involve a changed cube the edges, and the component
of a stored event keeps the smallest stored id. An event that nothing stored belongs to is
called by its smallest obs_id. The union of all batches gives the components that
clustering everything at once would give, whatever the batches are.

A batch becomes visible by its row in ``runs``, written last; what an interrupted batch
left is not read, and the same batch can be added again. Batches are added one at a time.
Rows without a position or a time belong to no event and are not stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import config
from emberline.operators.activity import activity_of, daily_totals, day_words, merged_words
from emberline.operators.cluster import Linker, _floor_div, _judge, _join_cubes, _prefixed, hot_cubes
from emberline.operators.components import connected_components
from emberline.session import broadcast_if_small, discard, materialize

CUBE = ("band", "column", "bucket")
SUMS = ("n", "lat_sum", "lon_sum")
LOW, HIGH = ("cube", "lat_lo", "lon_lo", "t_lo"), ("lat_hi", "lon_hi", "t_hi")


class _ReachLinker(Linker):
    """Links of changed cubes with all cubes in reach; pairs of unchanged cubes are not looked at."""

    def __init__(self, cubes: DataFrame, points: DataFrame, distance_meters: float, time_hours: float):
        super().__init__(None, distance_meters, time_hours)
        self.cubes, self.points = cubes, points

    def candidate_pairs(self) -> DataFrame:
        block = ["block_lat", "block_lon", "block_t"]
        home, halo = self._blocks()
        changed = self.cubes.select("cube", "changed")
        possible, certain = _judge(self.distance, self.time_us)
        start = home.join(changed.filter("changed").select("cube"), "cube", "left_semi")
        pairs = _prefixed(start, "a_", [*block, "zone"]).join(_prefixed(halo.join(changed, "cube"), "b_", block), block)
        return (pairs.filter((F.col("a_cube") != F.col("b_cube")) & (~F.col("b_changed") | (F.col("a_cube") < F.col("b_cube")))).filter(possible)
                .withColumn("certain", certain).drop("b_changed", *block))


@dataclass(frozen=True)
class Added:
    """What a batch did: its number, and the events its rows belong to now."""

    run: int
    inserted: int
    updated: int
    merged_events: int


class EventStore:
    """Stored detections with their events; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                 time_hours: float = config.CLUSTER_TIME_HOURS):
        self.spark, self.path = spark, path.rstrip("/")
        self.distance, self.hours = distance_meters, time_hours

    # ---- tables -----------------------------------------------------------------------

    def runs(self) -> list[int]:
        """Numbers of the batches that were added in full."""
        rows = self._read("runs", None)
        return [] if rows is None else sorted(r["number"] for r in rows.select("number").distinct().collect())

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def _read(self, name: str, runs: Sequence[int] | None) -> DataFrame | None:
        if runs is None:
            return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(f"{self.path}/{name}") else None
        paths = [p for k in runs if self._exists(p := f"{self.path}/{name}/run={k}")]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else None

    def _write(self, df: DataFrame, name: str, run: int, by_bucket: bool = False) -> None:
        target = f"{self.path}/{name}/run={run}"
        if by_bucket:
            # a bucket that holds a large share of the batch is split over several writers
            df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        else:
            df.write.mode("overwrite").parquet(target)

    def _aliases(self) -> DataFrame | None:
        """(event_id, survivor), the newest survivor of each."""
        log = self._read("aliases", self.runs())
        return None if log is None else log.groupBy("event_id").agg(F.max_by("survivor", "run").alias("survivor"))

    def _resolved(self, df: DataFrame) -> DataFrame:
        aliases = self._aliases()
        if aliases is None:
            return df
        return df.join(broadcast_if_small(aliases), "event_id", "left").withColumn("event_id", F.coalesce("survivor", "event_id")).drop("survivor")

    def rows(self, buckets: Sequence[int] | None = None, within: tuple[int, int] | None = None) -> DataFrame | None:
        """Stored detections with their current event; only the wanted buckets' files are read."""
        runs = self.runs()
        log = self._read("rows", runs)
        if log is None:
            return None
        newer = self._read("updates", runs)

        def wanted(df: DataFrame) -> DataFrame:
            if buckets is not None:
                df = df.filter(F.col("bucket").isin([int(b) for b in buckets]))
            return df if within is None else df.filter(F.col("bucket").between(*within))

        log = wanted(log)
        if newer is not None:
            values = [c for c in newer.columns if c not in ("obs_id", "run", "bucket")]
            last = wanted(newer).groupBy("obs_id").agg(F.max_by(F.struct(*values), "run").alias("new"))
            log = log.join(broadcast_if_small(last), "obs_id", "left").select(
                *(F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in log.columns))
        return self._resolved(log).drop("run")

    def cubes(self, buckets: Sequence[int]) -> DataFrame | None:
        """Stored cubes of some buckets, the boxes of all batches merged, with their event."""
        log = self._read("cubes", self.runs())
        if log is None:
            return None
        return _merged(self._resolved(log.filter(F.col("bucket").isin([int(b) for b in buckets]))), F.min("event_id").alias("event_id"))

    def newest(self, name: str) -> DataFrame | None:
        """The newest version of each event that is still there, of a table written by ``put``."""
        log = self._read(name, self.runs())
        if log is None:
            return None
        values = [c for c in log.columns if c not in ("event_id", "run")]
        last = log.groupBy("event_id").agg(F.max_by(F.struct(*values), "run").alias("row")).select("event_id", "row.*")
        aliases = self._aliases()
        return last if aliases is None else last.join(broadcast_if_small(aliases.select("event_id")), "event_id", "left_anti")

    def activity(self) -> DataFrame | None:
        """Detections, active days and longest run of every stored event, from the batches' bit maps."""
        log = self._read("activity", self.runs())
        return None if log is None else activity_of(merged_words(self._resolved(log)))

    def daily_counts(self) -> DataFrame | None:
        """Detections of each day over all batches."""
        log = self._read("daily", self.runs())
        return None if log is None else log.groupBy("day").agg(F.sum("n").alias("n"))

    # ---- adding -----------------------------------------------------------------------

    def add(self, batch: DataFrame) -> Added:
        """Link a batch (unique obs_id; a known one is a re-delivery) and make it visible."""
        run = self.link(batch)
        self.publish(run)
        return run

    def link(self, batch: DataFrame) -> Added:
        """Write a batch's rows, cubes and aliases under the next number; nothing is visible yet."""
        spark, before = self.spark, self.runs()
        run = (before[-1] if before else 0) + 1
        linker = Linker(None, self.distance, self.hours)
        located = materialize(linker._with_cell(batch.drop("event_id")), "batch-located")
        # as many buckets as the batch's time span has, however many rows there are
        own = [r["bucket"] for r in located.select("bucket").distinct().collect()]
        reach = sorted({b + d for b in own for d in (-1, 0, 1)})
        stored_rows, stored_cubes = self.rows(buckets=reach), self.cubes(reach)
        fresh, known = located, None
        if stored_rows is not None:
            ids = stored_rows.filter(F.col("bucket").isin(own)).select("obs_id", "bucket")
            known = materialize(located.join(ids, ["obs_id", "bucket"], "left_semi"), "batch-known")
            fresh = materialize(located.join(ids, ["obs_id", "bucket"], "left_anti"), "batch-fresh")
        points = linker._points(fresh)
        new_cubes = _boxes(points).withColumn("event_id", F.lit(None).cast("long")).withColumn("changed", F.lit(True))
        if stored_cubes is not None:
            old = stored_cubes.withColumn("changed", F.lit(False)).select(new_cubes.columns)
            new_cubes = _merged(new_cubes.unionByName(old), F.min("event_id").alias("event_id"), F.max("changed").alias("changed"))
        cubes = materialize(new_cubes, "reach-cubes")
        if stored_rows is not None:
            points = points.unionByName(linker._points(stored_rows))
        links = materialize(_ReachLinker(cubes, points, self.distance, self.hours).links(), "reach-links")
        label = cubes.select("cube", F.coalesce("event_id", "cube").alias("label"))
        edges = (links.join(label.toDF("a_cube", "a"), "a_cube").join(label.toDF("b_cube", "b"), "b_cube").filter("a <> b").select("a", "b", "zone"))
        parts = materialize(connected_components(edges, "a", "b", near=["zone"]), "reach-components")
        stored_ids = cubes.filter("event_id IS NOT NULL").select(F.col("event_id").alias("node")).distinct().withColumn("stored", F.lit(True))
        placed = materialize(parts.join(stored_ids, "node", "left"), "reach-placed")
        winner = placed.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("stored"), F.col("node"))), F.min("node")).alias("survivor"))
        mapping = materialize(placed.join(winner, "component").select("node", "survivor", "stored"), "reach-mapping")
        # cubes of the batch with their event
        final = (cubes.filter("changed").withColumn("node", F.coalesce("event_id", "cube")).join(broadcast_if_small(mapping.select("node", "survivor")), "node", "left")
                 .select(*CUBE, "n", F.coalesce("survivor", "node").alias("event_id")))
        final = materialize(final, "batch-cubes")
        rows = _join_cubes(fresh, final.select(*CUBE, "event_id"), CUBE, hot_cubes(final, CUBE))
        inserted, updated = fresh.count(), 0
        if inserted:
            self._write(rows, "rows", run, by_bucket=True)
            self._write(day_words(rows), "activity", run)
            self._write(daily_totals(rows), "daily", run)
            self._write(_boxes(linker._points(fresh)).join(final.select(*CUBE, "event_id"), list(CUBE)), "cubes", run, by_bucket=True)
        if known is not None:
            updated = known.count()
            if updated:
                self._write(known.drop("band", "column"), "updates", run, by_bucket=True)
        lost = mapping.filter("stored AND node <> survivor").select(F.col("node").alias("event_id"), "survivor")
        merged = lost.count()
        if merged:
            older = self._aliases()
            if older is not None:
                moved = older.join(lost.withColumnRenamed("event_id", "old").withColumnRenamed("survivor", "new"), F.col("survivor") == F.col("old")).select("event_id", F.col("new").alias("survivor"))
                lost = lost.unionByName(moved)
            self._write(lost, "aliases", run)
        added = Added(run, inserted, updated, merged)
        discard(located, cubes, links, parts, placed, mapping, final, *([] if known is None else [known, fresh]))
        return added

    def put(self, run: Added, name: str, rows: DataFrame) -> None:
        """Versions of events that a linked batch touched."""
        self._write(rows, name, run.run)

    def publish(self, run: Added) -> None:
        self.spark.createDataFrame([(run.run, run.inserted, run.updated, run.merged_events)], "number long, inserted long, updated long, merged_events long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/runs/run={run.run}")

    def seen_with(self, run: Added) -> EventStore:
        """This store as it will be once the linked batch is published."""
        ahead = EventStore(self.spark, self.path, self.distance, self.hours)
        published = self.runs()
        ahead.runs = lambda: sorted({*published, run.run})  # type: ignore[method-assign]
        return ahead

    def touched(self, run: Added) -> DataFrame:
        """(event_id) of the events that the batch's rows belong to."""
        parts = [df.select("obs_id", "bucket") for name in ("rows", "updates") if (df := self._read(name, [run.run])) is not None]
        own = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        return self.rows(buckets=buckets).join(own, ["obs_id", "bucket"], "left_semi").select("event_id").distinct()

    def members(self, events: DataFrame, linker_hours: float | None = None) -> DataFrame:
        """All rows of some events; the buckets outside their time span are not read."""
        bucket_us = max(int(round((linker_hours or self.hours) * 3_600_000_000)), 1)
        log = self._resolved(self._read("cubes", self.runs()).select("event_id", "t_lo", "t_hi"))
        span = log.join(broadcast_if_small(events), "event_id", "left_semi").agg(
            F.min(_floor_div(F.col("t_lo"), bucket_us)).alias("low"), F.max(_floor_div(F.col("t_hi"), bucket_us)).alias("high")).first()
        if span["low"] is None:
            return self.rows(buckets=[])
        return self.rows(within=(span["low"], span["high"])).join(broadcast_if_small(events), "event_id", "left_semi")


def _boxes(points: DataFrame) -> DataFrame:
    return points.groupBy(*CUBE).agg(
        F.min("obs_id").alias("cube"), F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum"),
        *(f(c).alias(f"{c}_{end}") for c in ("lat", "lon", "t") for end, f in (("lo", F.min), ("hi", F.max))))


def _merged(boxes: DataFrame, *more) -> DataFrame:
    """Boxes of the same cube from several batches as one."""
    return boxes.groupBy(*CUBE).agg(*(F.sum(c).alias(c) for c in SUMS), *(F.min(c).alias(c) for c in LOW), *(F.max(c).alias(c) for c in HIGH), *more)

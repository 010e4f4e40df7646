"""Single-linkage space-time clustering of detections.

Two detections are linked when they lie within the distance and the time limit;
an event is a connected component. The work is done on *cubes*, not on pairs of
rows:

1. A cell's diagonal is at most the distance limit and a time bucket is at most
   the time limit long, so all rows of one (cell, bucket) cube are linked. One
   combinable aggregation turns any number of rows into one cube row, however
   hot the site is.
2. Cubes near one another are paired through coarse blocks (an equi-join) and
   judged by their bounding boxes: surely linked, surely apart, or undecided.
3. Undecided pairs with few members are settled by testing the members;
   undecided pairs with many members are split eight ways per axis and judged
   again. Boxes shrink to single coordinates, so this always ends.
4. Connected components of the cube graph give the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.geo import cell_side_degrees, linkage_meters, nearest_edge_cosine
from emberline.functions.numeric import exact_mean
from emberline.operators.components import connected_components
from emberline.session import broadcast_if_small, cut_lineage

BLOCK_BANDS = 8
BLOCK_BUCKETS = 4
SPLIT = 8
LIGHT_PRODUCT = 4096
# Rows of one cube above which the join back to its rows is spread over tasks.
HOT_CUBE_ROWS = 200_000
HOT_SALTS = 16
BOX = ("n", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "t_lo", "t_hi")


def _floor_div(value: Column, width: int) -> Column:
    """Exact floor division of longs."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def _box_aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"),
            F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
            F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"),
            F.min("t").alias("t_lo"), F.max("t").alias("t_hi")]


def _prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _apart(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    return F.greatest(F.col(lo_a) - F.col(hi_b), F.col(lo_b) - F.col(hi_a))


def _span(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    return F.greatest(F.col(hi_a) - F.col(lo_b), F.col(hi_b) - F.col(lo_a))


def _judge(distance: float, time_us: int) -> tuple[Column, Column]:
    """(possible, certain) for two boxes with columns a_* and b_*."""
    zero, scale = F.lit(0.0), F.lit(config.METERS_PER_DEGREE)
    mid_lo = (F.col("a_lat_lo") + F.col("b_lat_lo")) / F.lit(2.0)
    mid_hi = (F.col("a_lat_hi") + F.col("b_lat_hi")) / F.lit(2.0)
    flattest = F.when(mid_lo > 0, mid_lo).when(mid_hi < 0, -mid_hi).otherwise(zero)
    steepest = F.greatest(F.abs(mid_lo), F.abs(mid_hi))
    nearest = F.hypot(scale * F.greatest(zero, _apart("a_lat_lo", "a_lat_hi", "b_lat_lo", "b_lat_hi")),
                      scale * F.cos(F.radians(steepest))
                      * F.greatest(zero, _apart("a_lon_lo", "a_lon_hi", "b_lon_lo", "b_lon_hi")))
    farthest = F.hypot(scale * _span("a_lat_lo", "a_lat_hi", "b_lat_lo", "b_lat_hi"),
                       scale * F.cos(F.radians(flattest)) * _span("a_lon_lo", "a_lon_hi", "b_lon_lo", "b_lon_hi"))
    points = ((F.col("a_lat_lo") == F.col("a_lat_hi")) & (F.col("a_lon_lo") == F.col("a_lon_hi"))
              & (F.col("b_lat_lo") == F.col("b_lat_hi")) & (F.col("b_lon_lo") == F.col("b_lon_hi")))
    in_time = _apart("a_t_lo", "a_t_hi", "b_t_lo", "b_t_hi") <= F.lit(time_us)
    limit = F.lit(distance)
    possible = in_time & F.when(points, farthest <= limit).otherwise(nearest <= limit * F.lit(1 + 1e-9))
    certain = F.when(points, farthest <= limit).otherwise(farthest <= limit * F.lit(1 - 1e-9))
    return possible, certain


class Linker:
    """Cubes of one detection table and the links between them; without a table, only the grid."""

    def __init__(self, observations: DataFrame | None, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                 time_hours: float = config.CLUSTER_TIME_HOURS, within: Sequence[str] = (),
                 light_product: int = LIGHT_PRODUCT):
        if distance_meters <= 0 or time_hours < 0:
            raise ValueError("distance must be positive and time must not be negative")
        self.distance = float(distance_meters)
        self.time_us = int(round(time_hours * 3_600_000_000))
        self.bucket_us = max(self.time_us, 1)
        self.within = list(within)
        self.light_product = light_product
        self.side = cell_side_degrees(self.distance)
        self.cube_key = [*self.within, "band", "column", "bucket"]
        if observations is None:
            return
        self.points = self._points(observations)
        self.cubes = cut_lineage(
            self.points.groupBy(*self.cube_key)
            .agg(F.min("obs_id").alias("cube"), *_box_aggregates(),
                 F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum")))

    def _with_cell(self, observations: DataFrame) -> DataFrame:
        width = F.least(F.lit(self.side) / nearest_edge_cosine(F.col("band"), self.side), F.lit(360.0))
        moment = F.unix_micros(F.col("timestamp").cast("timestamp"))
        return (observations
                .filter("latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp IS NOT NULL")
                .withColumn("band", F.floor(F.col("latitude") / F.lit(self.side)).cast("long"))
                .withColumn("column", F.floor(F.col("longitude") / width).cast("long"))
                .withColumn("bucket", _floor_div(moment, self.bucket_us)))

    def _points(self, observations: DataFrame) -> DataFrame:
        return self._with_cell(observations).select(
            *self.cube_key, "obs_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
            F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"))

    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        """Cubes at their home block, and cubes copied to every block in reach."""
        block_lat = self.side * BLOCK_BANDS
        block_us = self.bucket_us * BLOCK_BUCKETS
        reach = self.distance / config.METERS_PER_DEGREE * (1 + 1e-6)

        def lon_width(index: Column) -> Column:
            return F.least(F.lit(block_lat) / nearest_edge_cosine(index, block_lat), F.lit(360.0))

        def lat_index(value: Column) -> Column:
            return F.floor(value / F.lit(block_lat)).cast("long")

        boxes = self.cubes.select(*self.within, "cube", *BOX)
        home = (boxes
                .withColumn("block_lat", lat_index(F.col("lat_lo")))
                .withColumn("block_lon", F.floor(F.col("lon_lo") / lon_width(F.col("block_lat"))).cast("long"))
                .withColumn("block_t", _floor_div(F.col("t_lo"), block_us))
                .withColumn("zone", F.xxhash64(F.floor(F.col("block_lat") / 8), F.floor(F.col("block_lon") / 8), F.floor(F.col("block_t") / 8))))
        # A partner's lower corner lies at most one cell plus the reach below this box.
        below = reach + self.side
        steep = F.least(F.greatest(F.abs("lat_lo"), F.abs("lat_hi")) + F.lit(below), F.lit(90.0))
        flattest_cell = F.greatest(F.cos(F.radians(steep)), F.lit(1e-9))
        reach_lon = F.least(F.lit(reach) / flattest_cell, F.lit(360.0))
        cell_lon = F.least(F.lit(self.side) / flattest_cell, F.lit(360.0))
        halo = (boxes
                .withColumn("block_lat", F.explode(F.sequence(
                    lat_index(F.col("lat_lo") - F.lit(below)), lat_index(F.col("lat_hi") + F.lit(reach)))))
                .withColumn("width", lon_width(F.col("block_lat")))
                .withColumn("block_lon", F.explode(F.sequence(
                    F.floor((F.col("lon_lo") - reach_lon - cell_lon) / F.col("width")).cast("long"),
                    F.floor((F.col("lon_hi") + reach_lon) / F.col("width")).cast("long"))))
                .withColumn("block_t", F.explode(F.sequence(
                    _floor_div(F.col("t_lo") - F.lit(self.time_us + self.bucket_us), block_us),
                    _floor_div(F.col("t_hi") + F.lit(self.time_us), block_us))))
                .drop("width"))
        return home, halo

    def candidate_pairs(self) -> DataFrame:
        """Cube pairs that are linked for certain or need a closer look."""
        block = [*self.within, "block_lat", "block_lon", "block_t"]
        home, halo = self._blocks()
        possible, certain = _judge(self.distance, self.time_us)
        return (_prefixed(home, "a_", [*block, "zone"]).join(_prefixed(halo, "b_", block), block)
                .filter(F.col("a_cube") < F.col("b_cube")).filter(possible)
                .withColumn("certain", certain)
                .drop("block_lat", "block_lon", "block_t"))

    def links(self) -> DataFrame:
        """(a_cube, b_cube, zone) for every linked pair of cubes."""
        pairs = cut_lineage(self.candidate_pairs())
        weight = F.col("a_n").cast("double") * F.col("b_n").cast("double")
        undecided = pairs.filter(~F.col("certain")).withColumn("light", weight <= F.lit(float(self.light_product)))
        load = {row["light"]: row["n"] for row in undecided.groupBy("light").agg(F.count(F.lit(1)).alias("n")).collect()}
        found = [pairs.filter("certain").select("a_cube", "b_cube", "zone")]
        if load.get(True):
            found.append(self._test_members(undecided.filter("light"), self._members(undecided.filter("light"))))
        if load.get(False):
            found.extend(self._split(undecided.filter("NOT light")))
        linked = found[0]
        for more in found[1:]:
            linked = linked.unionAll(more)
        return linked

    def _members(self, pairs: DataFrame) -> DataFrame:
        """Rows of the cubes named in ``pairs``: (node, cube, lat, lon, t)."""
        named = (pairs.select(F.col("a_cube").alias("cube")).unionAll(pairs.select(F.col("b_cube").alias("cube")))
                 .distinct())
        keys = self.cubes.select(*self.cube_key, "cube").join(named, "cube", "left_semi")
        return (self.points.join(broadcast_if_small(keys), self.cube_key)
                .select("cube", F.array(F.lit(0).cast("long")).alias("path"), "lat", "lon", "t"))

    def _test_members(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Exact test of the members of light pairs (at most ``light_product`` tests a pair)."""
        keys = pairs.select("a_cube", "b_cube", "zone",
                            *(F.col(c) if c in pairs.columns else F.array(F.lit(0).cast("long")).alias(c)
                              for c in ("a_path", "b_path")))
        side_a, side_b = (_prefixed(members, p) for p in ("a_", "b_"))
        close = (linkage_meters(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= F.lit(self.distance))
        return (keys.join(side_a, ["a_cube", "a_path"]).join(side_b, ["b_cube", "b_path"])
                .filter((F.abs(F.col("a_t") - F.col("b_t")) <= F.lit(self.time_us)) & close)
                .select("a_cube", "b_cube", "zone").distinct())

    def _split(self, heavy: DataFrame) -> list[DataFrame]:
        """Judge populous undecided pairs on ever smaller boxes."""
        root = F.array(F.lit(0).cast("long"))
        open_pairs = heavy.select(
            "a_cube", "b_cube", "zone", root.alias("a_path"), root.alias("b_path"))
        boxes = (self.cubes.select("cube", root.alias("path"), *BOX))
        members = self._members(heavy)
        found: list[DataFrame] = []
        possible, certain = _judge(self.distance, self.time_us)

        def slot(value: str, low: str, high: str) -> Column:
            share = (F.col(value) - F.col(low)) / (F.col(high) - F.col(low))
            return F.when(F.col(high) > F.col(low),
                          F.least(F.floor(share * F.lit(SPLIT)), F.lit(SPLIT - 1))).otherwise(F.lit(0)).cast("long")

        while True:
            wanted = (open_pairs.select(F.col("a_cube").alias("cube"), F.col("a_path").alias("path")).unionAll(
                open_pairs.select(F.col("b_cube").alias("cube"), F.col("b_path").alias("path"))).distinct())
            parents = boxes.select("cube", "path", "lat_lo", "lat_hi", "lon_lo", "lon_hi").join(
                wanted, ["cube", "path"], "left_semi")
            # Only the boxes still open travel on, each box splits into at most SPLIT * SPLIT.
            members = cut_lineage(
                members.join(broadcast_if_small(parents), ["cube", "path"])
                .select("cube", F.col("path").alias("parent"),
                        F.concat("path", F.array(slot("lat", "lat_lo", "lat_hi") * F.lit(SPLIT)
                                                 + slot("lon", "lon_lo", "lon_hi"))).alias("path"),
                        "lat", "lon", "t"))
            boxes = cut_lineage(members.groupBy("cube", "parent", "path").agg(*_box_aggregates()))
            side_a = _prefixed(boxes.withColumnRenamed("path", "child").withColumnRenamed("parent", "path"), "a_")
            side_b = _prefixed(boxes.withColumnRenamed("path", "child").withColumnRenamed("parent", "path"), "b_")
            judged = cut_lineage(
                open_pairs.join(side_a, ["a_cube", "a_path"]).join(side_b, ["b_cube", "b_path"])
                .filter(possible).withColumn("certain", certain)
                .select("a_cube", "b_cube", "zone", F.col("a_child").alias("a_path"), F.col("b_child").alias("b_path"),
                        (F.col("a_n").cast("double") * F.col("b_n").cast("double")
                         <= F.lit(float(self.light_product))).alias("light"), "certain"))
            settled = judged.filter("certain").select("a_cube", "b_cube", "zone").distinct()
            rest = judged.filter("NOT certain").join(settled, ["a_cube", "b_cube"], "left_anti")
            found.append(settled)
            members = members.drop("parent")
            light = rest.filter("light")
            if not light.isEmpty():
                tested = cut_lineage(self._test_members(light, members))
                found.append(tested)
                rest = rest.join(tested, ["a_cube", "b_cube"], "left_anti")
            open_pairs = cut_lineage(rest.filter("NOT light").select("a_cube", "b_cube", "zone", "a_path", "b_path"))
            boxes = boxes.drop("parent")
            if open_pairs.isEmpty():
                return found

    def labels(self) -> DataFrame:
        """Cubes with their event_id, the smallest obs_id of the event."""
        parts = connected_components(self.links(), "a_cube", "b_cube", near=["zone"])
        return (self.cubes.join(parts.withColumnRenamed("node", "cube"), "cube", "left")
                .withColumn("event_id", F.coalesce("component", "cube")).drop("component"))

    def assignments(self) -> DataFrame:
        """(obs_id, event_id) for every locatable row."""
        labels = self.labels()
        return _join_cubes(self.points, labels.select(*self.cube_key, "event_id"), self.cube_key, hot_cubes(labels, self.cube_key)).select(
            *self.within, "obs_id", "event_id")

    def attach(self, observations: DataFrame) -> DataFrame:
        """Locatable rows with their event_id: one equi-join on the cell, no join on row ids."""
        rows = self._with_cell(observations.drop("event_id"))
        labels = self.labels()
        return _join_cubes(rows, labels.select(*self.cube_key, "event_id"), self.cube_key, hot_cubes(labels, self.cube_key)).drop(
            "band", "column", "bucket")

    def events(self) -> DataFrame:
        """Event summaries straight from the cubes; the rows are not read again."""
        return self.labels().groupBy(*self.within, "event_id").agg(
            (F.sum("lat_sum") / F.sum("n")).alias("latitude"), (F.sum("lon_sum") / F.sum("n")).alias("longitude"),
            F.timestamp_micros(F.min("t_lo")).alias("start_time"), F.timestamp_micros(F.max("t_hi")).alias("end_time"),
            F.sum("n").alias("observation_count"))


def hot_cubes(cubes: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """Keys of the cubes of more than HOT_CUBE_ROWS rows; None without any. At most rows / HOT_CUBE_ROWS of them."""
    hot = cubes.filter(F.col("n") > HOT_CUBE_ROWS).select(*key)
    return None if hot.isEmpty() else hot


def _join_cubes(rows: DataFrame, labels: DataFrame, key: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """Rows with their cube's columns. Rows of hot cubes are spread over HOT_SALTS tasks, each with a copy of the cube."""
    if hot is None:
        return rows.join(labels, list(key))
    marked = hot.withColumn("_hot", F.lit(True))
    spread = (labels.join(broadcast_if_small(marked), list(key), "left")
              .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot"))
    salted = (rows.join(broadcast_if_small(marked), list(key), "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("obs_id"), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot"))
    return salted.join(spread, [*key, "_salt"]).drop("_salt")


def cluster_assignments(observations: DataFrame, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                        time_hours: float = config.CLUSTER_TIME_HOURS, within: Sequence[str] = (),
                        light_product: int = LIGHT_PRODUCT) -> DataFrame:
    """(obs_id, event_id) for every locatable row; ``within`` keeps groups apart."""
    return Linker(observations, distance_meters, time_hours, within, light_product).assignments()


def attach_events(observations: DataFrame, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                  time_hours: float = config.CLUSTER_TIME_HOURS) -> DataFrame:
    return Linker(observations, distance_meters, time_hours).attach(observations)


def linkage_graph(observations: DataFrame, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                  time_hours: float = config.CLUSTER_TIME_HOURS) -> DataFrame:
    """Sparse links between cubes; its closure is the closure of all close pairs."""
    return Linker(observations, distance_meters, time_hours).links().select("a_cube", "b_cube")


def assign_event_ids(observations: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every row keeps its place; rows without position or time get a null event."""
    return observations.drop("event_id").join(assignments, "obs_id", "left")


def summarize_events(linked: DataFrame) -> DataFrame:
    """One row per event: mean centroid, first and last time, size."""
    return (linked.filter("event_id IS NOT NULL").groupBy("event_id").agg(
        exact_mean("latitude").alias("latitude"), exact_mean("longitude").alias("longitude"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("observation_count")))


def cluster_events(observations: DataFrame, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                   time_hours: float = config.CLUSTER_TIME_HOURS) -> DataFrame:
    return Linker(observations, distance_meters, time_hours).events()


def single_cluster_groups(rows: DataFrame, group: str, distance_meters: float = config.CLUSTER_DISTANCE_METERS,
                          time_hours: float = config.CLUSTER_TIME_HOURS) -> DataFrame:
    """Groups whose own rows form exactly one cluster when linked on their own.

    A group of one cube is one cluster; only the cubes of other groups are paired.
    """
    grouped = rows.select(F.col(group).alias("group_key"), "obs_id", "latitude", "longitude", "timestamp")
    linker = Linker(grouped, distance_meters, time_hours, within=["group_key"])
    counted = linker.cubes.groupBy("group_key").agg(F.count(F.lit(1)).alias("cubes"))
    alone = counted.filter("cubes = 1").select("group_key")
    linker.cubes = cut_lineage(linker.cubes.join(counted.filter("cubes > 1"), "group_key", "left_semi"))
    parts = linker.labels().groupBy("group_key").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    return alone.unionAll(parts.filter("low = high").select("group_key")).select(F.col("group_key").alias(group))

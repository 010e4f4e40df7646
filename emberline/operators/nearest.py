"""The k nearest rows of a catalogue of any size, for any number of points.

The catalogue becomes a quadtree of nodes with a tight box and a row count, built level by
level with aggregations; a node of at most ``LEAF_ROWS`` rows is not divided. Points are
gathered into boxes of nearby points. All point boxes start at the root and go down
together: each level replaces divided nodes by their children (an equi-join on the node),
and a node goes when its least distance from the point box exceeds the distance within
which nodes nearer by hold k rows for certain. What is left when no divided node is open
are the leaves that can hold one of the k nearest of some point, and only their rows are
measured. The bound is exact, so no row is missed; rows at equal distance come by position.

Rows at one place are equally far from every point, so a place travels as one row, its
first; the k nearest rows of a point are among the first k rows of its k nearest places.
What all nodes have in common does not count for their order: for points east or west of
the whole catalogue the way to its edge is left out of the bounds, which would otherwise
grow with that way.

Distances are planar kilometres with the cosine of the point's latitude, as for naming
places. Points without a place have no rows; catalogue rows without a place are never
found. A catalogue with fewer than k rows gives them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.geo import search_km
from emberline.session import broadcast_if_small, discard, materialize

LEAF_ROWS = 8
MOST_LEVELS = 24
#: Points to a side of the grid that gathers them, at the catalogue's own extent.
POINT_CELLS = 256
BOX = ("lat_lo", "lat_hi", "lon_lo", "lon_hi")


def _box(lat: str = "latitude", lon: str = "longitude") -> list[Column]:
    return [F.min(lat).alias("lat_lo"), F.max(lat).alias("lat_hi"), F.min(lon).alias("lon_lo"), F.max(lon).alias("lon_hi")]


def _gap(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return F.greatest(F.col(low_a) - F.col(high_b), F.col(low_b) - F.col(high_a), F.lit(0.0))


def _span(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return F.greatest(F.col(high_a) - F.col(low_b), F.col(high_b) - F.col(low_a))


def _bounds(west: float, east: float) -> tuple[Column, Column]:
    """(least, greatest) km from any point of the box p_* to any row of the box, less the way east or west
    from the point to the catalogue's edge; rounding is on the safe side.

    With A and B the ways along latitude and longitude, r the way to the edge and B = r + s, the distance
    less r is s + A^2 / (sqrt(A^2 + B^2) + B), which grows with s and A and falls with B.
    """
    scale = F.lit(config.SEARCH_KM_PER_DEGREE)
    left, right = F.col("p_lon_hi") < F.lit(west), F.col("p_lon_lo") > F.lit(east)
    flattest = F.when(F.col("p_lat_lo") > 0, F.col("p_lat_lo")).when(F.col("p_lat_hi") < 0, -F.col("p_lat_hi")).otherwise(F.lit(0.0))
    steepest = F.greatest(F.abs("p_lat_lo"), F.abs("p_lat_hi"))
    lat, lon = ("p_lat_lo", "p_lat_hi", "lat_lo", "lat_hi"), ("p_lon_lo", "p_lon_hi", "lon_lo", "lon_hi")
    narrow, wide = scale * F.abs(F.cos(F.radians(steepest))), scale * F.cos(F.radians(flattest))
    a_low, a_high, b_low, b_high = scale * _gap(*lat), scale * _span(*lat), narrow * _gap(*lon), wide * _span(*lon)
    near = F.when(left, F.col("lon_lo") - F.lit(west)).when(right, F.lit(east) - F.col("lon_hi"))
    far = F.when(left, F.col("lon_hi") - F.lit(west)).when(right, F.lit(east) - F.col("lon_lo"))

    def beyond(a: Column, b: Column) -> Column:
        below = F.hypot(a, b) + b
        return F.when(below > 0, a * a / below).otherwise(F.lit(0.0))

    # the rounding of a distance grows with the distance
    slack = F.lit(1e-9) + b_high * F.lit(1e-12)
    least = F.coalesce(narrow * near + beyond(a_low, b_high), F.hypot(a_low, b_low)) * F.lit(1 - 1e-9) - slack
    most = F.coalesce(wide * far + beyond(a_high, b_low), F.hypot(a_high, b_high)) * F.lit(1 + 1e-9) + slack
    return least, most


def _located(rows: DataFrame) -> DataFrame:
    return rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")


class Quadtree:
    """Nodes of a catalogue: (level, x, y), number of rows, tight box, whether it is divided."""

    def __init__(self, catalog: DataFrame, leaf_rows: int = LEAF_ROWS):
        rows = _located(catalog)
        self.leaf_rows = leaf_rows
        extent = rows.agg(*_box(), F.count(F.lit(1)).alias("n")).first()
        self.rows_total = extent["n"]
        self.south, self.west, self.east = extent["lat_lo"], extent["lon_lo"], extent["lon_hi"]
        # a little wider than the catalogue, so that its last row is inside
        self.side = 0.0 if not self.rows_total else max(extent["lat_hi"] - extent["lat_lo"], extent["lon_hi"] - extent["lon_lo"], 1e-9) * (1 + 1e-9)
        self.catalog = rows
        self.nodes = self._nodes() if self.rows_total else None

    def cell(self, value: Column, low: float, level: int) -> Column:
        return F.least(F.floor((value - F.lit(low)) / F.lit(self.side / (1 << level))), F.lit((1 << level) - 1)).cast("long")

    def _nodes(self) -> DataFrame:
        """All levels down to the first at which every node is a leaf; each level is summed from the rows of divided parents."""
        made: list[DataFrame] = []
        open_rows = self.catalog.select("latitude", "longitude")
        for level in range(MOST_LEVELS + 1):
            x, y = self.cell(F.col("longitude"), self.west, level), self.cell(F.col("latitude"), self.south, level)
            placed = open_rows.withColumn("x", x).withColumn("y", y)
            here = placed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), *_box())
            # rows of one place cannot be divided
            divided = (F.col("n") > self.leaf_rows) & ((F.col("lat_lo") < F.col("lat_hi")) | (F.col("lon_lo") < F.col("lon_hi"))) & F.lit(level < MOST_LEVELS)
            here = materialize(here.select(F.lit(level).alias("level"), "x", "y", "n", *BOX, divided.alias("divided")), "tree-level")
            made.append(here)
            if here.filter("divided").isEmpty():
                break
            open_rows = placed.join(broadcast_if_small(here.filter("divided").select("x", "y")), ["x", "y"], "left_semi").select("latitude", "longitude")
        nodes = made[0]
        for more in made[1:]:
            nodes = nodes.unionAll(more)
        self._levels = made
        return nodes

    def leaf_rows_of(self, leaves: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Catalogue rows with the leaf (level, x, y) they are in, of the given leaves."""
        # a row's cell on the finest level gives its cell on every coarser one
        levels = [r["level"] for r in leaves.select("level").distinct().collect()]  # at most MOST_LEVELS + 1
        cells = F.array(*(F.struct(F.lit(k).alias("level"), self.cell(F.col("longitude"), self.west, k).alias("x"), self.cell(F.col("latitude"), self.south, k).alias("y")) for k in levels))
        rows = self.catalog.select(*keep, F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"), F.inline(cells)) if levels else self.catalog.select(
            *keep, F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")).limit(0)
        return rows.join(broadcast_if_small(leaves.select("level", "x", "y").distinct()), ["level", "x", "y"], "left_semi")

    def close(self) -> None:
        if self.nodes is not None:
            discard(*self._levels)


def _pruned(frontier: DataFrame, k: int, west: float, east: float) -> DataFrame:
    """The nodes of each point box that can hold one of its k nearest rows."""
    least, most = _bounds(west, east)
    own = Window.partitionBy("box")
    measured = frontier.withColumn("least", least).withColumn("most", most)
    held = F.sum("n").over(own.orderBy("most").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # a point box keeps few nodes, so its window is short
    return (measured.withColumn("held", held).withColumn("bound", F.min(F.when(F.col("held") >= k, F.col("most"))).over(own))
            .filter(F.col("bound").isNull() | (F.col("least") <= F.col("bound"))).drop("least", "most", "held", "bound"))


def nearest_rows(points: DataFrame, catalog: DataFrame, k: int = 1, key: str = "event_id", keep: Sequence[str] = ("facility_id",),
                 leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, place, distance_km, *keep): the k nearest catalogue rows of each point, place 1 the nearest.

    ``keep[0]`` numbers the catalogue; of rows at equal distance the smaller number comes first.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    own = Window.partitionBy("latitude", "longitude").orderBy(keep[0])
    first = materialize(_located(catalog).select(*keep, "latitude", "longitude").withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= k), "nearest-catalog")
    places = first.filter("nth = 1").select(F.col(keep[0]).alias("first"), "latitude", "longitude")
    tree = Quadtree(places, leaf_rows)
    placed = _located(points).select(key, "latitude", "longitude")
    if tree.nodes is None:
        return placed.limit(0).select(key, F.lit(1).alias("place"), F.lit(0.0).alias("distance_km"), *(F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in keep))
    width = tree.side / POINT_CELLS
    cell = F.struct(F.floor(F.col("latitude") / F.lit(width)).cast("long").alias("a"), F.floor(F.col("longitude") / F.lit(width)).cast("long").alias("o"))
    boxed = placed.withColumn("box", cell)
    boxes = boxed.groupBy("box").agg(*_box()).select("box", *(F.col(c).alias("p_" + c) for c in BOX))
    root = tree.nodes.filter("level = 0")
    frontier = materialize(_pruned(boxes.crossJoin(F.broadcast(root)), k, tree.west, tree.east), "nearest-frontier")  # the root is one row
    level = 0
    while not frontier.filter("divided").isEmpty():
        level += 1
        children = tree.nodes.filter(F.col("level") == level).withColumn("parent_x", F.shiftright("x", 1)).withColumn("parent_y", F.shiftright("y", 1))
        opened = frontier.filter("divided").select("box", *("p_" + c for c in BOX), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"))
        below = opened.join(broadcast_if_small(children), ["parent_x", "parent_y"]).select(frontier.columns)
        above, frontier = frontier, materialize(_pruned(frontier.filter("NOT divided").unionAll(below), k, tree.west, tree.east), "nearest-frontier")
        discard(above)
    rows = tree.leaf_rows_of(frontier, ["first"])
    candidates = (boxed.join(broadcast_if_small(frontier.select("box", "level", "x", "y")), "box").join(broadcast_if_small(rows), ["level", "x", "y"])
                  .withColumn("distance_km", search_km(F.col("c_lat"), F.col("c_lon"), F.col("latitude"), F.col("longitude"))))
    # the limits on the ranks are applied in the tasks, before the points' rows meet
    nearest = candidates.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("distance_km", "first"))).filter(F.col("place") <= k)
    members = first.select(*keep, F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
    order = Window.partitionBy(key).orderBy("distance_km", keep[0])
    found = (nearest.select(key, "c_lat", "c_lon", "distance_km").join(broadcast_if_small(members), ["c_lat", "c_lon"])
             .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(key, "place", "distance_km", *keep))
    result = materialize(found, "nearest-rows")
    discard(frontier, first)
    tree.close()
    return result

"""Radius joins between places, by cells and an exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.geo import search_km
from emberline.session import broadcast_if_small


def _cell(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side)).cast("long")


def _range(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(_cell(low, side), _cell(high, side)))


def _half_width(latitude: Column, radius_km: float) -> Column:
    return F.lit(radius_km) / (F.lit(config.SEARCH_KM_PER_DEGREE) * F.cos(F.radians(latitude)))


def _around(points: DataFrame, rows: DataFrame, radius_km: float, lat: str, lon: str) -> DataFrame:
    """Rows that share a cell with the box around a point (columns of both, untested)."""
    side = max(radius_km / config.SEARCH_KM_PER_DEGREE, 0.01)
    reach = F.lit(radius_km / config.SEARCH_KM_PER_DEGREE)
    wide = F.least(_half_width(F.col(lat), radius_km), F.lit(360.0))
    copies = (points.withColumn("cell_lat", _range(F.col(lat) - reach, F.col(lat) + reach, side))
              .withColumn("cell_lon", _range(F.col(lon) - wide, F.col(lon) + wide, side)))
    placed = (rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
              .withColumn("cell_lat", _cell(F.col("latitude"), side)).withColumn("cell_lon", _cell(F.col("longitude"), side)))
    return placed.join(broadcast_if_small(copies), ["cell_lat", "cell_lon"]).drop("cell_lat", "cell_lon")


def _as_centres(points: DataFrame, key: str) -> DataFrame:
    return points.select(key, F.col("latitude").alias("centre_lat"), F.col("longitude").alias("centre_lon"))


def radius_box_join(points: DataFrame, rows: DataFrame, radius_km: float = config.BASELINE_RADIUS_KM,
                    key: str = "point_id") -> DataFrame:
    """Rows inside the latitude/longitude box around each point.

    The point side is copied to its cells and broadcast when its checked size
    allows; the large side is then only scanned.
    """
    centre = F.col("centre_lat")
    reach = F.lit(radius_km / config.SEARCH_KM_PER_DEGREE)
    wide = _half_width(centre, radius_km)
    inside = (F.col("latitude").between(centre - reach, centre + reach)
              & F.col("longitude").between(F.col("centre_lon") - wide, F.col("centre_lon") + wide))
    return _around(_as_centres(points, key), rows, radius_km, "centre_lat", "centre_lon").filter(inside)


def radius_circle_join(points: DataFrame, rows: DataFrame, radius_km: float = config.BASELINE_RADIUS_KM,
                       key: str = "point_id") -> DataFrame:
    inside = search_km(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon")) <= F.lit(radius_km)
    return _around(_as_centres(points, key), rows, radius_km, "centre_lat", "centre_lon").filter(inside)


def facilities_nearby(events: DataFrame, facilities: DataFrame, radius_km: float = config.FACILITY_RADIUS_KM,
                      keep: Sequence[str] = ("facility_id", "name", "type")) -> DataFrame:
    """Facilities within the radius of each event centroid, with the distance in km."""
    if not 0.1 <= radius_km <= 100:
        raise ValueError("radius must be 0.1 to 100 km")
    side = max(radius_km / config.SEARCH_KM_PER_DEGREE, 0.01)
    reach = radius_km / config.SEARCH_KM_PER_DEGREE
    # The cosine belongs to the event, which may lie up to the radius further from the equator.
    steep = F.least(F.abs("f_lat") + F.lit(reach), F.lit(89.999))
    wide = F.least(_half_width(steep, radius_km), F.lit(360.0))
    copies = (facilities.select(*keep, F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lon"))
              .withColumn("cell_lat", _range(F.col("f_lat") - F.lit(reach), F.col("f_lat") + F.lit(reach), side))
              .withColumn("cell_lon", _range(F.col("f_lon") - wide, F.col("f_lon") + wide, side)))
    placed = (events.select("event_id", "latitude", "longitude").withColumn("cell_lat", _cell(F.col("latitude"), side))
              .withColumn("cell_lon", _cell(F.col("longitude"), side)))
    km = search_km(F.col("f_lat"), F.col("f_lon"), F.col("latitude"), F.col("longitude"))
    return (placed.join(broadcast_if_small(copies), ["cell_lat", "cell_lon"]).withColumn("distance_km", km)
            .filter(F.col("distance_km") <= F.lit(radius_km)).select("event_id", *keep, "distance_km"))


def local_activity(events: DataFrame, rows: DataFrame, side: float = 0.1) -> DataFrame:
    """Detections in the 3 x 3 block of cells around each event.

    Detections are counted per cell first, so the join carries at most nine counts
    per event, however many detections a cell holds.
    """
    def centred(name: str) -> Column:
        """Cells are centred on multiples of the side."""
        return F.floor(F.col(name) / F.lit(side) + F.lit(0.5)).cast("long")

    counts = (rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
              .groupBy(centred("latitude").alias("cell_lat"), centred("longitude").alias("cell_lon"))
              .agg(F.count(F.lit(1)).alias("n")))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    blocks = (events.select("event_id", centred("latitude").alias("a"), centred("longitude").alias("b"))
              .withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
              .select("event_id", (F.col("a") + F.col("i")).alias("cell_lat"), (F.col("b") + F.col("j")).alias("cell_lon")))
    return (blocks.join(counts, ["cell_lat", "cell_lon"]).groupBy("event_id")
            .agg(F.sum("n").cast("double").alias("historical_activity")))


def context_features(events: DataFrame, rows: DataFrame, facilities: DataFrame,
                     radius_km: float = config.FACILITY_RADIUS_KM) -> DataFrame:
    """historical_activity and facility_distance_km per event; null without a facility in reach."""
    nearest = facilities_nearby(events, facilities, radius_km).groupBy("event_id").agg(
        F.min("distance_km").alias("facility_distance_km"))
    return (events.select("event_id").join(local_activity(events, rows), "event_id", "left")
            .join(nearest, "event_id", "left"))

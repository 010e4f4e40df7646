"""Planar distance columns, cell keys and region boxes."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import config


def linkage_meters(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Planar metres with the cosine of the middle latitude."""
    scale = F.lit(config.METERS_PER_DEGREE)
    middle = F.radians((lat_a + lat_b) / F.lit(2.0))
    return F.hypot(scale * (lat_a - lat_b), scale * F.cos(middle) * (lon_a - lon_b))


def search_km(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column) -> Column:
    """Planar kilometres with the cosine of the centre latitude."""
    scale = F.lit(config.SEARCH_KM_PER_DEGREE)
    d_lat = (lat - centre_lat) * scale
    d_lon = (lon - centre_lon) * scale * F.cos(F.radians(centre_lat))
    return F.sqrt(d_lat * d_lat + d_lon * d_lon)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(F.lit(south), F.lit(north)) & lon.between(F.lit(west), F.lit(east))


def in_region(lat: Column, lon: Column) -> Column:
    return in_box(lat, lon, config.REGION_MIN_LAT, config.REGION_MAX_LAT,
                  config.REGION_MIN_LON, config.REGION_MAX_LON)


class Area(NamedTuple):
    west: float
    south: float
    east: float
    north: float


def parse_area(text: str) -> Area | None:
    """``world`` gives no bound, ``IND`` the region box, else ``west,south,east,north``."""
    name = text.strip()
    if name.lower() == "world":
        return None
    if name.upper() == "IND":
        return Area(config.REGION_MIN_LON, config.REGION_MIN_LAT, config.REGION_MAX_LON, config.REGION_MAX_LAT)
    try:
        area = Area(*(float(part) for part in name.split(",")))
    except (TypeError, ValueError) as error:
        raise ValueError("area must be 'world', 'IND' or west,south,east,north") from error
    if not (-180 <= area.west < area.east <= 180 and -90 <= area.south < area.north <= 90):
        raise ValueError("area must be 'world', 'IND' or west,south,east,north")
    return area


def nearest_edge_cosine(index: Column, height: float) -> Column:
    """Largest cosine inside latitude band ``index`` of ``height`` degrees."""
    edge = F.when(index >= 0, index * F.lit(height)).otherwise(-(index + F.lit(1)) * F.lit(height))
    return F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-9))


def floor_long(value: Column) -> Column:
    return F.floor(value).cast("long")


def whole_degrees_half_width(radius_km: float) -> float:
    return radius_km / config.SEARCH_KM_PER_DEGREE


def cell_side_degrees(distance_meters: float) -> float:
    """Side of a cell whose diagonal stays just below the linkage distance."""
    return distance_meters / math.sqrt(2.0) / config.METERS_PER_DEGREE * (1.0 - 1e-6)

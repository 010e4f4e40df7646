"""Place names from a small catalog of known hubs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import config
from emberline.functions.numeric import display_round

# Reference places (name, state, latitude, longitude).
HUBS = (
    ("Surat / Hazira Industrial Belt", "Gujarat", 21.1702, 72.8311),
    ("Ahmedabad Industrial Area", "Gujarat", 23.0225, 72.5714),
    ("Vadodara Petrochemical Hub", "Gujarat", 22.3072, 73.1812),
    ("Jamnagar Refinery Hub", "Gujarat", 22.4707, 70.0577),
    ("Bharuch / Ankleshwar Chemical Zone", "Gujarat", 21.7051, 72.9959),
    ("Kutch / Kandla Port Zone", "Gujarat", 23.0753, 70.1337),
    ("Rajkot Engineering Belt", "Gujarat", 22.3039, 70.8022),
    ("Bhavnagar / Alang Belt", "Gujarat", 21.7645, 72.1519),
    ("Mumbai / Thane Industrial Region", "Maharashtra", 19.0760, 72.8777),
    ("Nagpur Industrial Corridor", "Maharashtra", 21.1458, 79.0882),
    ("Chandrapur Thermal / Mining Hub", "Maharashtra", 19.9615, 79.2961),
    ("Pune / Chakan Automobile Hub", "Maharashtra", 18.5204, 73.8567),
    ("Nashik Industrial Zone", "Maharashtra", 19.9975, 73.7898),
    ("Aurangabad / Jalna Steel Cluster", "Maharashtra", 19.8762, 75.3433),
    ("Solapur Region", "Maharashtra", 17.6599, 75.9064),
    ("Tarapur Atomic / Chemical Zone", "Maharashtra", 19.8500, 72.7000),
    ("Raipur / Bhilai Steel Complex", "Chhattisgarh", 21.2514, 81.6296),
    ("Korba Coal & Power Basin", "Chhattisgarh", 22.3595, 82.7501),
    ("Raigarh Steel / Power Hub", "Chhattisgarh", 21.8974, 83.3950),
    ("Bilaspur Mining Belt", "Chhattisgarh", 22.0797, 82.1409),
    ("Rourkela Steel Basin", "Odisha", 22.2604, 84.8536),
    ("Angul / Talcher Energy Hub", "Odisha", 20.8400, 85.1500),
    ("Jharsuguda Industrial Corridor", "Odisha", 21.8550, 84.0080),
    ("Paradeep Port / Petrochemical Zone", "Odisha", 20.3167, 86.6111),
    ("Bhubaneswar / Cuttack Belt", "Odisha", 20.2961, 85.8245),
    ("Jajpur / Kalinganagar Steel City", "Odisha", 20.9500, 85.9000),
    ("Jamshedpur Steel Hub", "Jharkhand", 22.8046, 86.2029),
    ("Bokaro Steel City", "Jharkhand", 23.6693, 86.1511),
    ("Dhanbad / Jharia Coalfields", "Jharkhand", 23.7957, 86.4304),
    ("Ranchi Industrial Area", "Jharkhand", 23.3441, 85.3096),
    ("Durgapur / Asansol Industrial Belt", "West Bengal", 23.5204, 87.3119),
    ("Kolkata / Howrah Manufacturing Hub", "West Bengal", 22.5726, 88.3639),
    ("Haldia Petrochemical Complex", "West Bengal", 22.0667, 88.0698),
    ("Siliguri Corridor", "West Bengal", 26.7271, 88.3953),
    ("Singrauli / Waidhan Power Hub", "Madhya Pradesh", 24.2000, 82.6600),
    ("Bhopal / Mandideep Industrial Area", "Madhya Pradesh", 23.2599, 77.4126),
    ("Indore / Pithampur Auto Hub", "Madhya Pradesh", 22.7196, 75.8577),
    ("Gwalior Industrial Area", "Madhya Pradesh", 26.2183, 78.1828),
    ("Jabalpur / Katni Mineral Belt", "Madhya Pradesh", 23.1815, 79.9864),
    ("Kota Industrial Complex", "Rajasthan", 25.2138, 75.8648),
    ("Jaipur Industrial Area", "Rajasthan", 26.9124, 75.7873),
    ("Jodhpur Region", "Rajasthan", 26.2389, 73.0243),
    ("Bhilwara Textile / Mineral Belt", "Rajasthan", 25.3475, 74.6408),
    ("Bhiwadi / Alwar Industrial Area", "Rajasthan", 28.2100, 76.8600),
    ("Delhi / NCR Industrial Region", "Delhi / Haryana", 28.6139, 77.2090),
    ("Gurugram / Manesar Auto Corridor", "Haryana", 28.4595, 77.0266),
    ("Faridabad Industrial Hub", "Haryana", 28.4089, 77.3178),
    ("Panipat Refinery / Textile Belt", "Haryana", 29.3909, 76.9635),
    ("Ludhiana Industrial City", "Punjab", 30.9010, 75.8573),
    ("Bathinda Refinery & Power Hub", "Punjab", 30.2110, 74.9455),
    ("Amritsar Region", "Punjab", 31.6340, 74.8723),
    ("Kanpur Industrial City", "Uttar Pradesh", 26.4499, 80.3319),
    ("Lucknow Region", "Uttar Pradesh", 26.8467, 80.9462),
    ("Varanasi / Mughalsarai Hub", "Uttar Pradesh", 25.3176, 82.9739),
    ("Agra / Mathura Refinery Zone", "Uttar Pradesh", 27.1767, 78.0081),
    ("Noida / Greater Noida Tech Hub", "Uttar Pradesh", 28.5355, 77.3910),
    ("Patna Region", "Bihar", 25.5941, 85.1376),
    ("Barauni / Begusarai Industrial Area", "Bihar", 25.4200, 85.9800),
    ("Visakhapatnam Steel & Port City", "Andhra Pradesh", 17.6868, 83.2185),
    ("Vijayawada / Guntur Corridor", "Andhra Pradesh", 16.5062, 80.6480),
    ("Hyderabad / Cyberabad Corridor", "Telangana", 17.3850, 78.4867),
    ("Ramagundam Thermal Power Hub", "Telangana", 18.8000, 79.4500),
    ("Bengaluru Tech / Aerospace Hub", "Karnataka", 12.9716, 77.5946),
    ("Bellary / Toranagallu Steel Belt", "Karnataka", 15.1394, 76.9214),
    ("Mangaluru Petrochemical / Port Zone", "Karnataka", 12.9141, 74.8560),
    ("Chennai / Ennore Industrial Corridor", "Tamil Nadu", 13.0827, 80.2707),
    ("Coimbatore Engineering Cluster", "Tamil Nadu", 11.0168, 76.9558),
    ("Tuticorin Port / Thermal Hub", "Tamil Nadu", 8.7642, 78.1348),
    ("Kochi Industrial & Port Area", "Kerala", 9.9312, 76.2673),
    ("Guwahati Industrial Corridor", "Assam", 26.1445, 91.7362),
    ("Digboi / Tinsukia Oil & Gas Basin", "Assam", 27.3800, 95.6300),
)

# Distances in km up to which a place or its region is named.
PLACE_KM = 75.0
REGION_KM = 180.0
MAX_CATALOG = 5000


def nearest_hub(lat: Column, lon: Column, catalog: Sequence[tuple[str, str, float, float]] = HUBS) -> Column:
    """struct(km, position, name, state) of the nearest catalog row; the first wins ties.

    The catalog is a literal of at most ``MAX_CATALOG`` rows, so each detection is
    named where it stands: no join, no shuffle.
    """
    if not 0 < len(catalog) <= MAX_CATALOG:
        raise ValueError(f"catalog must have 1 to {MAX_CATALOG} rows; join larger ones by radius")
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(s).alias("state"),
                              F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon"))
                     for i, (n, s, a, o) in enumerate(catalog)))
    scale = F.lit(config.SEARCH_KM_PER_DEGREE)
    shrink = F.cos(F.radians(lat))

    def measured(hub: Column) -> Column:
        d_lat = (lat - hub["lat"]) * scale
        d_lon = (lon - hub["lon"]) * scale * shrink
        return F.struct(F.sqrt(d_lat * d_lat + d_lon * d_lon).alias("km"), hub["position"].alias("position"),
                        hub["name"].alias("name"), hub["state"].alias("state"))

    return F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(F.transform(rows, measured)))


def coordinate_label(lat: Column, lon: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f° N, %.{digits}f° E", display_round(lat, digits), display_round(lon, digits))


def location_name(lat: Column, lon: Column, hub: Column) -> Column:
    """Text for a point and its ``nearest_hub`` struct."""
    return (F.when(lat.isNull() | lon.isNull(), F.lit("Unknown coordinates"))
            .when(hub["km"] <= F.lit(PLACE_KM), F.concat(hub["name"], F.lit(", "), hub["state"]))
            .when(hub["km"] <= F.lit(REGION_KM),
                  F.concat(hub["state"], F.lit(" Region (~"), hub["km"].cast("long").cast("string"),
                           F.lit(" km from "), hub["name"], F.lit(")")))
            .otherwise(F.concat(hub["state"], F.lit(" Sector ("), coordinate_label(lat, lon, 2), F.lit(")"))))


def place_label(name: Column, lat: Column, lon: Column) -> Column:
    """The location name, or the coordinates where there is none."""
    return F.coalesce(F.when(name != F.lit(""), name), coordinate_label(lat, lon, 3))

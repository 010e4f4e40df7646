"""Default parameters and fixed vocabularies."""

# Parameter defaults.
CLUSTER_DISTANCE_METERS = 1000.0
CLUSTER_TIME_HOURS = 72.0
PERSISTENCE_MIN_DETECTIONS = 3
RESOLVED_AFTER_HOURS = 72
PERSISTENT_MIN_DAYS = 2
BASELINE_RADIUS_KM = 50.0
FACILITY_RADIUS_KM = 5.0
PAGE_SIZE = 50
MAX_PAGE_SIZE = 100
HOTSPOT_LIMIT = 100
MAX_HOTSPOT_LIMIT = 1000
LIST_PAGE_SIZE = 36

# Region box, degrees.
REGION_MIN_LAT = 6.5
REGION_MAX_LAT = 35.5
REGION_MIN_LON = 68.0
REGION_MAX_LON = 97.5

# Planar degree lengths. Clustering and feature spread use 111.2 km
# per degree, radius searches and place naming use 111 km.
METERS_PER_DEGREE = 111200.0
SEARCH_KM_PER_DEGREE = 111.0

# Vocabularies.
EVENT_STATUSES = ("ACTIVE", "PERSISTENT", "RESOLVED", "UNKNOWN")
FACILITY_TYPES = ("power_plant", "factory", "refinery", "landmark", "other")
RULE_CLASSES = (
    "INDUSTRIAL_THERMAL_SOURCE",
    "PERSISTENT_THERMAL_SOURCE",
    "AGRICULTURAL_BURNING",
    "OTHER",
)
ALLOWED_LABELS = (
    "industrial_thermal_source",
    "persistent_thermal_source",
    "industrial_fire",
    "agricultural_burning",
    "natural_thermal_source",
    "temporary_thermal_event",
)
SUFFICIENT = "SUFFICIENT_HISTORY"
INSUFFICIENT = "INSUFFICIENT_HISTORY"
NO_HISTORY = "NO_HISTORY"

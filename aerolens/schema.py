"""Telemetry data model: column names, types and fixed values.

The values in the FIXED VALUES block must equal the reference application's
for results to match (names of reasons, default thresholds, orders).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour)
# ---------------------------------------------------------------------------
REQUIRED_COLUMNS = (
    "profile", "replicate", "case_id", "case_name", "row_idx",
    "label", "tamper_type", "timestamp",
    "latitude", "longitude", "altitude", "speed", "heading",
    "source", "original_row_idx",
)
PROFILES = ("subtle", "balanced", "strong")

# L1 default thresholds and reason order
DEFAULT_THRESHOLDS = {
    "altitude_min": -5.0,
    "altitude_max": 500.0,
    "speed_max": 30.0,
    "heading_min": 0.0,
    "heading_max": 360.0,
    "latitude_min": -90.0,
    "latitude_max": 90.0,
    "longitude_min": -180.0,
    "longitude_max": 180.0,
}

# L2 default configuration, channel order and reason names
DEFAULT_STAT_CONFIG = {
    "window": 30,
    "z_threshold": 3.5,
    "min_std": 0.05,
    "freeze_window": 6,
    "freeze_speed_std": 0.05,
    "freeze_heading_std": 0.3,
    "freeze_gps_std": 1e-6,
}
L2_CHANNELS = ("altitude", "speed", "heading", "gps_step")
FREEZE_REASON = "freeze_detected"

# L3 feature names in model order
FEATURE_NAMES = (
    "alt_mean", "alt_std", "alt_range", "alt_slope",
    "spd_mean", "spd_std", "spd_range", "spd_slope",
    "hdg_diff_mean", "hdg_diff_std", "hdg_diff_abs_max",
    "gps_step_mean", "gps_step_std", "gps_step_max",
    "speed_vs_gps",
    "dt_mean", "dt_std", "dt_max", "dt_min",
    "sample_var_score",
)
DEFAULT_FEATURE_WINDOW = 8

EARTH_RADIUS_M = 6_371_000.0
REASON_SEP = "|"

# layer alert columns, stream layer names, report names
LAYER_COLUMNS = {
    "alert_threshold": "rules",
    "alert_change": "statistical",
    "alert_ml": "ml",
}
VALID_LAYERS = ("rules", "statistical", "ml")

# injection shifts (labelled tampering)
INJECTION_TYPES = ("altitude_spike", "speed_inconsistency",
                   "heading_inconsistency", "coordinate_jump")
INJECT_ALTITUDE_M = 60.0
INJECT_SPEED_MS = 12.0
INJECT_HEADING_DEG = 120.0
INJECT_COORD_DEG = 0.002

# ML defaults
SUPPORTED_ALGOS = ("isolation_forest", "one_class_svm", "lof",
                   "random_forest", "xgboost")
UNSUPERVISED = ("isolation_forest", "one_class_svm", "lof")
SUPERVISED = ("random_forest", "xgboost")
DEFAULT_MAX_TRAIN_SAMPLES = {
    "one_class_svm": 50_000,
    "lof": 50_000,
    "isolation_forest": None,
    "random_forest": None,
    "xgboost": None,
}
F1_EPS = 1e-12
# ---------------------------------------------------------------------------

# Flight identity.  ("replicate", "case_id") is the default; ("case_id",) is
# the single-key parity mode.  ``_ord`` is the ingest ordinal (tie-break).
DEFAULT_FLIGHT_KEYS = ("replicate", "case_id")
ORDER_COLUMNS = ("row_idx", "_ord")

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("profile", T.StringType()),
    T.StructField("replicate", T.IntegerType()),
    T.StructField("case_id", T.LongType()),
    T.StructField("case_name", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("tamper_type", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("heading", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("original_row_idx", T.LongType()),
])


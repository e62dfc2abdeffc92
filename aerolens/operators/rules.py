"""L1: physical-range rules.

Ten range predicates, each NULL-safe (a missing value is no violation),
OR-folded into ``alert_threshold``; the names of the violated rules, in
fixed order and pipe-separated, go to ``alert_reasons`` ('' if none).
Pure column expressions: no shuffle, fused into the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.functions.text import any_true, join_reasons, null_to_false
from aerolens.schema import DEFAULT_THRESHOLDS


def rule_flags(thresholds: dict | None = None) -> list[tuple[Column, str]]:
    """(predicate, reason) pairs in reason order.

    A user ``thresholds`` dict replaces the defaults (no merge), like the
    reference; a missing key raises ``KeyError``.
    """
    t = DEFAULT_THRESHOLDS if thresholds is None else thresholds
    alt, spd, hdg = F.col("altitude"), F.col("speed"), F.col("heading")
    lat, lon = F.col("latitude"), F.col("longitude")
    lit = lambda x: F.lit(float(x))
    checks = [
        (alt < lit(t["altitude_min"]), "altitude_below_min"),
        (alt > lit(t["altitude_max"]), "altitude_above_max"),
        (spd < lit(0.0), "speed_negative"),
        (spd > lit(t["speed_max"]), "speed_above_max"),
        (hdg < lit(t["heading_min"]), "heading_below_min"),
        (hdg >= lit(t["heading_max"]), "heading_above_max"),
        (lat < lit(t["latitude_min"]), "latitude_below_min"),
        (lat > lit(t["latitude_max"]), "latitude_above_max"),
        (lon < lit(t["longitude_min"]), "longitude_below_min"),
        (lon > lit(t["longitude_max"]), "longitude_above_max"),
    ]
    return [(null_to_false(p), name) for p, name in checks]


def detect_threshold_violations(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Add ``alert_threshold`` BOOLEAN and ``alert_reasons`` STRING."""
    flags = rule_flags(thresholds)
    return df.withColumns({
        "alert_threshold": any_true([f for f, _ in flags]),
        "alert_reasons": join_reasons(flags),
    })

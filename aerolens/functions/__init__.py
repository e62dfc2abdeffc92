"""Column-expression building blocks (JVM-side, codegen-friendly)."""

from aerolens.functions.geo import circular_diff, haversine_m, wrap_heading_delta
from aerolens.functions.rolling import rolling, rolling_frame, ROLLING_OPS
from aerolens.functions.text import join_reasons, null_to_false, nan_to_null

__all__ = [
    "circular_diff", "haversine_m", "wrap_heading_delta",
    "rolling", "rolling_frame", "ROLLING_OPS",
    "join_reasons", "null_to_false", "nan_to_null",
]

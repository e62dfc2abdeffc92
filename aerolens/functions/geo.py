"""Geometry expressions: circular heading difference and haversine step."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aerolens.schema import EARTH_RADIUS_M


def wrap_heading_delta(delta: Column) -> Column:
    """Map an angle difference into [-180, 180) with a floored modulo.

    ``%`` truncates in Spark, so ``pmod`` is used (a NULL stays NULL).
    """
    return F.pmod(delta + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def circular_diff(heading: Column, prev_heading: Column) -> Column:
    """Circular first difference of a heading in degrees."""
    return wrap_heading_delta(heading - prev_heading)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two points (degrees).

    a = sin^2(dphi/2) + cos(phi1) cos(phi2) sin^2(dlambda/2)
    d = 2 R asin(sqrt(a)), R = 6,371,000 m.  NULL if any input is NULL.
    """
    p1 = F.radians(lat1)
    p2 = F.radians(lat2)
    dphi = p2 - p1
    dlam = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2.0), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlam / 2.0), 2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))

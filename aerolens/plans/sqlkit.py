"""Small SQL text helpers for the DuckDB oracle queries.

The oracle side is plain SQL text over the driver's pre-registered views;
these helpers only keep repeated expressions (view, floored modulo,
haversine, rolling-with-min-periods) identical across queries.
"""

from __future__ import annotations

from aerolens.sources.events_view import EVENTS_VIEW_SQL


def with_view(body: str, extra_ctes: str = "") -> str:
    ctes = f"t as ({EVENTS_VIEW_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"with {ctes}\n{body}"


def pmod(x: str, n: str = "360") -> str:
    """Spark's pmod: r = x % n; r < 0 -> (r + n) % n."""
    return f"(case when ({x}) % {n} < 0 then (({x}) % {n} + {n}) % {n} else ({x}) % {n} end)"


def circ(h: str, ph: str) -> str:
    return f"({pmod(f'({h}) - ({ph}) + cast(180 as double)')} - cast(180 as double))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    p1, p2 = f"radians({lat1})", f"radians({lat2})"
    return (f"(cast(12742000.0 as double) * asin(sqrt(pow(sin(({p2} - {p1}) / 2), 2) + "
            f"cos({p1}) * cos({p2}) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))")


def roll(op: str, x: str, w: str, m: int) -> str:
    agg = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}[op]
    return f"(case when count({x}) over {w} >= {m} then {agg}({x}) over {w} end)"


def r6(x: str) -> str:
    """Half-up rounding to 6 decimals with plain IEEE steps (same in both engines)."""
    return f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"


BASE_CTE = """b as (
  select *,
    altitude - lag(altitude) over w as d_alt,
    speed - lag(speed) over w as d_spd,
    {dh} as d_hdg,
    {gps} as gps,
    t_us - lag(t_us) over w as dt_us,
    (t_us - lag(t_us) over w) / cast(1000000.0 as double) as dt_raw
  from t window w as (partition by replicate, case_id order by row_idx, _ord)
)""".format(
    dh=circ("heading", "lag(heading) over w"),
    gps=haversine("lag(latitude) over w", "lag(longitude) over w", "latitude", "longitude"),
)

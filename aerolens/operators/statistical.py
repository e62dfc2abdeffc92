"""L2: rolling z-score of per-flight changes and freeze detection.

d = first difference of altitude and speed, circular difference of heading,
and the haversine step itself; z = (d - mean_n) / max(std_n, min_std) over
the last n rows (n = 30, min periods 15).  Freeze = std_6(speed) < 0.05 and
std_6(raw heading) < 0.3 and std_6(gps_step) < 1e-6.

Everything is built on one window spec (see ``frames``): one Exchange on
the flight keys plus one Sort, whatever the number of channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aerolens.functions.geo import circular_diff, haversine_m
from aerolens.functions.rolling import RollingSet, default_min_periods
from aerolens.functions.text import any_true, join_reasons, null_to_false
from aerolens.operators import frames
from aerolens.schema import DEFAULT_FLIGHT_KEYS, DEFAULT_STAT_CONFIG, FREEZE_REASON, L2_CHANNELS

BASE_COLUMNS = ("_d_altitude", "_d_speed", "_d_heading", "_gps_step", "_dt_us", "_dt_raw")


def with_base_deltas(df: DataFrame, layout: frames.FlightLayout) -> DataFrame:
    """Per-flight first differences, haversine step and time step.

    ``_dt_us`` is the exact step in microseconds, ``_dt_raw`` the same in
    seconds (zeros kept); all lags in one projection.
    """
    if "_gps_step" in df.columns:
        return df
    w = layout.window()
    lag = lambda c: F.lag(F.col(c)).over(w)
    t_us = F.unix_micros(F.col("timestamp"))
    dt_us = t_us - F.lag(t_us).over(w)
    return df.withColumns({
        "_d_altitude": F.col("altitude") - lag("altitude"),
        "_d_speed": F.col("speed") - lag("speed"),
        "_d_heading": circular_diff(F.col("heading"), lag("heading")),
        "_gps_step": haversine_m(lag("latitude"), lag("longitude"),
                                 F.col("latitude"), F.col("longitude")),
        "_dt_us": dt_us,
        "_dt_raw": dt_us / F.lit(1e6),
    })


def add_change_columns(df: DataFrame, layout: frames.FlightLayout,
                       config: dict | None = None) -> DataFrame:
    """L2 over a frame that already has base deltas (one Window node)."""
    cfg = DEFAULT_STAT_CONFIG if config is None else config
    rs = RollingSet(layout.window(), "_l2")
    n = int(cfg["window"])
    min_std = float(cfg["min_std"])
    th = float(cfg["z_threshold"])
    deltas = {"altitude": "_d_altitude", "speed": "_d_speed", "heading": "_d_heading",
              "gps_step": "_gps_step"}
    out = {}
    flags = []
    for ch in L2_CHANNELS:
        src = deltas[ch]
        mean = rs.rolling(src, n, "mean")
        std = rs.rolling(src, n, "std")
        z = F.when(std.isNotNull(), (F.col(src) - mean) / F.greatest(std, F.lit(min_std)))
        out[f"z_{ch}"] = z
    fw = int(cfg["freeze_window"])
    fm = default_min_periods(fw)
    freeze = null_to_false(
        (rs.rolling("speed", fw, "std", fm) < F.lit(float(cfg["freeze_speed_std"])))
        & (rs.rolling("heading", fw, "std", fm) < F.lit(float(cfg["freeze_heading_std"])))
        & (rs.rolling("_gps_step", fw, "std", fm) < F.lit(float(cfg["freeze_gps_std"]))))
    df = df.withColumns(rs.columns())
    df = df.withColumns(out).withColumn("_freeze", freeze)
    for ch in L2_CHANNELS:
        flags.append((null_to_false(F.abs(F.col(f"z_{ch}")) > F.lit(th)), f"sudden_{ch}"))
    flags.append((F.col("_freeze"), FREEZE_REASON))
    df = df.withColumns({"alert_change": any_true([f for f, _ in flags]),
                         "change_reasons": join_reasons(flags)})
    return df.drop(*rs.names(), "_freeze")


def required_halo(config: dict | None = None, feature_window: int = 0) -> int:
    cfg = DEFAULT_STAT_CONFIG if config is None else config
    return max(int(cfg["window"]), int(cfg["freeze_window"]), int(feature_window)) + 1


def detect_sudden_changes(df: DataFrame, config: dict | None = None,
                          flight_keys=DEFAULT_FLIGHT_KEYS,
                          hot_rows: int | None = frames.HOT_ROWS,
                          chunk_rows: int = frames.CHUNK_ROWS) -> DataFrame:
    """Add z_altitude, z_speed, z_heading, z_gps_step, alert_change, change_reasons."""
    cfg = DEFAULT_STAT_CONFIG if config is None else config
    staged, layout = frames.stage(df, flight_keys, halo=required_halo(cfg),
                                  hot_rows=hot_rows, chunk_rows=chunk_rows)
    out = add_change_columns(with_base_deltas(staged, layout), layout, cfg)
    return frames.unstage(out, layout).drop(*BASE_COLUMNS)

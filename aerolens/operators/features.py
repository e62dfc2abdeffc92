"""L3 window features (W5, W10-W16): 20 DOUBLE columns per sample.

Window n (default 8) rows, min periods max(2, n // 2).  Missing values are
filled afterwards:

* ``fill="backfill"`` (batch default): next non-missing value of the same
  flight, then 0.  Linear: a growing frame over the descending order (one
  extra Sort in the same partitions, no extra Exchange).  For split hot
  flights a per-chunk carry (first value of each later chunk) finishes the
  fill across chunk borders.
* ``fill="causal"``: 0 (no look-ahead), the value a stream can know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aerolens.functions.rolling import RollingSet
from aerolens.operators import frames
from aerolens.operators.statistical import BASE_COLUMNS, with_base_deltas
from aerolens.schema import DEFAULT_FEATURE_WINDOW, DEFAULT_FLIGHT_KEYS, FEATURE_NAMES, ORDER_COLUMNS

FILL_MODES = ("backfill", "causal", "none")


def add_feature_columns(df: DataFrame, layout: frames.FlightLayout,
                        window: int = DEFAULT_FEATURE_WINDOW) -> DataFrame:
    """Raw (unfilled) features over a frame with base deltas.

    Derived inputs are materialised first so every rolling aggregate is a
    shared, named window column (one count per input column).
    """
    w = layout.window()
    n = int(window)
    m = max(2, n // 2)
    df = df.withColumns({
        "_abs_d_heading": F.abs(F.col("_d_heading")),
        "_spd_gps": F.abs(F.col("speed") - F.col("_gps_step") / F.nullif(F.col("_dt_raw"), F.lit(0.0))),
    })
    rs = RollingSet(w, "_f")
    r = lambda c, op: rs.rolling(c, n, op, m)
    out = {}
    for src, p in (("altitude", "alt"), ("speed", "spd")):
        out[f"{p}_mean"] = r(src, "mean")
        out[f"{p}_std"] = r(src, "std")
        out[f"{p}_range"] = r(src, "max") - r(src, "min")
    out["hdg_diff_mean"] = r("_d_heading", "mean")
    out["hdg_diff_std"] = r("_d_heading", "std")
    out["hdg_diff_abs_max"] = r("_abs_d_heading", "max")
    out["gps_step_mean"] = r("_gps_step", "mean")
    out["gps_step_std"] = r("_gps_step", "std")
    out["gps_step_max"] = r("_gps_step", "max")
    out["speed_vs_gps"] = r("_spd_gps", "mean")
    # mean of whole microseconds: exact integer sum, one rounding
    cnt = rs.agg("_dt_us", n, "count")
    out["dt_mean"] = F.when(cnt >= F.lit(m), rs.agg("_dt_us", n, "sum") / cnt / F.lit(1e6))
    out["dt_std"] = r("_dt_raw", "std")
    out["dt_max"] = r("_dt_raw", "max")
    out["dt_min"] = r("_dt_raw", "min")
    lags = {f"{p}_slope": (F.col(src) - F.lag(F.col(src), n - 1).over(w)) / F.lit(float(n))
            for src, p in (("altitude", "alt"), ("speed", "spd"))}
    df = df.withColumns({**rs.columns(), **lags})
    return df.withColumns(out).drop(*rs.names(), "_abs_d_heading", "_spd_gps")


def _with_sample_var(df: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn("sample_var_score",
                         z("alt_std") + z("spd_std") + z("hdg_diff_std") + z("gps_step_std"))


def fill_features(df: DataFrame, layout: frames.FlightLayout, fill: str,
                  names=FEATURE_NAMES) -> DataFrame:
    if fill not in FILL_MODES:
        raise ValueError(f"Unknown fill mode: {fill}")
    if fill == "none":
        return df
    if fill == "causal":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
    wd = layout.window_desc().rowsBetween(Window.unboundedPreceding, 0)
    nxt = {c: F.last(F.col(c), ignorenulls=True).over(wd) for c in names}
    if not layout.split:
        return df.withColumns({c: F.coalesce(nxt[c], F.lit(0.0)) for c in names})
    # split hot flights: first real value of every chunk, carried backwards
    df = df.withColumns({f"_nx_{c}": nxt[c] for c in names})
    keys = list(layout.keys)
    ordk = F.struct(*[F.col(c) for c in ORDER_COLUMNS])
    real = ~F.col(frames.HALO)
    firsts = df.groupBy(*keys, frames.CHUNK).agg(*[
        F.min_by(F.col(c), F.when(real & F.col(c).isNotNull(), ordk)).alias(f"_f_{c}")
        for c in names])
    wc = (Window.partitionBy(*keys).orderBy(F.col(frames.CHUNK).desc())
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = firsts.select(
        *[F.col(k).alias("_c_" + k) for k in keys],
        F.col(frames.CHUNK).alias("_c_chunk"),
        *[F.last(F.col(f"_f_{c}"), ignorenulls=True).over(wc).alias(f"_cy_{c}") for c in names])
    cond = [F.col(k).eqNullSafe(F.col("_c_" + k)) for k in keys] + \
        [F.col(frames.CHUNK) == F.col("_c_chunk")]
    df = df.join(carry, cond, "left")
    filled = {c: F.coalesce(F.col(f"_nx_{c}"), F.col(f"_cy_{c}"), F.lit(0.0)) for c in names}
    drop = [f"_nx_{c}" for c in names] + [f"_cy_{c}" for c in names] + \
        ["_c_" + k for k in keys] + ["_c_chunk"]
    return df.withColumns(filled).drop(*drop)


def add_features(staged: DataFrame, layout: frames.FlightLayout,
                 window: int = DEFAULT_FEATURE_WINDOW, fill: str = "backfill") -> DataFrame:
    df = add_feature_columns(with_base_deltas(staged, layout), layout, window)
    df = _with_sample_var(df)
    df = fill_features(df, layout, fill)
    # canonical order: input columns, then the features in model order
    return df.select(*[c for c in df.columns if c not in FEATURE_NAMES], *FEATURE_NAMES)


def compute_features(df: DataFrame, window: int = DEFAULT_FEATURE_WINDOW,
                     flight_keys=DEFAULT_FLIGHT_KEYS, fill: str = "backfill",
                     hot_rows: int | None = frames.HOT_ROWS,
                     chunk_rows: int = frames.CHUNK_ROWS) -> DataFrame:
    """Input columns + the 20 features (order ``FEATURE_NAMES``)."""
    staged, layout = frames.stage(df, flight_keys, halo=int(window) + 1,
                                  hot_rows=hot_rows, chunk_rows=chunk_rows)
    out = add_features(staged, layout, window, fill)
    return frames.unstage(out, layout).drop(*BASE_COLUMNS)


__all__ = ["compute_features", "add_features", "feature_columns", "fill_features",
           "required_halo", "FILL_MODES"]

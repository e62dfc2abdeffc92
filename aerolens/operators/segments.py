"""Anomaly / alert segments per flight (W1, W17, W18) and case timeline.

Gaps and islands over the flight order (t_rel, row_idx, _ord):

* a new group starts at the first row, at a row with label 0, and where the
  type differs from the previous row (a missing type always differs);
* a group holds at most one segment: from its first label-1 row to the
  ``t_rel`` of the first row after the group (the last row's own ``t_rel``
  when the flight ends inside it);
* consecutive segments of the same type merge when start - previous end <=
  ``merge_gap``; merged segments shorter than ``min_duration`` are dropped.

Only lag/lead and running sums are windowed (split flights get one halo row
on each side and a carried running sum); the per-group reductions are plain
keyed aggregates with partial aggregation, so a long run or a large flight
never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.operators import frames
from aerolens.schema import DEFAULT_FLIGHT_KEYS

SEG_ORDER = ("t_rel", "row_idx", "_ord")
# seconds per numbering bucket for hot flights ordered by t_rel
SEG_BUCKET_SECONDS = 86_400.0


def with_t_rel(df: DataFrame, flight_keys=DEFAULT_FLIGHT_KEYS) -> DataFrame:
    """Seconds since the first timestamp of the flight.

    Flight minimum by a keyed aggregate joined back (AQE broadcasts it when
    small and splits skewed join partitions), never a whole-flight window.
    """
    keys = list(flight_keys)
    t = F.unix_micros(F.col("timestamp"))
    first = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    first = first.select(*[F.col(k).alias("_f_" + k) for k in keys], "_t0")
    cond = [F.col(k).eqNullSafe(F.col("_f_" + k)) for k in keys]
    out = df.join(first, cond, "left")
    return (out.withColumn("t_rel", (t - F.col("_t0")) / F.lit(1e6))
               .drop("_t0", *["_f_" + k for k in keys]))


def _islands(df: DataFrame, keys, is1: Column, is0: Column, typ: Column,
             hot_rows, chunk_rows) -> DataFrame:
    """Raw segments (keys, _grp, start, end, type) before merging."""
    d = df.select(*keys, *[c for c in SEG_ORDER], is1.alias("_is1"), is0.alias("_is0"),
                  typ.alias("_type"))
    staged, lay = frames.stage(d, keys, halo=1, halo_after=1, hot_rows=hot_rows,
                               chunk_rows=chunk_rows, bucket_span=SEG_BUCKET_SECONDS,
                               order=SEG_ORDER)
    w = lay.window()
    same = F.coalesce(F.col("_type") == F.lag("_type").over(w), F.lit(False))
    reset = (F.col("_is0") | ~same).cast("int")
    staged = staged.withColumn("_next", F.lead("t_rel").over(w)).withColumn("_reset", reset)
    staged = frames.with_running_sum(staged, lay, F.col("_reset"), "_grp")
    rows = frames.unstage(staged, lay)
    seg = rows.groupBy(*keys, "_grp").agg(
        F.min(F.when(F.col("_is1"), F.col("t_rel"))).alias("start"),
        F.max(F.coalesce(F.col("_next"), F.col("t_rel"))).alias("end"),
        F.max("_type").alias("type"),
        F.max(F.col("_is1").cast("int")).alias("_has1"))
    return seg.filter(F.col("_has1") == 1).drop("_has1")


def _merge(seg: DataFrame, keys, merge_gap: float, min_duration: float,
           hot_rows, chunk_rows) -> DataFrame:
    staged, lay = frames.stage(seg, keys, halo=1, hot_rows=hot_rows, chunk_rows=chunk_rows,
                               bucket_span=SEG_BUCKET_SECONDS, order=("start", "_grp"))
    w = lay.window()
    joins = (F.coalesce(F.col("type") == F.lag("type").over(w), F.lit(False))
             & ((F.col("start") - F.lag("end").over(w)) <= F.lit(float(merge_gap))))
    staged = frames.with_running_sum(staged, lay, (~joins).cast("int"), "_m")
    merged = frames.unstage(staged, lay).groupBy(*keys, "_m").agg(
        F.min("start").alias("seg_start"), F.max("end").alias("seg_end"),
        F.max("type").alias("type"))
    return (merged.filter((F.col("seg_end") - F.col("seg_start")) >= F.lit(float(min_duration)))
                  .drop("_m"))


def anomaly_segments(df: DataFrame, merge_gap: float = 0.2, min_duration: float = 0.15,
                     flight_keys=DEFAULT_FLIGHT_KEYS,
                     hot_rows: int | None = frames.HOT_ROWS,
                     chunk_rows: int = frames.CHUNK_ROWS) -> DataFrame:
    """Ground-truth segments (keys, seg_start, seg_end, type).

    Needs ``t_rel`` (see ``with_t_rel``), ``label`` and ``tamper_type``.
    """
    keys = list(flight_keys)
    df = frames.ensure_ord(df)
    lab = F.col("label")
    seg = _islands(df, keys, F.coalesce(lab == 1, F.lit(False)), F.coalesce(lab == 0, F.lit(False)),
                   F.col("tamper_type"), hot_rows, chunk_rows)
    return _merge(seg, keys, merge_gap, min_duration, hot_rows, chunk_rows) \
        .select(*keys, "seg_start", "seg_end", "type")


def binary_segments(df: DataFrame, bool_col: str, merge_gap: float = 0.2,
                    min_duration: float = 0.15, flight_keys=DEFAULT_FLIGHT_KEYS,
                    hot_rows: int | None = frames.HOT_ROWS,
                    chunk_rows: int = frames.CHUNK_ROWS) -> DataFrame:
    """Segments of a boolean alert column (keys, seg_start, seg_end).

    A missing flag counts as false.
    """
    keys = list(flight_keys)
    df = frames.ensure_ord(df)
    b = F.coalesce(F.col(bool_col).cast("boolean"), F.lit(False))
    seg = _islands(df, keys, b, ~b, F.lit(""), hot_rows, chunk_rows)
    return _merge(seg, keys, merge_gap, min_duration, hot_rows, chunk_rows) \
        .select(*keys, "seg_start", "seg_end")


TIMELINE_CHANNELS = ("altitude", "speed", "heading", "latitude", "longitude")


def case_timeline(df: DataFrame, case_id, channels=TIMELINE_CHANNELS,
                  layers=("alert_threshold", "alert_change", "alert_ml"),
                  strict: bool = False) -> DataFrame:
    """long-form timeline of one case, in time order: (t_rel, row_idx, channel, value, label, layers).

    ``layers`` lists the alert columns present at each sample (array of the
    firing ones).  The plot itself is not built; this is its data.
    ``strict=True`` raises ``ValueError`` when the case has no rows.
    """
    one = df.filter(F.col("case_id") == F.lit(case_id))
    if strict:
        require_rows(one, f"case_id={case_id}")
    present = [c for c in layers if c in df.columns]
    fired = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c))
                               for c in present]), lambda x: x.isNotNull()) \
        if present else F.array().cast("array<string>")
    long = one.select("t_rel", "row_idx", "label", "tamper_type", fired.alias("alerts"),
                      *[F.col(c).cast("double") for c in channels]) \
        .unpivot(["t_rel", "row_idx", "label", "tamper_type", "alerts"], list(channels),
                 "channel", "value")
    return long.orderBy("t_rel", "row_idx", "channel")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail the job (not the driver) with a clear message when ``df`` is empty."""
    n = df.limit(1).count()
    if n == 0:
        raise ValueError(f"no data for {what}")
    return df

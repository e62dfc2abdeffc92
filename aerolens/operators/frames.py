"""Flight-ordered window staging with exact splitting of hot flights.

All sliding-window operators (L2, features, freeze) share one window spec:
``partitionBy(flight keys [, _chunk]).orderBy(row_idx, _ord)``, so Spark plans
a single Exchange + Sort for all of them.

A flight is one window partition, hence one task.  To survive a flight that
holds a large share of all rows, flights with more than ``hot_rows`` rows are
split into chunks of ``chunk_rows`` consecutive rows.  Each chunk also
receives the ``halo`` rows that precede it (flagged ``_halo``), so every
row-count frame of at most ``halo + 1`` rows is evaluated exactly; halo rows
are dropped after the window columns are computed.

Exact row positions inside a hot flight come from a two-level prefix sum:
rows are bucketed by ``row_idx`` value, numbered inside the bucket, and the
bucket offsets come from a running sum over the (small) bucket-count table.
No step needs a whole flight in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from aerolens.schema import DEFAULT_FLIGHT_KEYS, ORDER_COLUMNS

CHUNK = "_chunk"
HALO = "_halo"

# Hot-flight defaults: a flight above HOT_ROWS rows is split into chunks of
# CHUNK_ROWS rows.  BUCKET_SPAN is the row_idx span used to number rows.
HOT_ROWS = 4_000_000
CHUNK_ROWS = 1_000_000
BUCKET_SPAN = 1 << 20
# A hot-key list is broadcast only below this many keys (each hot key has more
# than HOT_ROWS rows, so the list is bounded by total_rows / HOT_ROWS anyway).
BROADCAST_MAX_KEYS = 200_000


@dataclass(frozen=True)
class FlightLayout:
    keys: tuple[str, ...] = DEFAULT_FLIGHT_KEYS
    split: bool = False
    added_ord: bool = False
    order: tuple[str, ...] = ORDER_COLUMNS

    @property
    def partition_cols(self) -> list[str]:
        return list(self.keys) + ([CHUNK] if self.split else [])

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_cols).orderBy(*self.order)

    def window_desc(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_cols).orderBy(
            *[F.col(c).desc() for c in self.order])

    def real(self) -> F.Column:
        """True on rows that belong to the chunk (not halo copies)."""
        return ~F.col(HALO) if self.split else F.lit(True)


def ensure_ord(df: DataFrame) -> DataFrame:
    """Guarantee the ``_ord`` tie-break column (0 when the input has none)."""
    if "_ord" in df.columns:
        return df
    return df.withColumn("_ord", F.lit(0).cast("bigint"))


def stage(df: DataFrame, flight_keys=DEFAULT_FLIGHT_KEYS, halo: int = 31,
          hot_rows: int | None = HOT_ROWS, chunk_rows: int = CHUNK_ROWS,
          bucket_span: float = BUCKET_SPAN, order=ORDER_COLUMNS,
          halo_after: int = 0) -> tuple[DataFrame, FlightLayout]:
    """Prepare ``df`` for flight windows; returns the frame and its layout.

    ``order`` is the in-flight order; its first column must be numeric (it
    is bucketed by ``bucket_span`` to number rows of hot flights).  ``halo``
    rows before and ``halo_after`` rows after each chunk are copied in.
    With ``hot_rows=None`` no split is attempted (one partition per flight).
    Otherwise one small aggregate (rows per flight) decides whether any
    flight is hot; when none is, the plan is the plain one.
    """
    keys = tuple(flight_keys)
    order = tuple(order)
    added = "_ord" not in df.columns
    df = ensure_ord(df)
    if hot_rows is None:
        return df, FlightLayout(keys, False, added, order)
    if halo + halo_after >= chunk_rows:
        raise ValueError("halos must be smaller than chunk_rows")

    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > F.lit(int(hot_rows))).select(*keys))
    n_hot = hot.count()
    if n_hot == 0:
        return df, FlightLayout(keys, False, added, order)
    hot = hot.select(*[F.col(k).alias("_h_" + k) for k in keys])
    hot_side = F.broadcast(hot) if n_hot <= BROADCAST_MAX_KEYS else hot
    # a NULL key never equals in a join; null-safe join keys keep such flights
    cond = [F.col(k).eqNullSafe(F.col("_h_" + k)) for k in keys]

    normal = (df.join(hot_side, cond, "left_anti")
              .withColumn(CHUNK, F.lit(0).cast("bigint"))
              .withColumn(HALO, F.lit(False)))
    hot_rows_df = df.join(hot_side, cond, "left_semi")
    split = _split_hot(hot_rows_df, keys, halo, chunk_rows, bucket_span, order, halo_after)
    cols = list(df.columns) + [CHUNK, HALO]
    return (normal.select(cols).unionByName(split.select(cols)),
            FlightLayout(keys, True, added, order))


def _split_hot(df: DataFrame, keys, halo: int, chunk_rows: int,
               bucket_span: float, order, halo_after: int) -> DataFrame:
    # buckets are monotone in the order (NULLs first, like an ascending sort)
    bucket = F.coalesce(F.floor(F.col(order[0]) / F.lit(bucket_span)), F.lit(-(2 ** 62)))
    df = df.withColumn("_b", bucket.cast("bigint"))
    wb = Window.partitionBy(*keys, "_b").orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(wb))
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias("_o_" + k) for k in keys],
                            F.col("_b").alias("_o_b"),
                            F.coalesce(F.sum("_cnt").over(wk), F.lit(0)).alias("_off"))
    cond = [F.col(k).eqNullSafe(F.col("_o_" + k)) for k in keys] + [F.col("_b") == F.col("_o_b")]
    df = df.join(offsets, cond, "inner").drop(*["_o_" + k for k in keys], "_o_b")
    pos0 = F.col("_off") + F.col("_rn") - F.lit(1)          # 0-based position
    base = F.floor(pos0 / F.lit(int(chunk_rows))).cast("bigint")
    within = pos0 % F.lit(int(chunk_rows))
    tail = within >= F.lit(int(chunk_rows - halo))           # copy to next chunk
    head = (within < F.lit(int(halo_after))) & (base > 0)    # copy to previous chunk
    dups = F.array_compact(F.array(F.lit(0), F.when(tail, F.lit(1)), F.when(head, F.lit(-1))))
    df = df.withColumn("_dup", F.explode(dups))
    return (df.withColumn(CHUNK, base + F.col("_dup"))
              .withColumn(HALO, F.col("_dup") != F.lit(0))
              .drop("_b", "_rn", "_off", "_dup"))


def with_running_sum(df: DataFrame, layout: FlightLayout, value: F.Column,
                     out: str) -> DataFrame:
    """``out`` = running sum of ``value`` over the flight order (real rows).

    Split flights add the totals of earlier chunks (a prefix over the small
    per-chunk table), so the sum is exact across chunk borders.
    """
    real = layout.real()
    df = df.withColumn("_rs_v", F.when(real, value).otherwise(F.lit(0)))
    v = F.col("_rs_v")
    w = layout.window().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.sum(v).over(w))
    if not layout.split:
        return df.drop("_rs_v")
    keys = list(layout.keys)
    tot = df.groupBy(*keys, CHUNK).agg(F.sum(v).alias("_tot"))
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*[F.col(k).alias("_s_" + k) for k in keys], F.col(CHUNK).alias("_s_chunk"),
                     F.coalesce(F.sum("_tot").over(wc), F.lit(0)).alias("_s_off"))
    cond = [F.col(k).eqNullSafe(F.col("_s_" + k)) for k in keys] + \
        [F.col(CHUNK) == F.col("_s_chunk")]
    df = df.join(off, cond, "left")
    return (df.withColumn(out, F.col(out) + F.coalesce(F.col("_s_off"), F.lit(0)))
              .drop(*["_s_" + k for k in keys], "_s_chunk", "_s_off", "_rs_v"))


def unstage(df: DataFrame, layout: FlightLayout) -> DataFrame:
    if layout.split:
        df = df.filter(~F.col(HALO)).drop(CHUNK, HALO)
    if layout.added_ord:
        df = df.drop("_ord")
    return df

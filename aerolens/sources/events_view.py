"""Telemetry view over the driver's ``events`` table.

Maps each ``user_id`` to a flight and each event to a sample, following the
fixture definition: flight = user, order = (ts, event_id), first sample of
each flight dropped (``row_idx > 0``).  All literals are DOUBLE so that Spark
and DuckDB agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _d(x) -> F.Column:
    return F.lit(float(x)).cast("double")


def events_micros(ts: F.Column) -> F.Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of session tz."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts)


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Telemetry rows (canonical column names) derived from ``events``.

    Output columns: case_id, replicate, profile, row_idx, event_id, _ord, t_us,
    timestamp, label, tamper_type, altitude, speed, heading, latitude,
    longitude.
    """
    uid = F.col("user_id")
    eid = F.col("event_id")
    flat = (uid % 10) == 0
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t_us = events_micros(F.col("ts"))
    v = events.select(
        uid.alias("case_id"),
        (uid % 4).cast("int").alias("replicate"),
        F.when(uid % 3 == 0, "subtle").when(uid % 3 == 1, "balanced")
         .otherwise("strong").alias("profile"),
        (F.row_number().over(w) - 1).cast("bigint").alias("row_idx"),
        eid.alias("event_id"),
        eid.alias("_ord"),
        t_us.alias("t_us"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("int").alias("label"),
        F.when(F.col("event_type") != "error", "normal")
         .when(eid % 3 == 0, "altitude_spike")
         .when(eid % 3 == 1, "coordinate_jump")
         .otherwise("injection").alias("tamper_type"),
        F.when(eid % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value") * _d(1.2) - _d(10)).alias("altitude"),
        F.when(flat, _d(5))
         .otherwise((eid * 7 % 400).cast("double") / _d(10) - _d(1)).alias("speed"),
        F.when(flat, _d(90))
         .otherwise((eid * 37 % 3700).cast("double") / _d(10) - _d(3)).alias("heading"),
        (_d(52) + F.when(flat, _d(0))
         .otherwise((eid * 13 % 1000).cast("double") / _d(100000))).alias("latitude"),
        (_d(21) + F.when(flat, _d(0))
         .otherwise((eid * 17 % 1000).cast("double") / _d(100000))).alias("longitude"),
    )
    return (v.filter(F.col("row_idx") > 0)
             .withColumn("timestamp", F.timestamp_micros(F.col("t_us"))))


def load_events_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


# DuckDB form of the same view (oracle side); t_us via epoch_us.
EVENTS_VIEW_SQL = """
select * from (
  select user_id as case_id,
    cast(user_id % 4 as int) as replicate,
    case user_id % 3 when 0 then 'subtle' when 1 then 'balanced' else 'strong' end as profile,
    cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as row_idx,
    event_id,
    event_id as _ord,
    epoch_us(ts) as t_us,
    case when event_type = 'error' then 1 else 0 end as label,
    case when event_type <> 'error' then 'normal' when event_id % 3 = 0 then 'altitude_spike'
         when event_id % 3 = 1 then 'coordinate_jump' else 'injection' end as tamper_type,
    case when event_id % 97 = 0 then null else value * cast(1.2 as double) - cast(10 as double) end as altitude,
    case when user_id % 10 = 0 then cast(5 as double)
         else cast(event_id * 7 % 400 as double) / cast(10 as double) - cast(1 as double) end as speed,
    case when user_id % 10 = 0 then cast(90 as double)
         else cast(event_id * 37 % 3700 as double) / cast(10 as double) - cast(3 as double) end as heading,
    cast(52 as double) + case when user_id % 10 = 0 then 0
         else cast(event_id * 13 % 1000 as double) / cast(100000 as double) end as latitude,
    cast(21 as double) + case when user_id % 10 = 0 then 0
         else cast(event_id * 17 % 1000 as double) / cast(100000 as double) end as longitude
  from events) v
where row_idx > 0
"""

"""Queries of the CSV ingest path.

The telemetry view is written by Spark as a header CSV (every sample of
``events``, including row 0, timestamps as ISO 8601 text with offset) into
the session's checkpoint folder, then read back through ``load_dataset``.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Window, functions as F

from aerolens.session import checkpoint_dir
from aerolens.sources import csv as ingest
from aerolens.sources.events_view import events_micros
from aerolens.plans import sqlkit as q
from aerolens.plans.registry import r6, register

CSV_COLUMNS = ("profile", "replicate", "case_id", "case_name", "row_idx", "label", "tamper_type",
               "timestamp", "latitude", "longitude", "altitude", "speed", "heading", "source",
               "original_row_idx")


def _csv_rows(spark, sf_dir: str):
    """The (unfiltered) telemetry view of ``events`` as text columns."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    uid, eid = F.col("user_id"), F.col("event_id")
    flat = (uid % 10) == 0
    d = lambda x: F.lit(float(x))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t_us = events_micros(F.col("ts"))
    return ev.select(
        F.when(uid % 3 == 0, "subtle").when(uid % 3 == 1, "balanced").otherwise("strong").alias("profile"),
        (uid % 4).cast("string").alias("replicate"),
        uid.cast("string").alias("case_id"),
        F.concat(F.lit("flight_"), uid.cast("string")).alias("case_name"),
        (F.row_number().over(w) - 1).cast("string").alias("row_idx"),
        F.when(F.col("event_type") == "error", "1").otherwise("0").alias("label"),
        F.when(F.col("event_type") != "error", "normal").when(eid % 3 == 0, "altitude_spike")
         .when(eid % 3 == 1, "coordinate_jump").otherwise("injection").alias("tamper_type"),
        F.date_format(F.timestamp_micros(t_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
        (d(52) + F.when(flat, d(0)).otherwise((eid * 13 % 1000).cast("double") / d(100000))).cast("string").alias("latitude"),
        (d(21) + F.when(flat, d(0)).otherwise((eid * 17 % 1000).cast("double") / d(100000))).cast("string").alias("longitude"),
        F.when(eid % 97 == 0, F.lit("NaN"))
         .otherwise((F.col("value") * d(1.2) - d(10)).cast("string")).alias("altitude"),
        F.when(flat, d(5)).otherwise((eid * 7 % 400).cast("double") / d(10) - d(1)).cast("string").alias("speed"),
        F.when(flat, d(90)).otherwise((eid * 37 % 3700).cast("double") / d(10) - d(3)).cast("string").alias("heading"),
        F.lit("FLIGHT_LOG").alias("source"),
        eid.cast("string").alias("original_row_idx"),
    )


def events_as_csv(spark, sf_dir: str) -> str:
    """Write the (unfiltered) telemetry view of ``events`` as CSV; return its path."""
    rows = _csv_rows(spark, sf_dir)
    # a fresh folder per call: a lazily read earlier result is never overwritten
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:8]
    path = os.path.join(checkpoint_dir(spark), f"events_csv_{tag}_{uuid.uuid4().hex[:10]}")
    rows.write.mode("errorifexists").option("header", True).csv(path)
    return path


def _loaded(spark, sf_dir):
    return ingest.load_dataset(spark, events_as_csv(spark, sf_dir))


_T_REL = "(t_us - min(t_us) over (partition by replicate, case_id)) / 1000000.0"


@register("s1_csv_ingest", q.with_view(f"""
select event_id as original_row_idx, case_id, replicate, row_idx, label, tamper_type, profile,
  {q.r6('altitude')} as altitude, {q.r6('speed')} as speed, {q.r6('heading')} as heading,
  {q.r6('latitude')} as latitude, {q.r6('longitude')} as longitude, t_us, {q.r6(_T_REL)} as t_rel
from t"""))
def s1_csv_ingest(spark, sf_dir):
    d = _loaded(spark, sf_dir)
    return d.select("original_row_idx", "case_id", "replicate", "row_idx", "label", "tamper_type",
                    "profile", *[r6(c).alias(c) for c in ("altitude", "speed", "heading",
                                                          "latitude", "longitude")],
                    F.unix_micros("timestamp").alias("t_us"), r6("t_rel").alias("t_rel"))


@register("s1_blank_lines", q.with_view(f"""
select event_id as original_row_idx, case_id, row_idx, label, {q.r6('altitude')} as altitude, t_us from t"""))
def s1_blank_lines(spark, sf_dir):
    """Files that begin with blank lines and hold others between their rows: no row is lost."""
    raw = events_as_csv(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), f"blank_csv_{uuid.uuid4().hex[:10]}")
    whole = spark.read.text(raw, wholetext=True).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.concat(F.lit("\n  \n"), F.regexp_replace("value", "\n", "\n\n")).alias("value"))
    whole.write.partitionBy("file").text(path)                        # one file each again
    d = ingest.load_dataset(spark, path)
    return d.select("original_row_idx", "case_id", "row_idx", "label", r6("altitude").alias("altitude"), F.unix_micros("timestamp").alias("t_us"))


@register("f4_replicate_split", q.with_view("""
select case when replicate = 3 then 'test' else 'train' end as part, cast(count(*) as bigint) as n,
  cast(count(distinct case_id) as bigint) as n_cases
from t group by part"""))
def f4_replicate_split(spark, sf_dir):
    train, test = ingest.split_by_replicate(_loaded(spark, sf_dir), 3)
    agg = lambda d, name: d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"),
                                F.countDistinct("case_id").alias("n_cases"))
    return agg(train, "train").unionByName(agg(test, "test"))


@register("f5_clean_subset", q.with_view(
    "select cast(count(*) as bigint) as n, cast(count(distinct case_id) as bigint) as n_cases from t where label = 0"))
def f5_clean_subset(spark, sf_dir):
    c = ingest.clean_subset(_loaded(spark, sf_dir))
    return c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("n_cases"))


@register("o1_sorted_head", q.with_view(
    "select case_id, row_idx, original_row_idx from (select case_id, row_idx, event_id as original_row_idx "
    "from t order by case_id, row_idx, event_id limit 50)"))
def o1_sorted_head(spark, sf_dir):
    """O1 + O3: presentation order then head(50) (a top-k, TakeOrdered)."""
    d = ingest.sort_flights(_loaded(spark, sf_dir)).limit(50)
    return d.select("case_id", "row_idx", "original_row_idx")


@register("o6_distinct_types", q.with_view(
    "select distinct tamper_type from t where tamper_type <> 'normal'"))
def o6_distinct_types(spark, sf_dir):
    d = _loaded(spark, sf_dir)
    return d.filter(F.col("tamper_type") != "normal").select("tamper_type").distinct().orderBy("tamper_type")


_ODD = "9007199254740993"          # above 2**53: not a double


@register("s1_mixed_files", q.with_view(f"""
select event_id as original_row_idx, case_id + case when case_id % 5 = 0 then {_ODD} else 0 end as case_id,
  case when event_id % 101 = 0 then null else replicate end as replicate, row_idx, label,
  {q.r6('altitude')} as altitude, {q.r6('speed')} as speed, t_us
from t"""))
def s1_mixed_files(spark, sf_dir):
    """Two folders of files with different column order, ids above 2**53, tokens out of range, times without offset."""
    rows = _csv_rows(spark, sf_dir)
    case, eid = F.col("case_id").cast("bigint"), F.col("original_row_idx").cast("bigint")
    rows = rows.withColumns({
        "case_id": F.when(case % 5 == 0, (case + F.lit(int(_ODD))).cast("string")).otherwise(F.col("case_id")),
        "replicate": F.when(eid % 101 == 0, F.lit("1e20")).otherwise(F.col("replicate")),
        "timestamp": F.when(eid % 2 == 0, F.substring("timestamp", 1, 26)).otherwise(F.col("timestamp"))})
    path = os.path.join(checkpoint_dir(spark), f"mixed_csv_{uuid.uuid4().hex[:10]}")
    write = lambda d: d.write.mode("append").option("header", True).csv(path)
    write(rows.where(eid % 3 == 0))
    write(rows.where(eid % 3 != 0).select(*reversed(rows.columns)))
    d = ingest.load_dataset(spark, path)
    return d.select("original_row_idx", "case_id", "replicate", "row_idx", "label", r6("altitude").alias("altitude"),
                    r6("speed").alias("speed"), F.unix_micros("timestamp").alias("t_us"))


@register("s3_missing_columns", q.with_view("select 'label' as missing, cast(count(*) as bigint) as n_rows from t"))
def s3_missing_columns(spark, sf_dir):
    """The error of a file without a required column names it; with usecols the check is off."""
    path = os.path.join(checkpoint_dir(spark), f"short_csv_{uuid.uuid4().hex[:10]}")
    _csv_rows(spark, sf_dir).drop("label").write.option("header", True).csv(path)
    try:
        ingest.load_dataset(spark, path)
        said = "nothing"
    except ValueError as e:
        said = str(e).partition("['")[2].partition("']")[0]
    d = ingest.load_dataset(spark, path, usecols=["timestamp", "row_idx", "case_id", "replicate"])
    return d.agg(F.lit(said).alias("missing"), F.count(F.lit(1)).alias("n_rows")).select("missing", "n_rows")

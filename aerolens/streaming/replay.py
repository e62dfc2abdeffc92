"""Stream sources and replay selection.

A recorded telemetry table is replayed as a file stream: rows are written
in event-time chunks (one write per chunk, so file modification times follow
time), each chunk hash-partitioned by flight so that a flight's rows of one
chunk sit in one file; ``readStream`` with ``maxFilesPerTrigger`` (back
pressure) and ``trigger(availableNow=True)`` (bounded run) replays them.
A Kafka topic with the same schema is a drop-in source.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.schema import DEFAULT_FLIGHT_KEYS

BROADCAST_MAX_IDS = 100_000


def select_cases(df: DataFrame, case_ids: Iterable | None = None, n_cases: int | None = None,
                 max_samples: int | None = None) -> DataFrame:
    """F6 given cases (semi join), F7 first N cases, F8 hard row cap in order."""
    if case_ids is not None:
        ids_list = [int(c) for c in case_ids]
        ids = df.sparkSession.createDataFrame([(c,) for c in ids_list], "case_id bigint")
        # broadcast the id list only when it is small; otherwise a shuffled semi join
        side = F.broadcast(ids) if len(ids_list) <= BROADCAST_MAX_IDS else ids
        df = df.join(side, "case_id", "left_semi")
    elif n_cases is not None:
        first = df.select("case_id").distinct().orderBy("case_id").limit(int(n_cases))
        side = F.broadcast(first) if int(n_cases) <= BROADCAST_MAX_IDS else first
        df = df.join(side, "case_id", "left_semi")      # at most n_cases rows
    if max_samples:            # 0 / None: no limit
        order = [c for c in ("case_id", "row_idx", "_ord") if c in df.columns]
        df = df.orderBy(*order).limit(int(max_samples))
    return df


def write_replay(df: DataFrame, path: str, chunks: int = 4, files_per_chunk: int = 4,
                 flight_keys=DEFAULT_FLIGHT_KEYS, by: str = "time") -> int:
    """Write ``df`` as ``chunks`` slices, one after the other; returns files per chunk.

    ``by``: ``time`` (event time; rows without a timestamp come with the first
    slice) or ``case`` (whole flights in the order of case_id; a missing
    case_id comes first).  The slices are computed once, beside ``path``.
    """
    if by == "time":
        t = F.unix_micros("timestamp")
        n, lo, hi = df.agg(F.count(F.lit(1)), F.min(t), F.max(t)).first()
        span = 1 if lo is None else max(1, (hi - lo + chunks) // chunks)
        part = F.floor((t - F.lit(lo)) / F.lit(span)).cast("int")
    elif by == "case":
        n = df.count()
        cuts = df.approxQuantile("case_id", [i / chunks for i in range(1, chunks)], 0.01) if n and chunks > 1 else []
        part = sum((F.col("case_id") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    else:
        raise ValueError(f"Unknown order: {by!r}")
    if not n:
        raise ValueError("nothing to replay")
    staged = f"{path.rstrip('/')}_slices"
    sliced = df.withColumn("_slice", F.least(F.coalesce(part, F.lit(0)), F.lit(chunks - 1)))
    sliced.repartition("_slice", *flight_keys).write.mode("overwrite").partitionBy("_slice").parquet(staged)
    whole = df.sparkSession.read.schema(sliced.schema).parquet(staged)
    for c in range(chunks):
        (whole.where(F.col("_slice") == c).select(*df.columns).repartition(files_per_chunk, *flight_keys)
              .write.mode("append").parquet(path))
    return files_per_chunk


def replay_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """S9 + T6: file stream of the replay folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_trigger))
            .parquet(path))

"""Structured Streaming detection.

Plan of one streaming query::

    readStream (files / Kafka)        S9, T6 (maxFilesPerTrigger)
      -> last rows of its flights     T1: state store, ``buffer`` rows a flight
      -> foreachBatch                 per micro-batch, in arrival order:
           detect() over context+new  T2: the batch operators, L1 + L2 + causal features
           model.predict on new rows  L3
           combine_layers             F13: layers array, reasons
      -> sinks keyed by batch id      S10 scored rows, S4 JSON lines, S5 console
                                      lines, T4 counters

There is one definition of every window: the batch one.  No row is dropped:
a row at or before the last one seen of its flight is scored in arrival order
and flagged ``late``; rows without a timestamp are scored like others; no
watermark is set.

The context of a flight is one value in the state store (RocksDB unless the
session names another provider): the last ``buffer`` rows, packed.  A
micro-batch loads, hands on and updates the values of the flights it has rows
of, whatever the number of flights that are idle.  The new rows don't pass
through Python; only the packed context columns do.  The store is versioned
by micro-batch, so a replayed batch starts from the same context, and its
number of partitions is that of the first start.  ``idle_after`` (a duration
in seconds) forgets flights that have had no row for that long (their next
row starts a new context), at the price of a look at all timers per batch; by
default none is forgotten.

``state="table"`` keeps the context as Parquet folders by batch id instead,
for streams whose context has to outlive the checkpoint or be read by others:
one folder per batch with the last rows of the flights it touched, compacted
every ``compact_every`` batches, when flights that were idle for
``evict_batches`` are forgotten and folders no replay needs are deleted.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from aerolens.operators.combine import combine_layers, validate_layers
from aerolens.plans.composed import detect
from aerolens.schema import DEFAULT_FEATURE_WINDOW, DEFAULT_FLIGHT_KEYS, DEFAULT_STAT_CONFIG

CHANNELS = ("timestamp", "altitude", "speed", "heading", "latitude", "longitude")
COMPACT_EVERY = 16
SINKS = ("alerts", "console", "metrics")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LEAST = -(1 << 63)

ALERT_READ_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("case_id", T.LongType()),
    T.StructField("row_idx", T.LongType()), T.StructField("layers", T.ArrayType(T.StringType())),
    T.StructField("reasons", T.StringType()), T.StructField("ml_score", T.DoubleType()),
    T.StructField("label", T.IntegerType())])


def buffer_size_for(layers, stat_config=None, feature_window=None) -> int:
    """max(1, L2 window if statistical, feature window if ml) + 10."""
    cfg = DEFAULT_STAT_CONFIG if stat_config is None else stat_config
    need = [1]
    if "statistical" in layers:
        need.append(int(cfg["window"]))
    if "ml" in layers:
        need.append(int(feature_window or DEFAULT_FEATURE_WINDOW))
    return max(need) + 10


def _context_fields(schema: T.StructType, flight_keys) -> list[T.StructField]:
    return [f for f in schema.fields if f.name in (*flight_keys, "row_idx", "_ord", *CHANNELS)]


def _last_rows(_, batches, state, buffer: int, idle_ms: int | None):
    """The flight's rows of before this micro-batch; keeps the last ``buffer`` of these and the new ones."""
    if state.hasTimedOut:
        state.remove()
        return
    o1, o2, packed = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)
    for b in batches:                                 # at most buffer rows and one Arrow batch are held
        o1, o2 = np.concatenate((o1, b["o1"].to_numpy())), np.concatenate((o2, b["o2"].to_numpy()))
        packed = np.concatenate((packed, b["packed"].to_numpy()))
        last = np.lexsort((o2, o1))[-buffer:]
        o1, o2, packed = o1[last], o2[last], packed[last]
    old = list(state.get[0]) if state.exists else []
    state.update(((old + packed.tolist())[-buffer:],))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    if old:
        yield pd.DataFrame({"packed": old, "place": range(len(old))})


def with_context(stream: DataFrame, flight_keys, buffer: int, idle_after: float | None = None) -> DataFrame:
    """``stream`` and, marked ``_new`` = false, the last rows of before the micro-batch of the flights that it has rows of.

    ``_bid`` is null for new rows and orders the others, below any batch id.
    """
    fields = _context_fields(stream.schema, flight_keys)
    times = {f.name for f in fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    packed = F.to_json(F.struct(*[micros(f.name) if f.name in times else F.col(f.name) for f in fields]))
    least = F.lit(_LEAST).cast("bigint")
    rows = stream.select(*flight_keys, F.coalesce(F.col("row_idx").cast("bigint"), least).alias("o1"),
                         F.coalesce(F.col("_ord").cast("bigint"), least).alias("o2"), packed.alias("packed"))
    idle_ms = None if idle_after is None else max(1, int(idle_after * 1000))
    kept = rows.groupBy(*flight_keys).applyInPandasWithState(
        partial(_last_rows, buffer=int(buffer), idle_ms=idle_ms), "packed string, place bigint", "rows array<string>",
        "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in fields])
    r = F.from_json("packed", schema).alias("r")
    old = kept.select(r, "place").select(
        *[(F.timestamp_micros(F.col(f"r.{f.name}")).cast(f.dataType) if f.name in times else F.col(f"r.{f.name}")).alias(f.name) for f in fields],
        (F.col("place") - (1 << 40)).alias("_bid"), F.lit(False).alias("_new"))
    new = stream.withColumns({"_bid": F.lit(None).cast("bigint"), "_new": F.lit(True)})
    return new.unionByName(old, allowMissingColumns=True)


class FlightContext:
    """The last ``buffer`` rows of every flight, as Parquet folders by batch id."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, flight_keys, buffer: int,
                 evict_batches: int | None = None, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.buffer = spark, path, int(buffer)
        self.keys, self.evict, self.every = list(flight_keys), evict_batches, int(compact_every)
        kept = _context_fields(schema, self.keys)
        self.columns = [f.name for f in kept] + ["_bid"]
        self.schema = T.StructType([*kept, T.StructField("_bid", T.LongType())])

    def _ids(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [x.getPath() for x in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().rpartition("=")[2]) for p in done)

    def _rows(self, before: int, flights: DataFrame | None = None) -> DataFrame:
        """Latest rows of each of ``flights`` (default: of all) as of the batches before ``before``."""
        full = [i for i in self._ids("full") if i < before][-1:]
        deltas = [i for i in self._ids("delta") if (full[0] if full else -1) < i < before]
        rows = self.spark.createDataFrame([], self.schema).withColumn("_from", F.lit(0).cast("bigint"))
        for kind, i in [("full", i) for i in full] + [("delta", i) for i in deltas]:       # at most compact_every + 1
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/batch_id={i}")
            rows = rows.unionByName(part.withColumn("_from", F.lit(i).cast("bigint")))
        if flights is not None:
            f = flights.select(*[F.col(k).alias(f"_f_{k}") for k in self.keys])
            rows = rows.join(f, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in self.keys], "left_semi")
        flight = W.partitionBy(*self.keys)                      # at most buffer * (compact_every + 1) rows
        return rows.withColumns({"_newest": F.max("_from").over(flight), "_seen": F.max("_bid").over(flight)}).where("_from = _newest")

    def read(self, batch_id: int, flights: DataFrame) -> DataFrame:
        """Context rows of ``flights`` (a table of distinct keys) before this batch."""
        return self._rows(batch_id, flights).select(*self.columns)

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """Keep the last rows of the flights in ``rows`` (context and new ones)."""
        order = W.partitionBy(*self.keys).orderBy(F.desc("_bid"), F.desc("row_idx"), F.desc("_ord"))
        last = rows.select(*self.columns).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= self.buffer)
        last.drop("_rn").write.mode("overwrite").parquet(f"{self.path}/delta/batch_id={batch_id}")
        if batch_id % self.every == self.every - 1:
            now = self._rows(batch_id + 1)
            if self.evict is not None:
                now = now.where(F.col("_seen") > batch_id - int(self.evict))
            now.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/full/batch_id={batch_id}")
            self._forget(batch_id)

    def _forget(self, batch_id: int) -> None:
        """Delete the folders that no later batch and no replay of this one reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        read_by_this = [i for i in self._ids("full") if i < batch_id][-1:]
        for kind in ("full", "delta") if read_by_this else ():
            for i in self._ids(kind):
                if i < read_by_this[0] or (kind == "delta" and i == read_by_this[0]):
                    folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch_id={i}")
                    folder.getFileSystem(conf).delete(folder, True)


def _decide(rows: DataFrame, keys, layers, model=None, thresholds=None, stat_config=None, ml_threshold: float | None = None,
            with_features: bool = False) -> DataFrame:
    """The ``_new`` rows of ``rows`` with their layers' columns and ``late``; ``_bid`` orders a flight's batches.

    ``rows`` is read once.
    """
    flight = W.partitionBy(*keys)
    last = F.max(F.when(~F.col("_new"), F.struct("row_idx", "_ord"))).over(flight)
    rows = rows.withColumn("_last_seen", last)
    rows = rows.withColumn("late", F.coalesce(F.struct("row_idx", "_ord") <= F.col("_last_seen"), F.lit(False))).drop("_last_seen")
    without = tuple(x for x in layers if x != "ml")
    d = detect(rows, layers=without or ("rules",), thresholds=thresholds, stat_config=stat_config, fill="causal",
               feature_window=getattr(model, "window", None), flight_keys=keys, hot_rows=None,
               with_features=with_features or "ml" in layers, order=("_bid", "row_idx", "_ord"))
    if not without:
        d = d.drop("alert_threshold", "alert_reasons")
    d = d.where("_new").drop("_new", "_bid")
    if "ml" in layers:
        d = model.predict(d, ml_threshold=ml_threshold)
    return combine_layers(d, layers)


def score_batch(batch: DataFrame, batch_id: int, context: FlightContext, layers, model=None, thresholds=None,
                stat_config=None, ml_threshold: float | None = None,
                with_features: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scored new rows with ``late``, context and new rows) of one micro-batch over a context table.

    The rows of a flight are in arrival order: earlier batches first, then
    (row_idx, _ord) within the batch.
    """
    keys = context.keys
    new = batch.withColumns({"_bid": F.lit(batch_id).cast("bigint"), "_new": F.lit(True)})
    old = context.read(batch_id, batch.select(*keys).distinct()).withColumn("_new", F.lit(False))
    rows = new.unionByName(old, allowMissingColumns=True)
    return _decide(rows, keys, layers, model, thresholds, stat_config, ml_threshold, with_features), rows


def stream_detect(stream: DataFrame, out_dir: str, checkpoint: str, layers="all", model=None, thresholds=None,
                  stat_config=None, flight_keys=DEFAULT_FLIGHT_KEYS, buffer_size: int | None = None,
                  ml_threshold: float | None = None, case_ids=None, sinks=SINKS, state: str = "store",
                  idle_after: float | None = None, evict_batches: int | None = None,
                  compact_every: int = COMPACT_EVERY, with_features: bool = False, available_now: bool = True,
                  trigger: dict | None = None):
    """Start the streaming job; the query (awaited when ``available_now``).

    ``with_features`` keeps the window features of the rows (they are there
    with the layer ml anyway).  Below ``out_dir``: ``scored`` (S10: every row with its layer flags and
    ``late``), and for the ``sinks`` asked ``alerts`` (JSON lines), ``console``
    (text lines), ``metrics`` (counters), each by batch id.
    """
    lay = validate_layers(layers, model)
    unknown = set(sinks) - set(SINKS)
    if unknown:
        raise ValueError(f"Unknown sinks: {sorted(unknown)}. Allowed: {SINKS}")
    if state not in ("store", "table"):
        raise ValueError(f"Unknown state: {state!r}. Allowed: store, table")
    size = int(buffer_size or buffer_size_for(lay, stat_config, getattr(model, "window", None)))
    window = int((stat_config or DEFAULT_STAT_CONFIG)["window"]) if "statistical" in lay else 0
    if size < window + 1:
        raise ValueError("buffer_size must hold window + 1 rows for exact L2")
    if "_ord" not in stream.columns:
        stream = stream.withColumn("_ord", F.lit(0).cast("bigint"))
    if case_ids is not None:
        stream = stream.where(F.col("case_id").isin([int(c) for c in case_ids]))
    context = None
    if state == "table":
        context = FlightContext(stream.sparkSession, f"{out_dir}/context", stream.schema, flight_keys, size, evict_batches, compact_every)
    else:
        stream = with_context(stream, list(flight_keys), size, idle_after)
    how = (lay, model, thresholds, stat_config, ml_threshold, with_features)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        to = lambda name: f"{out_dir}/{name}/batch_id={batch_id}"
        if context is not None:
            scored, rows = score_batch(batch, batch_id, context, *how)
        else:                                         # the state store's operator is run once: scored is written, the sinks read it
            rows = batch.withColumn("_bid", F.coalesce("_bid", F.lit(batch_id).cast("bigint")))
            scored = _decide(rows, list(flight_keys), *how)
        schema = scored.schema
        scored.write.mode("overwrite").parquet(to("scored"))
        done = spark.read.schema(schema).parquet(to("scored"))
        if "alerts" in sinks:
            alerts(done).write.mode("overwrite").json(to("alerts"))
        if "console" in sinks:
            format_alert(alerts(done)).write.mode("overwrite").text(to("console"))
        if "metrics" in sinks:
            counters(done).write.mode("overwrite").parquet(to("metrics"))
        if context is not None:
            context.write(batch_id, rows)

    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else (w.trigger(**trigger) if trigger else w)
    q = _started(w, stream.sparkSession, available_now)
    if available_now:
        q.awaitTermination()
    return q


def _started(writer, spark: SparkSession, bounded: bool):
    """Start with the RocksDB state store, unless the session names a provider (a query keeps the settings of its start).

    ``bounded``: no batches without rows, which timers would ask for without
    end; timers are then looked at with the next rows.
    """
    own = {}
    if spark.conf.get(PROVIDER, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        own[PROVIDER] = ROCKSDB
    if bounded:
        own["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every row of the stream with its flags."""
    return spark.read.parquet(f"{out_dir}/scored").drop("batch_id")


def utc_text(col: str):
    """A timestamp as UTC text with six decimals, whatever the session's zone."""
    us = F.unix_micros(col)
    frac = F.pmod(us, F.lit(1_000_000))
    day = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=((us - frac) / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.concat(F.substring(day.cast("string"), 1, 19), F.lit("."), F.lpad(frac.cast("string"), 6, "0"), F.lit("+00:00"))


def alerts(scored: DataFrame) -> DataFrame:
    """T3 + S11: alert records of rows where some layer fired."""
    ml = F.col("ml_score") if "ml_score" in scored.columns else F.lit(None).cast("double")
    return scored.filter(F.size("layers") > 0).select(
        utc_text("timestamp").alias("timestamp"),
        F.col("case_id").cast("bigint").alias("case_id"),
        F.col("row_idx").cast("bigint").alias("row_idx"),
        "layers", "reasons", ml.alias("ml_score"), F.col("label").cast("int").alias("label"))


def format_alert(alerts_df: DataFrame) -> DataFrame:
    """One console line per alert (score with 3 decimals or '-', layers
    joined by '+', [TP]/[FP] tag when the label is known)."""
    score = F.when(F.col("ml_score").isNull(), F.lit("-")).otherwise(
        F.format_string("%.3f", F.col("ml_score")))
    layers = F.when(F.size("layers") > 0, F.array_join("layers", "+")).otherwise(F.lit("-"))
    tag = F.when(F.col("label") == 1, F.lit("  [TP]")).when(F.col("label").isNotNull(), F.lit("  [FP]")) \
        .otherwise(F.lit(""))
    reasons = F.when(F.col("reasons") == "", F.lit("-")).otherwise(F.col("reasons"))
    return alerts_df.select(F.concat(
        F.lit("[ALERT "), F.col("timestamp"), F.lit("] case="), F.col("case_id").cast("string"),
        F.lit(" row="), F.col("row_idx").cast("string"), F.lit(" layers="), layers,
        F.lit(" score="), score, F.lit(" reasons="), reasons, tag).alias("line"))


COUNTERS = ("n_samples", "n_alerts", "n_late", "tp", "fp", "fn", "tn")


def counters(scored: DataFrame) -> DataFrame:
    """T4 counters of a (micro-)batch; a missing label counts only as a sample."""
    a = F.size("layers") > 0
    lab = F.col("label")
    late = F.col("late") if "late" in scored.columns else F.lit(False)
    return scored.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(a).alias("n_alerts"), F.count_if(late).alias("n_late"),
        F.count_if(a & (lab == 1)).alias("tp"), F.count_if(a & (lab == 0)).alias("fp"),
        F.count_if(~a & (lab == 1)).alias("fn"), F.count_if(~a & (lab == 0)).alias("tn"))


def read_metrics(spark, path: str) -> DataFrame:
    """Running totals over all batches + precision / recall / F1."""
    tot = spark.read.parquet(path).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])
    return with_ratios(tot)


def with_ratios(agg: DataFrame) -> DataFrame:
    p = F.when((F.col("tp") + F.col("fp")) > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when((F.col("tp") + F.col("fn")) > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return agg.select("*", p.alias("precision"), r.alias("recall"),
                      F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def fan_out(targets: dict[str, str], fmt: str = "json"):
    """``foreachBatch`` writer to several folders, idempotent per batch id.

    Each batch lands in ``<target>/batch_id=<id>`` with overwrite, so a
    replayed batch replaces its own output instead of duplicating it.
    """
    def write(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            for path in targets.values():
                batch.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write

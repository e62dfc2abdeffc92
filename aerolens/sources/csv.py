"""Telemetry CSV ingest.

* every column is read as STRING and bound by the header of its own file
  (files may differ in column order; a column that some files lack is NULL
  there), then typed with ``try_cast`` -> bad tokens become NULL, ``NaN`` text
  becomes NULL (NaN would compare greater than any bound); whole numbers are
  not passed through doubles;
* timestamps are ISO 8601, with or without a fraction; a text without an
  offset is UTC in any session zone; an unparsable one becomes NULL;
* blank lines are skipped, also before the header;
* rows with ``row_idx`` 0 (or missing) are dropped;
* ``_ord`` = ingest ordinal, the stable tie-break for equal ``row_idx``: files
  in the order of their paths, rows in the order of the file;
* ``t_rel`` = seconds since the flight's first timestamp.

No global sort: flight order is imposed by the operators' windows.  Use
``sort_flights`` (O1) for presentation only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.functions.text import nan_to_null
from aerolens.operators.segments import with_t_rel
from aerolens.schema import DEFAULT_FLIGHT_KEYS, REQUIRED_COLUMNS, TELEMETRY_SCHEMA

_TYPES = {f.name: f.dataType for f in TELEMETRY_SCHEMA.fields}
_DOUBLE_COLS = ("latitude", "longitude", "altitude", "speed", "heading")


ORD = "_ord"
#: bits of ``_ord`` for the place within a file (4 TB)
_FILE_BITS = 42


def _first_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first line of each file that isn't blank, read by the driver (one line a file)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
        out[f] = line or ""
        reader.close()
    return out


def _names(spark: SparkSession, line: str) -> list[str]:
    """Column names of a header line, parsed as Spark parses CSV."""
    row = spark.createDataFrame([(line.lstrip("\ufeff"),)], "value string")
    width = line.count(",") + 1
    parsed = row.select(F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width)))).alias("r")).select("r.*").first()
    return [x for x in parsed if x is not None]


def read_raw_csv(spark: SparkSession, path, usecols: Iterable[str] | None = None, order: bool = False) -> DataFrame:
    """Header CSV, all columns STRING, bound by each file's own header.

    Spark raises on a missing path.  ``order`` adds the ingest ordinal ``_ord``.
    """
    files = sorted(spark.read.text(path).inputFiles())
    lines = _first_lines(spark, files)
    groups: dict[str, list[str]] = {}
    for f in files:
        if lines[f]:
            groups.setdefault(lines[f], []).append(f)
    if not groups:
        raise ValueError(f"No header in {path}")
    one_slash = lambda c: F.regexp_replace(c, "^(\\w+):/+", "$1:/")
    ranks = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "_f string, _rank bigint").withColumn("_f", one_slash("_f"))
    df = None
    for line, own in groups.items():
        schema = ", ".join(f"`{n}` string" for n in _names(spark, line))
        part = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
                .option("enforceSchema", False).csv(own))
        if order:
            # whole splits have a scan partition of their own, so block start + row number keeps the order of the file
            place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)
            part = part.select("*", one_slash("_metadata.file_path").alias("_f"), place.alias("_place"))
            part = part.join(F.broadcast(ranks) if len(files) <= 100_000 else ranks, "_f", "left")
            part = part.withColumn(ORD, F.col("_rank") * F.lit(1 << _FILE_BITS) + F.col("_place")).drop("_f", "_rank", "_place")
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if usecols is not None:
        cols = list(usecols)
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"Columns not in file: {sorted(missing)}")
        df = df.select(*cols, *([ORD] if order else []))
    return df


def check_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """S3: ``ValueError`` listing the missing required columns."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"Missing columns in dataset: {sorted(missing)}")
    return df


def coerce_numeric(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """numeric columns via ``try_cast`` (bad -> NULL, NaN -> NULL).

    Already-numeric columns are only NaN-cleaned.
    """
    cols = [c for c in (cols or list(_DOUBLE_COLS) + ["row_idx", "replicate", "label",
                                                      "case_id", "original_row_idx"])
            if c in df.columns]
    out = {}
    for c in cols:
        target = _TYPES.get(c, None)
        as_double = F.expr(f"try_cast(`{c}` as double)")
        if target is not None and target.typeName() in ("integer", "long"):
            # '3.0' is a valid integer in a CSV written by pandas; ids above 2**53 stay exact
            kind = target.simpleString()
            out[c] = F.expr(f"coalesce(try_cast(`{c}` as {kind}), try_cast(try_cast(`{c}` as double) as {kind}))")
        else:
            out[c] = nan_to_null(as_double)
    return df.withColumns(out)


def parse_timestamp(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """ISO 8601, variable fraction; without an offset UTC; bad -> NULL."""
    if col not in df.columns or dict(df.dtypes)[col] in ("timestamp", "timestamp_ntz"):
        return df
    text = F.trim(F.col(col))
    zoned = text.rlike(r":\d{2}(\.\d+)?\s*(Z|z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$")
    utc = F.when(zoned, text).when(text.contains(":"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return df.withColumn(col, F.try_to_timestamp(utc))


def drop_row_zero(df: DataFrame) -> DataFrame:
    """keep ``row_idx > 0`` (a missing row_idx is dropped too)."""
    return df.filter(F.col("row_idx") > 0)


def load_dataset(spark: SparkSession, path, usecols: Iterable[str] | None = None,
                 flight_keys=DEFAULT_FLIGHT_KEYS) -> DataFrame:
    """Full ingest: raw read -> checks -> typing -> row filter -> _ord, t_rel."""
    df = read_raw_csv(spark, path, usecols, order=True)
    if usecols is None:
        check_columns(df)
    for c in ("timestamp", "row_idx", "case_id"):
        if c not in df.columns:
            raise ValueError(f"Column {c!r} is required")
    df = coerce_numeric(df)
    for c in ("profile", "case_name", "tamper_type", "source"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("string"))
    df = parse_timestamp(df)
    df = drop_row_zero(df)
    keys = [k for k in flight_keys if k in df.columns]
    return with_t_rel(df, keys)


def split_by_replicate(df: DataFrame, test_replicate: int = 3) -> tuple[DataFrame, DataFrame]:
    """(train, test); a NULL replicate goes to train (NULL != r is true there)."""
    is_test = F.col("replicate").eqNullSafe(F.lit(test_replicate))
    return df.filter(~is_test), df.filter(is_test)


def clean_subset(df: DataFrame) -> DataFrame:
    """rows without anomaly (label = 0)."""
    return df.filter(F.col("label") == 0)


def sort_flights(df: DataFrame) -> DataFrame:
    """O1: presentation order (case_id, row_idx, _ord)."""
    cols = [c for c in ("case_id", "row_idx", "_ord") if c in df.columns]
    return df.orderBy(*cols)


def write_curated(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Curated Parquet partitioned by replicate (test split = partition pruning)."""
    df.write.mode(mode).partitionBy("replicate").parquet(path)

"""Helpers shared by the corpus operators: input tables, shared scratch
tables, two-level numbering and connected components.

Intermediate tables are written as Parquet under the shared folder that
``spark.checkpoint.dir`` names, so that a lost executor costs the running
tasks and not the finished steps.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from aerolens.session import checkpoint_dir, ship_package

#: rows per Arrow batch handed to Python workers; texts can be long
ARROW_ROWS = 256
#: ids up to this count (16 bytes each) may be broadcast; beyond, the join shuffles
BROADCAST_IDS = 200_000
#: buckets of the two-level numbering
NUMBER_BUCKETS = 64


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the Arrow batches."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run meanwhile hand ``rows`` rows a batch to Python workers (for narrow rows of numbers)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: if set, scratch() notes its paths here
_noted: list[str] | None = None


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/aerolens-{tag}-{uuid.uuid4().hex[:12]}"
    if _noted is not None:
        _noted.append(path)
    return path


@contextlib.contextmanager
def noting(paths: list[str]):
    """Scratch paths made meanwhile are added to ``paths``."""
    global _noted
    before, _noted = _noted, paths
    try:
        yield
    finally:
        _noted = before


def materialise(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back (cuts the lineage).

    ``rows``: an upper bound that is known; few rows are written by few tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    if rows is not None:
        df = df.coalesce(max(8, rows // 100_000))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_IDS) -> DataFrame:
    """``df`` marked for broadcast if its counted (or bounded) ``rows`` allow it; else as it is, to be shuffled."""
    return F.broadcast(df) if rows <= bound else df


def remove(df: DataFrame) -> None:
    """Delete the scratch files of a table made by :func:`materialise`."""
    delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch folders (no others)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        if "/aerolens-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, by: list[str], order: list[str], out: str,
             levels: list[str] | None = None, buckets: int = NUMBER_BUCKETS, few: bool = False) -> DataFrame:
    """Number the rows of each ``by`` group 0, 1, ... without one task per group.

    Rows of a group are dealt to ``buckets`` by the hash of the ``order``
    columns; a small table of counts (groups x levels x buckets) gives each
    bucket its offset, and only the rows of a bucket are sorted together.
    ``levels`` order the rows before the hash does.  Equal rows get different
    numbers in any order.  Group columns may be null.  ``few``: the caller knows
    that there are few groups and levels, so the offsets are broadcast.
    """
    levels = levels or []
    b = "_num_bucket"
    d = df.withColumn(b, F.pmod(F.xxhash64(F.lit(17), *order), F.lit(buckets)).cast("int"))
    keys = [*by, *levels, b]
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_num_n"))
    w = W.partitionBy(*by).orderBy(*levels, b).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
                            F.coalesce(F.sum("_num_n").over(w), F.lit(0)).alias("_num_off"))
    inner = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(23), *order), *order)
    d = d.withColumn("_num_rn", F.row_number().over(inner))
    on = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)]
    d = d.join(F.broadcast(offsets) if few else offsets, on, "left")
    return (d.withColumn(out, (F.col("_num_off") + F.col("_num_rn") - 1).cast("bigint"))
            .drop(b, "_num_rn", "_num_off", *[f"_o{i}" for i in range(len(keys))]))


def connected_components(edges: DataFrame, max_rounds: int = 60, bound: int = BROADCAST_IDS) -> DataFrame:
    """(node, comp) for the nodes of ``edges(u, v)``; comp = smallest node reachable
    (that node itself has no row).

    Alternating large-star and small-star rounds: joins and minima only, the
    edge table of each round written to the shared folder.  While there are
    at most ``bound`` edges, the minima are broadcast.
    """
    def state_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                                F.least("u", "v").alias("v")).distinct(), "cc")
    state = state_of(e)
    for _ in range(max_rounds):
        n = state[0]                          # no round makes more edges than there were
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small(m, 2 * n, bound), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = (large.join(small(m2, 2 * n, bound), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(m2.select("u", F.col("m").alias("v"))).where("u <> v"))
        nxt = materialise(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", 2 * n)
        remove(e)
        e, now = nxt, state_of(nxt)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))

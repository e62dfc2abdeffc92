"""SparkSession helpers.

The library never creates a session behind the caller's back; these helpers
are for scripts, tests and the benchmark.  Settings that the cluster owns
(``spark.checkpoint.dir``) are read from the session and only filled in when
unset, so a cluster-provided shared folder always wins.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "aerolens",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session has none (local tests) a fresh folder under
    ``fallback`` (or the system temp dir) is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if fallback is None and not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = fallback or tempfile.gettempdir()
    os.makedirs(base, exist_ok=True)
    path = tempfile.mkdtemp(prefix="aerolens-ckpt-", dir=base)
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind (Spark keeps them until the driver collects its garbage)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``aerolens`` importable in Python workers (pandas UDFs, grouped
    map, stream state): a zip of the package is added with ``addPyFile``
    once per application.  Harmless when the package is installed on the
    workers already.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import aerolens
    root = os.path.dirname(os.path.abspath(aerolens.__file__))
    base = os.path.dirname(root)
    folder = checkpoint_dir(spark)
    if "://" in folder and not folder.startswith("file:"):
        folder = tempfile.mkdtemp(prefix="aerolens-pkg-")   # staging only; Spark ships it
    folder = folder.replace("file://", "").replace("file:", "")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"aerolens-{key}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SHIPPED.add(key)

"""Session settings shared by tests, bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: What Python workers start with, so that they give freed memory back instead of holding it between tasks and stages.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(2 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "quernstone") -> SparkSession:
    """A local session with the settings the queries assume (UTC, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUERNSTONE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where the driver has it.

    Also switches off one optimisation of Spark 4.1: a union of two inputs dealt out by the same key counts as dealt out
    by that key, but adaptive execution may coalesce the inputs' partitions differently, and an aggregate over the union
    then gives a key twice. Batches that go to Python are bounded in bytes, so that long texts don't add up in a worker, and
    workers get WORKER_MEMORY unless the session says otherwise.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)
    return spark

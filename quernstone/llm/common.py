"""What several operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is unset, a local session gets a folder of this machine, remembered in the session; any other
    session raises, as its executors would each write to a disk of their own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table read back.

    This cuts the lineage in a way that a lost executor doesn't undo. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quernstone-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def unused(taken: list[str], *names: str) -> list[str]:
    """Names like those given that no column in taken has, whatever their case."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name in lower:
            name = f"_{name}"
        lower.add(name)
        out.append(name)
    return out

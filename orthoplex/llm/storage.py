"""Written intermediates in the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and all threads are in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.gettempdir() + "/orthoplex-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application's intermediates are."""
    return f"{shared_dir(spark)}/orthoplex/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str) -> str:
    """Writes a table that every executor can read; its lineage ends here, so a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    path = write(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediates that nothing reads any more, in whatever store they are."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediates of this application; DataFrames that read them are void afterwards."""
    remove(spark, session_dir(spark))


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever they were started; a cluster ships it as usual."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, root]))

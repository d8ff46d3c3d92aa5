"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _test_dir() -> str:
    """One folder a process, for sessions whose executors are threads of the driver; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="lodestack-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _test_dir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder in it for what this application writes."""
    return f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}"


#: Whether a query's shuffle files go when it ends, in place of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table: computed once, with its lineage cut, and safe when executors are lost. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path, before = f"{own_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application. Results that were not saved elsewhere are gone with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Intermediate tables in the folder that all executors share."""

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder, and only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found if found else _local_dir(spark.sparkContext.master)


@lru_cache(maxsize=1)
def _local_dir(master: str) -> str:
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


_made: list[str] = []


def drop_intermediate(spark: SparkSession) -> None:
    """Remove every intermediate table written so far; results that still read one are lost, so take them first."""
    while _made:
        _drop(spark, _made.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage and avoids a second computation. Unlike a checkpoint
    it computes ``df`` only once, and unlike a cache it outlives executors.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"tickloom-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not _made:
        atexit.register(drop_intermediate, spark)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)

"""Results that are computed once and kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that fresh() has named in this process.
_named: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one of our own, which serves as long as driver and executors are one machine, and goes when the process ends."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def once(df: DataFrame) -> DataFrame:
    """df computed now, with its lineage cut by a reliable checkpoint: for tables that several branches of a plan read.

    Its files stay as long as Spark keeps them: with spark.cleaner.referenceTracking.cleanCheckpoints until df is no longer referred to, else
    until the shared folder is cleared.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which clean() removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> int:
    """Remove what fresh() has named so far; results that still read it must be written before. How many there were."""
    n = len(_named)
    while _named:
        remove(spark, _named.pop())
    return n

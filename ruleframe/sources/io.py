"""Parquet I/O, no-op sink and actions, with cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Set here only when a local session has none (tests): then a fresh local
    folder is used.  On a cluster a session without one raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # sessions without a SparkContext (Spark Connect)
            d = None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        # ``spark.checkpoint.dir`` is a core setting that a running session
        # may not change; the context's checkpoint folder can still be set.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ruleframe-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()  # the folder Spark made inside, same on every call
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by the file system when the driver ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_noop(df: DataFrame) -> None:
    """Evaluate every column of every row and throw the output away."""
    df.write.format("noop").mode("overwrite").save()


def cache_count(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist (memory, spilling to disk) and count; the persisted frame is reused later."""
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    return p, p.count()


def count_evaluated(df: DataFrame, result_col: str) -> DataFrame:
    """Rows, and rows whose suite result failed, passed or stayed undecided.

    ``result_col`` is a rule vector (array<boolean>) or an audit struct.
    Failed = some rule FALSE; passed = every rule TRUE; undecided = no rule
    FALSE but some NULL (or no result).  Reading the outcome forces every
    rule to be evaluated: a plain ``count`` (or a count of the never-null
    result column) is folded to ``count(1)`` and prunes the rules away.
    One global aggregation, partial per task.
    """
    dtype = df.schema[result_col].dataType
    c = F.col(result_col)
    if isinstance(dtype, T.ArrayType):
        failed = F.array_contains(c, F.lit(False))
    else:
        names = {f.name for f in dtype.fields}
        failed = c.getField("any_failed" if "any_failed" in names else "overallResult")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(failed).alias("n_failed"),
                  F.count_if(~failed).alias("n_passed"),
                  F.count_if(failed.isNull()).alias("n_undecided"))

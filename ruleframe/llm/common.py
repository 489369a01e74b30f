"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.sources.io import scratch_path

# Texts handled at a time inside a task: bounds Python's copies of an Arrow batch.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (NULL id: NULL)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def texts(array):
    """Python strings of an Arrow string array, a bounded slice at a time; NULL is ''."""
    for at in range(0, len(array), SLICE_ROWS):
        for t in array.slice(at, SLICE_ROWS).to_pylist():
            yield t or ""


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package also when the driver was started in another folder.

    On a cluster the package is installed on the executors; the extra path then does nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def most_frequent(counts: DataFrame, key: str, n: str, rows: int) -> list:
    """Rows with the largest ``n``, at most ``rows``, largest first.

    A cut is taken from a histogram over 16 steps to each power of two, so
    that the driver is sent no more than that from all tasks together (a
    sorted limit sends as much from each task).  Rows tied in the step where
    the limit falls are left out.
    """
    step = F.floor(F.log2(F.col(n)) * 16).cast("int")
    total, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > rows:
            break
        cut = r["step"]
    if cut is None:
        return []
    return sorted(counts.where(step >= cut).select(key, n).collect(), key=lambda r: (-r[n], r[key]))


def integer_vectors(rows: DataFrame, vector_col: str, scale: int, out: str) -> DataFrame:
    """``rows`` whose vector can be used, with ``out``: floor(scale * component) as array<bigint>.

    NULL and empty vectors, and those that hold a NULL, NaN or infinite component, are dropped.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return (rows.where(vector.isNotNull() & sound)
            .withColumn(out, F.transform(vector, lambda x: F.floor(x * F.lit(scale).cast("double")))))


def largest(v: Column) -> Column:
    """Aggregate: the largest absolute component of integer vectors."""
    return F.max(F.greatest(F.array_max(v), -F.array_min(v)))

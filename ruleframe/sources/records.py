"""Benchmark record generator.

Each input key becomes 26 x 5 = 130 records: one per id prefix letter and
per seed row.  Built from ``explode`` of literal arrays, so generation is a
narrow, codegen'd projection of the key column (no driver loop, no shuffle)
and is deterministic, so lost partitions recompute to the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the benchmark's definitions) -----------------
# Seed rows: (location, page, department).
SEED_ROWS = (
    ("US", 1, "sales"),
    ("UK", 2, "marketing"),
    ("CH", 3, "hr"),
    ("MX", 4, "it"),
    ("BR", 5, "ops"),
)
# Id prefixes: the letters a..z.
PREFIX_FIRST, PREFIX_LAST = "a", "z"
# ---------------------------------------------------------------------------

PREFIXES = tuple(chr(c) for c in range(ord(PREFIX_FIRST), ord(PREFIX_LAST) + 1))
RECORDS_PER_KEY = len(PREFIXES) * len(SEED_ROWS)


def with_payloads(df: DataFrame, record_col: str = "f", keep: tuple[str, ...] = ()) -> DataFrame:
    """Record struct -> its fields, the JSON text ``payload`` and ``struct_payload``."""
    return df.select(*keep, f"{record_col}.*", F.to_json(record_col).alias("payload"),
                     F.col(record_col).alias("struct_payload"))


def record_struct(location: Column, id_prefix: Column, id_: Column, page: Column,
                  department: Column) -> Column:
    return F.struct(location.alias("location"), id_prefix.alias("idPrefix"), id_.alias("id"),
                    page.alias("page"), department.alias("department"))


def generate_records(keys: DataFrame, key_col: str = "id", id_type: str = "int",
                     num_partitions: int | None = None) -> DataFrame:
    """130 records per row of ``keys``; ``id`` is the key value.

    The output is 130x the input, so a few input partitions would make a
    few huge output tasks.  ``num_partitions`` spreads the key column first
    (a shuffle of the 130x smaller side).  Round robin, not a hash of the
    key: copies of one hot key would all land in one task under a hash.
    Spark sorts each input partition before a round-robin repartition
    (``spark.sql.execution.sortBeforeRepartition``), so a retried task
    sends the same rows to the same partitions.
    """
    if num_partitions:
        keys = keys.select(key_col).repartition(num_partitions)
    seeds = F.array(*[
        F.struct(F.lit(loc).alias("location"), F.lit(page).cast("bigint").alias("page"),
                 F.lit(dept).alias("department"))
        for loc, page, dept in SEED_ROWS
    ])
    letters = F.array(*[F.lit(c) for c in PREFIXES])
    recs = (keys.select(F.col(key_col).cast(id_type).alias("id"))
            .select("id", F.explode(letters).alias("idPrefix"))
            .select("id", "idPrefix", F.explode(seeds).alias("s"))
            .select(record_struct(F.col("s.location"), F.col("idPrefix"), F.col("id"),
                                  F.col("s.page"), F.col("s.department")).alias("f")))
    return with_payloads(recs)


def generated_row_count(rows: int) -> int:
    """Rows actually produced for a requested size (integer division per seed and letter)."""
    return rows // len(SEED_ROWS) // len(PREFIXES) * RECORDS_PER_KEY


def generate(spark: SparkSession, rows: int, num_partitions: int | None = None) -> DataFrame:
    """About ``rows`` records (see :func:`generated_row_count`)."""
    n = rows // len(SEED_ROWS) // len(PREFIXES)
    ids = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    return generate_records(ids, "id")  # range is already split evenly


def sweep_sizes(step: int = 100_000, max_rows: int = 1_000_000) -> list[int]:
    return list(range(step, max_rows + 1, step))


def write_sweep(spark: SparkSession, base_dir: str, sizes: list[int] | None = None,
                num_partitions: int | None = None) -> dict[int, str]:
    """Write one Parquet dataset of generated records per requested size.

    ``base_dir`` should be shared storage (e.g. below ``spark.checkpoint.dir``).
    Returns size -> path.  Each size is an independent narrow job.
    """
    paths = {}
    for n in sizes or sweep_sizes():
        path = f"{base_dir.rstrip('/')}/records_{n}_rows"
        generate(spark, n, num_partitions).write.mode("overwrite").parquet(path)
        paths[n] = path
    return paths

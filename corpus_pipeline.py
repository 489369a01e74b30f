"""A training-data pipeline over ``documents``: each stage calls one operator and works on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's result as Parquet in the shared folder and reads it as
the next one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm import decontam, linededup, packing, quality, simhash
from ruleframe.llm.common import importable, table, written
from ruleframe.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    rows = quality.ledger(docs.select(*COLUMNS))
    return rows.where(quality.kept(quality.POLICIES[-1], F.col("ledger.failed"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated chunks; n_chars follows the text."""
    rows = linededup.deduplicate(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint"))
                           .otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (no id: last), then the smallest hash of its columns."""
    docs = docs.select(*COLUMNS)
    mark = F.xxhash64("text", "lang", "source", "n_chars")
    groups = simhash.near_duplicates(docs, mark=mark)
    # counted by row first: copies of a row are one document
    rows = groups.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    stays = written(rows.groupBy("root").agg(F.min(order).alias("row"), F.max("n").alias("n"))
                    .select(F.col("row.doc_id").alias("id"), F.col("row.mark").alias("mark"), "n"), "stays")
    kept = (docs.withColumn("mark", mark).join(
        stays.withColumnRenamed("mark", "own"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own")),
        "left_semi").drop("mark"))
    return kept if stays.where("n > 1").isEmpty() else kept.dropDuplicates()


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    rows = decontam.search(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return rows.where(~decontam.contaminated()).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("packing", pack)]

# Line hashes, SimHash and tokenizing can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

"""Physical plans stay narrow and JVM-side; streams give batch results."""

import os


from ruleframe.operators.runner import run_rules, with_vector
from ruleframe.plans.inspect import plan_text
from ruleframe.sources.bindings import bind_json
from ruleframe.sources.io import scratch_path, write_parquet
from ruleframe.sources.records import generate
from ruleframe.sources.tables import customer_records
from ruleframe.streaming import stream_rules
from ruleframe.suites import sql_suite

from conftest import SF001


def test_rule_runner_plan_is_narrow_codegen(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = run_rules(spark, generate(spark, 13000), sql_suite())
        t = plan_text(out, "simple")
        assert "Exchange" not in t
        assert "*(1) Project" in t
        assert "PythonUDF" not in t and "BatchEvalPython" not in t and "ArrowEvalPython" not in t
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_customer_binding_broadcasts_nation_and_prunes(spark):
    out = with_vector(spark, customer_records(spark, SF001), sql_suite()).select("key", "quality")
    t = plan_text(out)
    assert "BroadcastHashJoin" in t
    assert "SortMergeJoin" not in t
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in t


def test_stream_equals_batch(spark):
    base = scratch_path(spark, "stream")
    src = os.path.join(base, "src")
    g = generate(spark, 2600).select("location", "idPrefix", "id", "page", "department", "payload")
    write_parquet(g, src)
    schema = "location STRING, idPrefix STRING, id INT, page BIGINT, department STRING, payload STRING"
    q = stream_rules(spark, src, schema, sql_suite(), os.path.join(base, "sink"), os.path.join(base, "ckpt"),
                     binding=bind_json("payload"), vector_only=True)
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(base, "sink")).select("id", "idPrefix", "location", "quality")
    batch = with_vector(spark, spark.read.parquet(src), sql_suite(), bind_json("payload")).select(
        "id", "idPrefix", "location", "quality")
    assert streamed.count() == batch.count() == 2600
    assert streamed.exceptAll(batch).count() == 0


def test_join_of_a_stream_with_hot_and_null_keys(spark):
    """The stream-static join by shuffle gives the batch rows."""
    from pyspark.sql import functions as F

    from ruleframe.operators.joins import join_small
    from ruleframe.streaming import run_to_parquet

    base = scratch_path(spark, "stream-skew")
    src = os.path.join(base, "src")
    rows = spark.range(3000).select(F.col("id").alias("rid"),
                                    F.when(F.col("id") < 1000, F.lit(5)).when(F.col("id") < 1200, F.lit(None))
                                    .otherwise(F.col("id") % 50).cast("int").alias("k"))
    write_parquet(rows, src)
    small = spark.range(50).select(F.col("id").cast("int").alias("sk"), (F.col("id") * 10).alias("v"))
    stream = spark.readStream.schema("rid bigint, k int").parquet(src)
    joined = join_small(stream, small, [("k", "sk")], how="left", limit=0)
    assert joined.isStreaming
    run_to_parquet(joined.select("rid", "v"), os.path.join(base, "sink"), os.path.join(base, "ckpt"), 120)
    got = spark.read.parquet(os.path.join(base, "sink"))
    want = spark.read.parquet(src).join(small, F.col("k") == F.col("sk"), "left").select("rid", "v")
    assert got.count() == 3000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

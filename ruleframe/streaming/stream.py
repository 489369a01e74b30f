"""Evaluate a suite on a stream.

Every suite operator is a stateless per-row projection, so it runs
unchanged on a streaming DataFrame: no watermark or state store is needed,
and the file sink with a checkpoint gives exactly-once output that
survives a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ruleframe.model import RuleSuite
from ruleframe.operators.runner import run_rules, with_vector
from ruleframe.sources.bindings import Binding


def rules_on_stream(spark: SparkSession, stream: DataFrame, suite: RuleSuite, binding: Binding | None = None,
                    out: str = "quality", vector_only: bool = False) -> DataFrame:
    if vector_only:
        return with_vector(spark, stream, suite, binding, out)
    return run_rules(spark, stream, suite, binding, out)


def stream_rules(spark: SparkSession, source_dir: str, schema: str, suite: RuleSuite, sink_dir: str,
                 checkpoint_dir: str, binding: Binding | None = None, out: str = "quality",
                 vector_only: bool = False, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Parquet files in ``source_dir`` -> rule result appended -> Parquet in ``sink_dir``.

    ``checkpoint_dir`` must be on shared storage on a cluster; a restarted
    query resumes from it.  ``available_now`` processes what is there and stops.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    result = rules_on_stream(spark, stream, suite, binding, out, vector_only)
    w = (result.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_parquet(stream: DataFrame, sink_dir: str, checkpoint_dir: str, timeout_sec: float | None = None) -> None:
    """Run a streaming frame over what its source holds now (``availableNow``) into Parquet.

    The checkpoint makes the run restartable: a rerun after a failure
    continues from the last committed batch instead of rewriting output.
    """
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    if timeout_sec is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_sec):
        q.stop()  # a partial sink must not be read as the result
        raise TimeoutError(f"streaming query did not finish in {timeout_sec} s")
    if q.exception() is not None:
        raise RuntimeError(f"streaming query failed: {q.exception()}")

"""Shape results: flatten, make maps comparable, distinct, per-rule counts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.model import RuleSuite
from ruleframe.operators.runner import null_without_vector, suite_result, with_vector
from ruleframe.sources.bindings import Binding, bind_fields


def flatten_vector(vector: Column, n: int, prefix: str = "r", first: int = 1) -> list[Column]:
    """Vector elements as columns prefix1..prefixN."""
    return [F.get(vector, F.lit(i)).alias(f"{prefix}{i + first}") for i in range(n)]


def flatten_audit(result: Column, set_id: int, rule_ids: Sequence[int], compat: bool = False,
                  prefix: str = "r") -> list[Column]:
    """Audit struct -> overall, set result and one column per rule key."""
    top, set_f = ("overallResult", "setResult") if compat else ("any_failed", "any_failed")
    s = result.getField("ruleSets")[F.lit(set_id).cast("bigint")]
    rules = s.getField("rules")
    return ([result.getField(top).alias("overall"), s.getField(set_f).alias("set_result")]
            + [rules[F.lit(k).cast("bigint")].alias(f"{prefix}{k}") for k in rule_ids])


def comparable(col: Column, dtype: T.DataType) -> Column:
    """Same value with every map turned into a key-sorted array of entries.

    Maps cannot be compared, so distinct/set operations reject them; sorted
    entry arrays can be grouped and compared.  Recurses through structs,
    arrays and map values.
    """
    if isinstance(dtype, T.MapType):
        vt = dtype.valueType
        inner = F.transform_values(col, lambda k, v: comparable(v, vt)) if _has_map(vt) else col
        # sort_array: ordered by key; codegen'd, unlike array_sort's comparator lambda
        return F.sort_array(F.map_entries(inner))
    if isinstance(dtype, T.StructType):
        if not _has_map(dtype):
            return col
        out = F.struct(*[comparable(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(col.isNull(), F.lit(None)).otherwise(out)
    if isinstance(dtype, T.ArrayType) and _has_map(dtype.elementType):
        et = dtype.elementType
        return F.transform(col, lambda x: comparable(x, et))
    return col


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return False


def distinct_results(df: DataFrame, col: str, out: str = "result") -> DataFrame:
    """Distinct values of a (possibly map-typed) result with their row counts.

    A grouping aggregation: partial counts are combined map-side before the
    shuffle, so a value shared by most rows costs one row per task.
    """
    dtype = df.schema[col].dataType
    return df.groupBy(comparable(F.col(col), dtype).alias(out)).agg(F.count(F.lit(1)).alias("n"))


def distinct_suite_results(spark: SparkSession, df: DataFrame, suite: RuleSuite, binding: Binding | None = None,
                           compat: bool = False, out: str = "result") -> DataFrame:
    """Distinct audit results of ``suite`` over ``df`` with their row counts.

    Same output as :func:`distinct_results` over :func:`run_rules`, but the
    rows are grouped by their rule vector (an array<boolean>: cheap to hash
    and compare; partial counts per task) and the audit and its comparable
    form are built for the distinct vectors only, since the audit is a
    function of the vector.  The comparable forms are grouped once more
    because different vectors can give one audit (the compatible layout does
    not show rule 1).  Making nested maps comparable per row runs
    interpreted higher-order functions; this way it runs per distinct vector.
    """
    b = binding or bind_fields()
    v = with_vector(spark, df, suite, b, out="__v")
    per_vector = v.groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    res = per_vector.select(suite_result(F.col("__v"), suite, compat, null_without_vector(b), whole=True).alias("__r"), "__n")
    dtype = res.schema["__r"].dataType
    return res.groupBy(comparable(F.col("__r"), dtype).alias(out)).agg(F.sum("__n").alias("n"))


def padded(vector: Column, n: int) -> Column:
    """The vector with exactly ``n`` elements: a NULL or short vector is filled up with NULL results."""
    none = F.array().cast("array<boolean>")
    return F.slice(F.concat(F.coalesce(vector, none), F.array_repeat(F.lit(None).cast("boolean"), n)), 1, n)


def _counts_by_position(df: DataFrame, vector: str, n: int) -> DataFrame:
    """(position, n_true, n_false, n_null): rows are grouped by their vector first (partial counts per task),
    and only distinct vectors are spread over the rules, whatever their number."""
    per_vector = df.groupBy(F.col(vector).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = per_vector.select("n", F.posexplode(padded(F.col("v"), n)).alias("position", "r"))
    zero = F.lit(0).cast("bigint")
    return pairs.groupBy("position").agg(
        F.sum(F.when(F.col("r"), F.col("n")).otherwise(zero)).alias("n_true"),
        F.sum(F.when(~F.col("r"), F.col("n")).otherwise(zero)).alias("n_false"),
        F.sum(F.when(F.col("r").isNull(), F.col("n")).otherwise(zero)).alias("n_null"))


def _with_counts(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """Every rule of ``meta`` (by position) with its counts, zero where there was no row."""
    counts = F.broadcast(counts.withColumnRenamed("position", "at"))  # at most one row for each rule
    zero = F.lit(0).cast("bigint")
    return (meta.join(counts, meta["position"] == counts["at"], "left").drop("at", "position")
            .withColumns({c: F.coalesce(c, zero) for c in ("n_true", "n_false", "n_null")}))


def rule_counts(df: DataFrame, vector: str, rule_ids: Sequence[int]) -> DataFrame:
    """Per element of the vector: rows TRUE, FALSE and NULL, as (rule_id, n_true, n_false, n_null).

    One row for each given id, in any number, equal ids included; an empty
    frame gives zeros, a NULL vector counts as NULL for every rule.
    """
    meta = df.sparkSession.createDataFrame(list(enumerate(rule_ids)), "position int, rule_id int")
    return _with_counts(meta, _counts_by_position(df, vector, len(rule_ids)))


def suite_counts(df: DataFrame, vector: str, suite: RuleSuite) -> DataFrame:
    """Counts per rule of a suite, under the full identity: suite, set and rule ids with their versions."""
    meta = suite.metadata(df.sparkSession).drop("expr")
    return _with_counts(meta, _counts_by_position(df, vector, len(suite.rules())))


def explode_results(df: DataFrame, key: str, vector: str, rule_ids: Sequence[int]) -> DataFrame:
    """(key, rule_id, result) rows: one per record and rule, also where the vector is NULL or short."""
    ids = F.array(*[F.lit(r) for r in rule_ids])
    zipped = F.arrays_zip(ids.alias("rule_id"), padded(F.col(vector), len(rule_ids)).alias("result"))
    return df.select(key, zipped.alias("z")).select(key, F.explode("z").alias("e")).select(key, "e.rule_id", "e.result")

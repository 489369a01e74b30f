"""Three-valued logic, blanks, unknown groups."""

from pyspark.sql import functions as F

from ruleframe.functions.columns import applicable_for, is_missing
from ruleframe.functions.sql import register_functions
from ruleframe.operators.runner import with_vector
from ruleframe.suites import decision_suite, sql_suite

SCHEMA = "location string, idPrefix string, id string, page bigint, department string"


def test_is_missing_blank_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("s",), ("ss",), ("\t",), ("a b",)], "v string")
    got = [r[0] for r in df.select(is_missing(F.col("v"))).collect()]
    assert got == [True, True, True, False, False, True, False]


def test_sql_function_matches_column_builder(spark):
    register_functions(spark, sql_suite().functions)
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("s",)], "v string")
    a = [r[0] for r in df.select(F.expr("isMissing(v)")).collect()]
    b = [r[0] for r in df.select(is_missing(F.col("v"))).collect()]
    assert a == b


def test_null_location_and_department(spark):
    df = spark.createDataFrame([(None, "a", "1", 1, "sales"), ("US", "a", "1", 1, None), ("UK", "a", "1", 1, None)], SCHEMA)
    v = [r["quality"] for r in with_vector(spark, df, sql_suite()).collect()]
    # NULL location: membership NULL; AND with TRUE -> NULL, with FALSE -> FALSE
    assert v[0][0] is None and v[0][1] is False
    # US/NULL department: TRUE AND NULL -> NULL; UK not Non UK: FALSE AND NULL -> FALSE
    assert v[1][0] is None
    assert v[2][0] is False


def test_unknown_group_sql_false_decision_null(spark):
    df = spark.createDataFrame([("Asia", "US")], "grp string, location string")
    register_functions(spark, sql_suite().functions + decision_suite().functions)
    r = df.select(F.expr("`dq is applicable for`(grp, location)").alias("s"),
                  F.expr("`common.dq is applicable for`(grp, location)").alias("d"),
                  applicable_for(F.col("grp"), F.col("location")).alias("c"),
                  applicable_for(F.col("grp"), F.col("location"), unknown_empty=False).alias("cd")).first()
    assert r["s"] is False and r["d"] is None and r["c"] is False and r["cd"] is None


def test_missing_id_fires(spark):
    df = spark.createDataFrame([("US", "a", None, 1, "ops"), ("US", "a", "  ", 1, "hr"), ("US", "a", "7", 1, "sales")], SCHEMA)
    v = [r["quality"] for r in with_vector(spark, df, sql_suite()).collect()]
    assert v[0][4] is True
    assert v[1][14] is True
    assert v[2][9] is False


def test_pandas_rule_hook(spark):
    from ruleframe.functions.python import pandas_rule
    from ruleframe.model import Id, Rule, RuleSet, RuleSuite

    pandas_rule(lambda s: s.str.len() == 2, name="two_letters", spark=spark)
    suite = RuleSuite(Id(9, 1), (RuleSet(Id(1, 1), (Rule(Id(1, 1), "two_letters({location})"),)),))
    df = spark.createDataFrame([("US",), ("USA",)], "location string")
    got = [r["quality"][0] for r in with_vector(spark, df, suite).collect()]
    assert got == [True, False]

"""Rules over other rules, nested paths, failing rules, rules from a frame, libraries, lossy types, wide suites."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ruleframe.functions.sql import register_functions
from ruleframe.functions.trying import null_on_error, row_guard
from ruleframe.model import FunctionDef, Id, Rule, RuleSet, RuleSuite, calls, fill, rename_calls
from ruleframe.operators.decision import Condition, DecisionModel, DecisionTable, lookup_frame, rule_hits
from ruleframe.operators.runner import WIDE, rule_vector, run_rules, with_vector
from ruleframe.plans.inspect import plan_text
from ruleframe.sources.bindings import bind_fields, bind_json, bind_struct, lossless, typed_record
from ruleframe.sources.io import read_parquet, scratch_path, write_parquet


def suite(*rules, functions=(), names=()):
    made = tuple(Rule(Id(i), t, dict(names).get(i)) for i, t in enumerate(rules, 1))
    return RuleSuite(Id(1), (RuleSet(Id(1), made),), tuple(functions))


def vector(spark, df, s, b=None):
    return [r.quality for r in with_vector(spark, df, s, b).collect()]


# ---- rules over other rules -----------------------------------------------

def test_entries_see_each_other_in_vector_audit_and_model(spark):
    s = suite("{v} > 3", "{r1} AND {v} < 9", "NOT {late}", "{r2} OR {r3}", "{v} = 12", names={5: "late"})
    df = spark.createDataFrame([(2,), (5,), (12,), (None,)], "v int")
    want = [[False, False, True, True, False], [True, True, True, True, False], [True, False, False, False, True], [None] * 5]
    assert vector(spark, df, s) == want
    assert [r.v for r in df.select(rule_vector(s, bind_fields()).alias("v")).collect()] == want
    audits = run_rules(spark, df, s).collect()
    assert [[r.quality.ruleSets[1].rules[i] for i in range(1, 6)] for r in audits] == want
    got = DecisionModel(s).evaluate(spark, df, with_context=True).collect()
    assert [r.quality.evaluate for r in got] == want and got[1].quality.context.late is False
    assert df.columns == ["v"] and with_vector(spark, df, s).columns == ["v", "quality"]


def test_entries_over_json_with_errors(spark):
    s = suite("int({v}) > 3", "{r1} OR {w} = 1", "{r1} IS NULL")
    df = spark.createDataFrame([('{"v": "5", "w": 0}',), ('{"v": "x", "w": 1}',), ('{"v": "x", "w": 0}',)], "t string")
    ddl = "v STRING, w INT"
    assert vector(spark, df, s, bind_json("t", ddl, errors_null="rule")) == [
        [True, True, False], [None, True, True], [None, None, True]]
    assert vector(spark, df, s, bind_json("t", ddl, errors_null="result")) == [[True, True, False], None, None]


def test_entry_names(spark):
    with pytest.raises(ValueError, match="rules need each other: r1 -> r2 -> r1|rules need each other: r2 -> r1 -> r2"):
        with_vector(spark, spark.range(1), suite("{r2}", "{r1}"))
    with pytest.raises(ValueError, match="names repeat"):
        with_vector(spark, spark.range(1), suite("{id} > 0", "{id} > 1", names={2: "R1"}))
    two = RuleSuite(Id(1), (RuleSet(Id(1), (Rule(Id(1), "{id} > 0"),)), RuleSet(Id(2), (Rule(Id(1), "NOT {s1_r1}"),))))
    assert vector(spark, spark.range(2), two) == [[False, True], [True, False]]
    # a field of the record goes before an entry of that name
    df = spark.createDataFrame([(1, False)], "id int, r1 boolean")
    assert vector(spark, df, suite("{id} > 0", "{r1}")) == [[True, False]]


def test_a_long_chain_is_evaluated_once_for_each_rule(spark):
    s = suite("{id} % 2 = 0", *[f"{{r{i}}} AND {{id}} >= {i} OR {{r{i}}}" for i in range(1, 40)])
    assert vector(spark, spark.range(2), s) == [[True] * 40, [False] * 40]


# ---- nested paths and names -----------------------------------------------

def test_only_the_named_leaves_are_read(spark):
    ddl = "a STRUCT<b: STRUCT<c: INT, d: STRING>, e: INT>, f ARRAY<STRUCT<g: INT, h: INT>>, m MAP<STRING, INT>, z INT"
    df = spark.createDataFrame([('{"a": {"b": {"c": 1}}}',)], "t string")
    for used, want in (({"a.B.c"}, "struct<a:struct<b:struct<c:int>>>"), ({"a.b", "a.b.c", "z"}, "struct<a:struct<b:struct<c:int,d:string>>,z:int>"),
                       ({"f.g", "m.x"}, "struct<f:array<struct<g:int>>,m:map<string,int>>"), ({"beside"}, None)):
        parsed = df.select(bind_json("t", ddl).parsed(used).alias("p")).schema["p"].dataType.simpleString()
        assert parsed == (want or df.select(F.from_json("t", ddl).alias("p")).schema["p"].dataType.simpleString())
    path = write_parquet(df.select(F.from_json("t", ddl).alias("s")), scratch_path(spark, "nested"))
    stored = with_vector(spark, read_parquet(spark, path), suite("{a.b.c} = 1", "{z} IS NULL"), bind_struct("s")).select("quality")
    assert "ReadSchema: struct<s:struct<a:struct<b:struct<c:int>>,z:int>>" in plan_text(stored, "simple")
    assert stored.first().quality == [True, True]


def test_paths_and_names_without_case(spark):
    row = '{"V": 5, "address": {"City": "x", "zip": 3}}'
    df = spark.createDataFrame([(row, (5, ("x", 3)), 5, ("x", 3))],
                               "t string, s struct<V: int, address: struct<City: string, zip: int>>, V int, "
                               "address struct<City: string, zip: int>")
    rules = suite("{v} = 5 AND {ADDRESS.city} = 'x'", "{address.zip} < 3")
    for b in (bind_fields(), bind_struct("s"), bind_json("t", "V INT, address STRUCT<City: STRING, zip: INT>")):
        assert vector(spark, df, rules, b) == [[True, False]], b.kind


def test_mapped_paths_and_dotted_column_names(spark):
    df = spark.createDataFrame([(("x", 1), "y")], "address struct<city: string, n: int>, `a.city` string")
    mapped = bind_fields({"city": "address.city", "other": "a.city", "quoted": "`a.city`", "place": "address"})
    rules = suite("{city} = 'x'", "{other} = 'y'", "{quoted} = 'y'", "{place.n} = 1", "{a.city} = 'y'")
    assert vector(spark, df, rules, mapped) == [[True] * 5]


# ---- failing rules ---------------------------------------------------------

FAILING = ["{v}::int > 3", "int({v}) > 3", "100 / {n} > 1", "to_date({v}) IS NULL", "date({v}) > DATE'2020-01-01'",
           "to_number({v}, '99') > 3", "array(1, 2)[{n}] = 1", "{v} > 3", "2147483647 + {n} > 0", "100 % {n} = 0",
           "element_at(map(1, true), {n} + 7)", "raise_error('no')", "cast({v} AS INT) = 1 OR cast({v} AS INT) = 5"]


@pytest.mark.parametrize("whole_stage", ["true", "false"])
def test_every_kind_of_failure_gives_null(spark, whole_stage):
    df = spark.createDataFrame([("abc", 0), ("5", 1)], "v string, n int").repartition(1)
    spark.conf.set("spark.sql.codegen.wholeStage", whole_stage)
    try:
        # each rule twice: what Spark would share between them must not run outside the try
        bad, good = vector(spark, df, suite(*FAILING, *FAILING), bind_fields(errors_null=True))[:2]
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
    if good[0] is None:
        bad, good = good, bad
    assert bad == [None, None, None, None, None, None, True, None, True, None, None, None, None] * 2
    assert good == [True, True, True, None, None, True, False, True, None, True, None, None, True] * 2
    assert vector(spark, df, suite("{n} >= 0", *FAILING[:2]), bind_fields(errors_null="result")) in (
        [None, [True] * 3], [[True] * 3, None])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        vector(spark, df, suite(*FAILING[:1]))
    with pytest.raises(ValueError, match="errors_null"):
        bind_fields(errors_null="never")


def test_results_that_fail_in_audits_and_models(spark):
    df = spark.createDataFrame([("abc",), ("5",)], "v string")
    s, b = suite("{v} > 3", "{v} IS NOT NULL"), bind_fields(errors_null="result")
    for compat in (False, True):
        assert [r.quality is None for r in run_rules(spark, df, s, b, compat=compat).collect()] == [True, False]
    out = DecisionModel(s).evaluate(spark, df, b).collect()
    assert out[0].quality is None and out[1].quality.evaluate == [True, True]
    each = DecisionModel(s).evaluate(spark, df, bind_fields(errors_null=True)).collect()
    assert each[0].quality.evaluate == [None, True]


def test_null_on_error_for_any_column(spark):
    df = spark.createDataFrame([(0, {"a": 1}), (4, {})], "k int, m map<string, int>")
    assert [r.x for r in df.select(null_on_error(F.expr("8 / k"), row_guard(df)).alias("x")).collect()] == [None, 2.0]
    assert row_guard(df.select("m")) is None


# ---- rules from a frame -----------------------------------------------------

def test_typed_conditions(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, True, day, 1.5, 1e20, Decimal("2.50"), -0.0, "a", dt.datetime(2024, 1, 1)), (2, False, None, 2.5, 3.0, None, 1.0, " ", None)],
        "k int, b boolean, d date, f float, g double, c decimal(9,2), z double, s string, t timestamp")
    rules = [Condition(1, {"b": (True,)}), Condition(2, {"d": (day, day)}), Condition(3, {"f": (1.5,)}), Condition(4, {"g": (1e20, 3.0)}),
             Condition(5, {"c": (Decimal("2.5"),)}), Condition(6, {"z": (0.0,)}), Condition(7, {"k": (1, 2), "b": (False,)}),
             Condition(8, {}, missing=("s",)), Condition(9, {"d": ()}), Condition(10, {"t": (dt.datetime(2024, 1, 1),)}),
             Condition(11, {"b": (True,)}, missing=("s",))]
    got = sorted(map(tuple, rule_hits(spark, df, rules, "k").collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 10), (2, 4), (2, 7), (2, 8)]
    assert rule_hits(spark, df, [], "k").collect() == []
    with pytest.raises(ValueError, match="different types"):
        rule_hits(spark, df, [Condition(1, {"s": ("a", 1)})], "k")


def test_rules_from_a_frame_equal_brute_force(spark):
    rng = random.Random(4)
    some = lambda values, none: rng.choice([*values, *[None] * none])
    records = [(i, some((1, 2, 3), 1), some(("a", "b", " ", ""), 1), some((True, False), 1)) for i in range(120)]
    rules = [(i, some(([1], [1, 2], [3, 3], []), 3), some(("a", "b", "5"), 3), some((True, False), 2), some((["s"], []), 1))
             for i in range(60)]
    df = spark.createDataFrame(records, "k int, n int, s string, b boolean")
    frame = spark.createDataFrame(rules, "rule_id int, n array<bigint>, s string, b boolean, missing array<string>")
    want = sorted((k, rid) for (k, n, s, b), (rid, rn, rs, rb, absent) in itertools.product(records, rules)
                  if (rn is None or n in rn) and (rs is None or s == rs) and (rb is None or b is rb)
                  and (not absent or s is None or not s.strip()))
    assert sorted(map(tuple, rule_hits(spark, df, frame, "k").collect())) == want


def test_a_million_rules(spark):
    rules = spark.range(1_000_000).select(F.col("id").alias("rule_id"), F.array("id", -F.col("id") - 1).alias("v"))
    df = spark.createDataFrame([(1, 7), (2, -8), (3, 10**7), (4, None)], "k int, v int")
    assert sorted(map(tuple, rule_hits(spark, df, rules, "k").collect())) == [(1, 7), (2, 7)]


# ---- libraries ---------------------------------------------------------------

def fn(name, body, version=1, fid=1):
    return FunctionDef(name, (("v", "INT"),), "BOOLEAN", body, Id(fid, version))


def test_calls_in_rule_text():
    text = "isBig({v}) AND `is big`( {w}) AND 'isBig(x)' = s AND other.isBig(1) -- isBig(2)\n AND `isBig` > 1"
    assert calls(text) == {"isbig", "is big"}
    assert rename_calls(text, {"isbig": "x y"}) == text.replace("isBig({v})", "`x y`({v})")
    assert fill("{a.b} {1,2} '{a}'", {"a.b": "q"}) == "q {1,2} '{a}'"


def test_the_users_function_survives(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION isBig(v INT) RETURNS BOOLEAN RETURN v > 1000")
    try:
        s = suite("isBig({id})", functions=[fn("isBig", "v > 0")])
        other = suite("ISBIG({id})", functions=[fn("isBig", "v > 1")])
        df = spark.range(3).select(F.col("id").cast("int").alias("id"))
        assert vector(spark, df, s) == [[False], [True], [True]]
        assert vector(spark, df, other) == [[False], [False], [True]]
        assert vector(spark, df, suite("isBig({id})")) == [[False]] * 3  # the session's own
        assert spark.sql("SELECT isBig(999)").first()[0] is False
    finally:
        spark.sql("DROP TEMPORARY FUNCTION isBig")


def test_functions_over_functions(spark):
    library = [fn("outer", "inner(v) AND v < 9"), fn("inner", "v > 3")]
    df = spark.range(12).select(F.col("id").cast("int").alias("id"))
    assert [v[0] for v in vector(spark, df, suite("outer({id})", functions=library))] == [3 < i < 9 for i in range(12)]
    register_functions(spark, [fn("rf_outer", "rf_inner(v) AND v < 9"), fn("rf_inner", "v > 3")])
    assert spark.sql("SELECT rf_outer(5)").first()[0] is True
    with pytest.raises(ValueError, match="functions need each other"):
        vector(spark, df, suite("a({id})", functions=[fn("a", "b(v)"), fn("b", "a(v)")]))


def test_imported_libraries_and_version_clashes(spark):
    base = suite("ok({id})", "lib.x({id}) = 1", functions=[fn("ok", "v > 3")])
    base = suite("ok({id})", "`lib.ok`({id})", "`lib.both`({id})", functions=[fn("ok", "v > 3")])
    newer = [fn("both", "ok(v) AND v < 9", fid=2), fn("ok", "v > 5", version=2)]
    with pytest.raises(ValueError, match="already defined.*version 1.*version 2"):
        base.with_functions(newer)
    both = base.with_functions(newer, "lib.")
    df = spark.range(12).select(F.col("id").cast("int").alias("id"))
    assert vector(spark, df, both) == [[i > 3, i > 5, 5 < i < 9] for i in range(12)]
    assert both.with_functions([fn("ok", "v > 3")]).functions == both.functions  # the same definition again
    assert both.uses() == {(1, 1): {"ok": True}, (1, 2): {"lib.ok": True}, (1, 3): {"lib.both": True, "lib.ok": False}}
    rows = {(r.function_name, r.function_version, r.rule_id, r.direct) for r in both.function_metadata(spark).collect()}
    assert rows == {("ok", 1, 1, True), ("lib.ok", 2, 2, True), ("lib.ok", 2, 3, False), ("lib.both", 1, 3, True)}
    changed = base.with_functions([fn("both", "ok(v) AND v < 9", fid=2), fn("ok", "v > 6", version=3)], "lib.")
    assert both.changed_rules(changed) == [(1, 2), (1, 3)] and both.changed_rules(both) == []
    unused = suite("{id} > 0", functions=[fn("ok", "v > 3")]).function_metadata(spark).collect()
    assert [(r.function_name, r.rule_id) for r in unused] == [("ok", None)]


# ---- lossy types, lost columns ----------------------------------------------

@pytest.mark.parametrize("value, kind, typ, ok", [
    (dt.datetime(2024, 1, 1, 10), "timestamp", "DATE", False), (dt.datetime(2024, 1, 1), "timestamp", "DATE", True),
    ("2024-01-01 10:00:00", "string", "DATE", False), ("2024-01-01", "string", "DATE", True), ("2024-02-30", "string", "DATE", False),
    ("1.239", "string", "DECIMAL(5,2)", False), ("1.230", "string", "DECIMAL(5,2)", True), ("1234567", "string", "DECIMAL(5,2)", False),
    ("16777217", "string", "FLOAT", False), ("16777216", "string", "FLOAT", True), ("0.1", "string", "FLOAT", True),
    ("0.1", "string", "DOUBLE", True), ("1e300", "string", "DOUBLE", True), ("abcdef", "string", "CHAR(3)", False),
    ("ab", "string", "CHAR(3)", True), ("ab   ", "string", "VARCHAR(3)", True), ("x", "string", "INT", False), ("007", "string", "INT", True),
    ("99999999999", "string", "INT", False), (16777217, "int", "FLOAT", False), (300, "int", "TINYINT", False), (1.5, "double", "INT", False),
    (2.0, "double", "INT", True), (Decimal("1.239"), "decimal(9,3)", "DECIMAL(5,2)", False), (2, "int", "BOOLEAN", False),
    (1, "int", "BOOLEAN", True), (12345, "int", "CHAR(3)", False), ("2024-01-01 00:00:00.1234567", "string", "TIMESTAMP", False),
    ("2024-01-01 00:00:00.123456", "string", "TIMESTAMP", True), (dt.datetime(2024, 1, 1, 0, 0, 0, 5), "timestamp", "BIGINT", False),
    ("yes", "string", "BOOLEAN", True), ("maybe", "string", "BOOLEAN", False), (float("nan"), "double", "FLOAT", True),
    (dt.date(2024, 1, 1), "date", "TIMESTAMP", True), (dt.date(2024, 1, 1), "date", "STRING", True), (None, "string", "INT", True)])
def test_loss_is_flagged(spark, value, kind, typ, ok):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    assert typed_record(df, [("v", typ)]).first()["type_ok"] is ok


def test_text_too_long_is_null(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",)], "v string")
    assert [r[0] for r in df.select(lossless(df, "v", "CHAR(3)")[0]).collect()] == [None, "abc"]


@pytest.mark.parametrize("column", ["input", "output", "__input", "__hit", "hits", "position"])
def test_decision_tables_keep_the_frames_columns(spark, column):
    df = spark.createDataFrame([("a", 1), ("z", 2)], f"k string, {column} int")
    t = DecisionTable("t", (("a", "x"), ("b", "y")), output_type="string")
    for out in (t.lookup(spark, df, "k", "res"), lookup_frame(df, spark.createDataFrame(
            [(0, "a", "x")], "position int, input string, output string"), "k", "res")):
        assert sorted(out.columns) == sorted(["k", column, "res"])
        assert sorted((r.k, r[column], r.res) for r in out.collect()) == [("a", 1, "x"), ("z", 2, None)]
    if column != "hits":
        out = t.hit_counts(spark, df, "k")
        assert sorted((r.k, r[column], r.hits) for r in out.collect()) == [("a", 1, 1), ("z", 2, 0)]
    same = spark.createDataFrame([("a",)], "input string")  # the key itself is named input
    assert [tuple(r) for r in t.lookup(spark, same, "input", "res").collect()] == [("a", "x")]


# ---- wide suites --------------------------------------------------------------

@pytest.mark.parametrize("n", [WIDE, WIDE + 1, 200])
def test_wide_suites_give_the_same_vector(spark, n):
    s = suite(*[f"{{id}} % {k} = 0" for k in range(1, n + 1)])
    assert vector(spark, spark.range(1, 8), s) == [[i % k == 0 for k in range(1, n + 1)] for i in range(1, 8)]
    audits = run_rules(spark, spark.range(1, 4), s).collect()
    assert all(len(r.quality.ruleSets[1].rules) == n for r in audits)

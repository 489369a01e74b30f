"""Rules that hold at every size, enforced policies and identities, safe rule text."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ruleframe.model import Id, Rule, RuleSet, RuleSuite
from ruleframe.operators.decision import DecisionModel, DecisionTable, lookup_frame, rule_hits
from ruleframe.operators.results import explode_results, rule_counts, suite_counts
from ruleframe.operators.runner import audit, audit_compat, run_rules, with_vector
from ruleframe.sources.bindings import bind_fields, bind_json, typed_record
from ruleframe.suites import DECISION_SUITE_RULES


# ---- cases on both sides of the sizes at which earlier versions changed their plan or answer ----

def _wide(n):
    rules = tuple(Rule(Id(k, 1), f"{{id}} % 3 = {k % 3}") for k in range(1, n + 1))
    return RuleSuite(Id(9, 1), (RuleSet(Id(1, 1), rules),))


@pytest.mark.parametrize("n", [64, 65])
def test_counts_and_audit_do_not_depend_on_the_number_of_rules(spark, n):
    suite, ids = _wide(n), list(range(1, n + 1))
    rows = [(1, '{"id": 3}'), (2, '{"id": "x"}'), (3, None), (4, " "), (5, '{"id": 4}')]
    df = spark.createDataFrame(rows, "key int, payload string")
    b = bind_json("payload", "id INT", bad_records_null=True)
    out = with_vector(spark, df, suite, b)
    got = {r.rule_id: (r.n_true, r.n_false, r.n_null) for r in rule_counts(out, "quality", ids).collect()}
    assert got == {k: (int(k % 3 in (0, 1)), 2 - int(k % 3 in (0, 1)), 3) for k in ids}
    assert {(r.n_true, r.n_false, r.n_null) for r in rule_counts(out.limit(0), "quality", ids).collect()} == {(0, 0, 0)}
    assert rule_counts(out, "quality", [7] * n).count() == n
    assert explode_results(out, "key", "quality", ids).count() == 5 * n
    short = spark.createDataFrame([([True],), (None,)], "v array<boolean>")
    for c in (audit(F.col("v"), suite).getField("ruleSets"), audit_compat(F.col("v"), n).getField("ruleSets")):
        a, b = (r.m for r in short.select(c[1].getField("rules").alias("m")).collect())
        assert len(a) == len(b) == n and set(b.values()) == {None} and list(a.values())[1:] == [None] * (n - 1)


def test_suite_identity(spark):
    rule = Rule(Id(1, 1), "{id} > 0")
    with pytest.raises(ValueError, match="rule ids repeat"):
        RuleSuite(Id(1), (RuleSet(Id(1), (rule, Rule(Id(1, 2), "{id} > 1"))),))
    with pytest.raises(ValueError, match="set ids repeat"):
        RuleSuite(Id(1), (RuleSet(Id(1), (rule,)), RuleSet(Id(1, 2), (rule,))))
    suite = RuleSuite(Id(1), (RuleSet(Id(1), (rule,)), RuleSet(Id(2, 4), (Rule(Id(1, 2), "{id} > 5"),))))
    df = spark.createDataFrame([(3,), (9,)], "id int")
    compat = run_rules(spark, df, suite, compat=True).select("quality.ruleSets").first()[0]
    assert sorted(compat) == [1, 2]
    counts = {(r.set_id, r.set_version, r.rule_id, r.rule_version): r.n_true
              for r in suite_counts(with_vector(spark, df, suite), "quality", suite).collect()}
    assert counts == {(1, 1, 1, 1): 2, (2, 4, 1, 2): 1}
    got = DecisionModel(suite).evaluate(spark, df, service=None, with_context=True).select("quality.*").collect()
    assert [r.evaluate for r in got] == [[True, False], [True, True]] and got[0].context.s2_r1 is False


def test_hidden_columns_are_not_overwritten(spark):
    df = spark.createDataFrame([(1, 2)], "id int, __rule_vector int")
    with pytest.raises(ValueError, match="__rule_vector"):
        run_rules(spark, df, _wide(2))


@pytest.mark.parametrize("text, filled", [
    ("regexp_like({zip}, '^[0-9]{2,5}$')", "regexp_like(`zip`, '^[0-9]{2,5}$')"),
    ("{a} = '{a}' AND `{b}` = \"{c}\" -- {d}", "`a` = '{a}' AND `{b}` = \"{c}\" -- {d}"),
    (r"{a} rlike r'\d{3}\' AND {b} = 'it''s \' {c}'", r"`a` rlike r'\d{3}\' AND `b` = 'it''s \' {c}'"),
    ("/* {a} */ {a} > {1}", "/* {a} */ `a` > {1}")])
def test_placeholders(text, filled):
    assert Rule(Id(1), text).sql(bind_fields().refs()) == filled


def test_a_failing_cast_gives_null_only_when_asked(spark):
    suite = RuleSuite(Id(1), (RuleSet(Id(1), (Rule(Id(1), "CAST ({v} AS INT) > 3"), Rule(Id(2), "{v} = 'cast(x)'"))),))
    df = spark.createDataFrame([('{"v": "5"}',), ('{"v": "x"}',)], "payload string")
    lenient = bind_json("payload", "v STRING", errors_null=True)
    assert [r.quality for r in with_vector(spark, df, suite, lenient).collect()] == [[True, False], [None, False]]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        with_vector(spark, df, suite, bind_json("payload", "v STRING")).collect()


@pytest.mark.parametrize("policy, default, want", [
    ("FIRST", "D", {"a": "x", "b": "z", "c": "D", None: "D"}), ("FIRST", None, {"a": "x", "b": "z", "c": None, None: None}),
    ("COLLECT", None, {"a": ["x", "y"], "b": ["z"], "c": [], None: []})])
def test_decision_table_forms_agree(spark, policy, default, want):
    t = DecisionTable("t", (("a", "x"), ("a", "y"), ("b", "z")), output_type="string", hit_policy=policy, default=default)
    df = spark.createDataFrame([(k,) for k in want], "k string")
    assert {r.k: r.o for r in df.select("k", t.column(F.col("k")).alias("o")).collect()} == want
    assert {r.k: r.o for r in t.lookup(spark, df, "k", "o").collect()} == want


def test_hit_policies_are_enforced(spark):
    df = spark.createDataFrame([("a",)], "k string")
    for policy, rows in (("UNIQUE", (("a", "x"), ("a", "x"))), ("ANY", (("a", "x"), ("a", "y")))):
        t = DecisionTable("t", rows, output_type="string", hit_policy=policy)
        for form in (lambda: t.column(F.col("k")), lambda: t.lookup(spark, df, "k", "o")):
            with pytest.raises(ValueError, match=policy):
                form()
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, input string, output string")
        with pytest.raises(Exception, match="hit policy"):
            lookup_frame(df, table, "k", "o", policy).collect()
    same = DecisionTable("t", (("a", "x"), ("a", "x")), output_type="string", hit_policy="ANY")
    assert same.lookup(spark, df, "k", "o").first().o == "x"
    many = DecisionTable("t", tuple((f"k{i}", i) for i in range(200)), output_type="int")
    assert spark.createDataFrame([("k199",)], "k string").select(many.column(F.col("k")).alias("o")).first().o == 199


def test_rule_hits_skip_bad_records(spark):
    df = spark.createDataFrame([(1, '{"location":"CH","id":"x","department":"ops"}'),
                                (2, '{"location":"CH","department":"ops"}')], "key int, payload string")
    got = rule_hits(spark, df, DECISION_SUITE_RULES, "key", bind_json("payload", bad_records_null=True)).collect()
    assert [(r.key, r.rule_id) for r in got] == [(2, 5)]


def test_a_number_must_survive_its_cast(spark):
    df = spark.createDataFrame([(2.9, 3), (4.0, 5), (None, None)], "a double, b bigint")
    got = typed_record(df, (("a", "BIGINT"), ("b", "INT"))).collect()
    assert [(r.a, r.type_ok) for r in got] == [(2, False), (4, True), (None, True)]


def test_the_stream_reads_a_table_of_part_files(spark, tmp_path):
    from ruleframe.plans.catalog import QUERIES

    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF001}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got, want = (sorted(map(str, QUERIES["stream_rule_vector"](spark, d).collect())) for d in (str(tmp_path), SF001))
    assert got == want


def test_the_cached_frame_is_released(spark):
    from ruleframe.plans.catalog import QUERIES

    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    QUERIES["suite_cache_count"](spark, SF001).collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_json_is_parsed_for_the_fields_the_rules_name(spark):
    from ruleframe.plans.catalog import QUERIES
    from ruleframe.plans.inspect import plan_text

    plan = plan_text(QUERIES["json_suite"](spark, SF001), "simple")
    assert ("StructField(location,StringType,true), StructField(id,LongType,true), "
            "StructField(department,StringType,true), ") in plan  # neither idPrefix nor page
    stored = plan_text(QUERIES["bind_struct"](spark, SF001), "simple")
    assert "page:bigint" not in stored.split("ReadSchema")[1]

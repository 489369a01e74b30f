"""Bindings, bad records, typing, decision tables and models, joins."""

import pytest
from pyspark.sql import functions as F

from ruleframe.operators.decision import DecisionModel, DecisionTable, group_table, member_table, rule_hits
from ruleframe.operators.joins import join_small
from ruleframe.operators.results import distinct_results, explode_results, rule_counts
from ruleframe.operators.runner import run_rules, with_vector
from ruleframe.plans.inspect import count_in_plan, plan_text
from ruleframe.sources.bindings import bind_fields, bind_json, bind_struct, typed_record
from ruleframe.sources.records import generate
from ruleframe.sources.tables import customer_edge_records, customer_records
from ruleframe.suites import DECISION_SUITE_RULES, decision_suite, sql_suite

from conftest import SF001

CUST_DDL = "location STRING, idPrefix STRING, id BIGINT, page BIGINT, department STRING"


def test_three_bindings_agree(spark):
    g = generate(spark, 2600)
    outs = [with_vector(spark, g, sql_suite(), b).select("id", "idPrefix", "location", F.col("quality").alias(f"q{i}"))
            for i, b in enumerate([bind_fields(), bind_struct("struct_payload"), bind_json("payload")])]
    j = outs[0].join(outs[1], ["id", "idPrefix", "location"]).join(outs[2], ["id", "idPrefix", "location"])
    assert j.count() == g.count()
    assert j.where("NOT (q0 <=> q1) OR NOT (q0 <=> q2)").count() == 0


def test_json_parsed_once(spark):
    out = run_rules(spark, customer_records(spark, SF001), sql_suite(), bind_json("payload", CUST_DDL))
    assert count_in_plan(out, "from_json(", "simple") == 1


def test_bad_records_null(spark):
    e = customer_edge_records(spark, SF001)
    out = with_vector(spark, e, sql_suite(), bind_json("payload", CUST_DDL, bad_records_null=True))
    rows = out.select("balance", "quality").collect()
    assert any(r["balance"] < 0 for r in rows)
    for r in rows:
        assert (r["quality"] is None) == (r["balance"] < 0)


def test_without_bad_record_handling_missing_id_fires(spark):
    df = spark.createDataFrame([('{"location":"US","id":"abc","department":"ops"}',)], "payload string")
    v = with_vector(spark, df, sql_suite(), bind_json("payload")).first()["quality"]
    assert v[4] is True  # wrongly typed id reads as NULL -> isMissing
    v2 = with_vector(spark, df, sql_suite(), bind_json("payload", bad_records_null=True)).first()["quality"]
    assert v2 is None


def test_typed_record(spark):
    df = spark.createDataFrame([("1", "2"), ("x", "3"), (None, None)], "id string, page string")
    out = typed_record(df, [("id", "INT"), ("page", "BIGINT")]).collect()
    assert [(r.id, r.page, r.type_ok) for r in out] == [(1, 2, True), (None, 3, False), (None, None, True)]


def test_decision_table_case_equals_join(spark):
    t = group_table()
    df = spark.createDataFrame([("Non UK",), ("Europe",), ("Asia",), (None,)], "grp string")
    a = df.select("grp", t.column(F.col("grp")).alias("c"))
    b = t.lookup(spark, df, "grp", "j")
    rows = a.join(b, a.grp.eqNullSafe(b.grp)).select(a.grp, "c", "j").collect()
    assert len(rows) == 4
    for r in rows:
        assert r.c == r.j
    assert [r.c for r in rows if r.grp == "Europe"] == [["CH"]]
    assert [r.c for r in rows if r.grp == "Asia"] == [None]


def test_unique_conflicts(spark):
    assert group_table().conflicts(spark).count() == 0
    conflicts = {r.input: r.hits for r in member_table().conflicts(spark).collect()}
    assert conflicts == {"US": 3, "CH": 2, "MX": 2, "BR": 2}
    with pytest.raises(ValueError):
        DecisionTable("x", (("a", "b"),), hit_policy="PRIORITYX")


def test_collect_hit_policy(spark):
    t = DecisionTable("g", tuple((m, g) for g, ms in (("A", ("US",)), ("B", ("US", "UK"))) for m in ms),
                      output_type="string", hit_policy="COLLECT")
    r = (spark.createDataFrame([("US",), ("UK",), ("CH",), (None,)], "l string")
         .select(t.column(F.col("l")).alias("o")).collect())
    assert [x.o for x in r] == [["A", "B"], ["B"], [], []]


def test_rule_hits_equal_vector_true_positions(spark):
    recs = customer_records(spark, SF001)
    vec = with_vector(spark, recs, decision_suite())
    exploded = explode_results(vec, "key", "quality", list(range(1, 16))).where("result").select("key", "rule_id")
    hits = rule_hits(spark, recs, DECISION_SUITE_RULES, "key")
    assert exploded.exceptAll(hits).count() == 0 and hits.exceptAll(exploded).count() == 0


def test_join_small_above_the_limit_matches_broadcast(spark):
    recs = customer_records(spark, SF001)
    small = spark.createDataFrame([("US", 1), ("UK", 2)], "loc string, v int")
    on = [("location", "loc")]
    for how in ("inner", "left"):
        shuffled = join_small(recs, small, on, how=how, limit=0).select("key", "v")
        bcast = join_small(recs, small, on, how=how).select("key", "v")
        assert shuffled.exceptAll(bcast).count() == 0 and bcast.exceptAll(shuffled).count() == 0
        # measured as text, or told by the caller
        known = join_small(recs, small, on, 40, how).select("key", "v")
        assert "BroadcastHashJoin" in plan_text(known, "simple") and known.exceptAll(bcast).count() == 0


def test_join_beyond_the_broadcast_limit_splits_hot_keys(spark):
    """A third of the rows on one key and a block of NULL keys: same rows as a broadcast, the hot key in several tasks."""
    big = spark.range(30000).select(
        F.col("id").alias("rid"), F.sha2(F.col("id").cast("string"), 512).alias("wide"),
        F.when(F.col("id") < 10000, F.lit(5)).when(F.col("id") < 12000, F.lit(None))
        .otherwise(F.col("id")).cast("int").alias("k")).repartition(8)
    small = spark.range(20000).select(F.col("id").cast("int").alias("sk"), (F.col("id") * 10).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for how in ("inner", "left"):
            shuffled = join_small(big, small, [("k", "sk")], how=how, limit=0).select("rid", "v")
            bcast = join_small(big, small, [("k", "sk")], 20000, how=how).select("rid", "v")
            assert shuffled.count() == bcast.count() == (30000 if how == "left" else 18000)
            assert shuffled.exceptAll(bcast).count() == 0 and bcast.exceptAll(shuffled).count() == 0
        j = join_small(big, small, [("k", "sk")], how="left", limit=0)
        tasks = [r["n"] for r in j.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count_if((F.col("k") == 5) & (F.length("wide") > 0)).alias("n")).collect() if r["n"]]
        assert sum(tasks) == 10000 and len(tasks) > 1
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_decision_model_service_and_json(spark):
    g = generate(spark, 1300)
    m = DecisionModel(decision_suite())
    typed = m.evaluate(spark, g, bind_struct("struct_payload"))
    assert typed.schema["quality"].dataType.simpleString() == "struct<evaluate:array<boolean>>"
    js = m.evaluate(spark, g, bind_json("payload"), as_json=True).select("quality").first()[0]
    assert js.startswith('{"evaluate":[') and js.count(",") == 14
    allc = m.evaluate(spark, g, bind_fields(), service=None, with_context=True)
    row = allc.select("quality.evaluate", "quality.context").first()
    assert row[0] == [row[1][f"r{i}"] for i in range(1, 16)]


def test_distinct_results_on_maps(spark):
    recs = customer_records(spark, SF001)
    out = run_rules(spark, recs, sql_suite(), compat=True)
    d = distinct_results(out, "quality")
    assert d.agg(F.sum("n")).first()[0] == recs.count()
    # same count as distinct over the flattened vector
    flat = with_vector(spark, recs, sql_suite()).select("quality").distinct().count()
    assert d.count() <= flat


def test_distinct_suite_results_equal_generic(spark):
    """Grouping by the vector first gives the per-row comparable grouping's rows and counts."""
    from ruleframe.operators.results import distinct_suite_results
    from ruleframe.plans.catalog import CUSTOMER_DDL

    edge = customer_edge_records(spark, SF001)
    cases = [(bind_fields(), False), (bind_fields(), True),
             (bind_json("payload", CUSTOMER_DDL, bad_records_null=True), False)]
    from ruleframe.model import Id, RuleSet, RuleSuite

    base = sql_suite()
    rules = base.sets[0].rules
    two_sets = RuleSuite(Id(1, 1), (RuleSet(Id(1, 1), rules[:8]), RuleSet(Id(2, 1), rules[8:])), base.functions)
    for suite, b, compat in [(base, *c) for c in cases] + [(two_sets, bind_fields(), False)]:
        generic = distinct_results(run_rules(spark, edge, suite, b, compat=compat), "quality")
        fast = distinct_suite_results(spark, edge, suite, b, compat=compat)
        assert generic.count() > 1
        assert generic.exceptAll(fast).count() == 0 and fast.exceptAll(generic).count() == 0


def test_rule_counts_sum_to_rows(spark):
    recs = customer_records(spark, SF001)
    c = rule_counts(with_vector(spark, recs, sql_suite()), "quality", list(range(1, 16))).collect()
    assert all(r.n_true + r.n_false + r.n_null == 150 for r in c)


def test_custom_record_fields(spark):
    """Rules over a record type of the user's own, bound three ways."""
    from ruleframe.model import Id, Rule, RuleSet, RuleSuite

    suite = RuleSuite(Id(5, 1), (RuleSet(Id(1, 1), (
        Rule(Id(1, 1), "{amount} > 100"),
        Rule(Id(2, 1), "{currency} IN ('EUR', 'USD')"),
    )),))
    df = spark.createDataFrame([(150.0, "EUR"), (50.0, "JPY"), (None, None)], "amt double, cur string")
    df = df.selectExpr("*", "named_struct('amount', amt, 'currency', cur) AS s",
                       "to_json(named_struct('amount', amt, 'currency', cur)) AS j")
    expected = [[True, True], [False, False], [None, None]]
    for b in (bind_fields({"amount": "amt", "currency": "cur"}), bind_struct("s"),
              bind_json("j", "amount DOUBLE, currency STRING")):
        got = [r["quality"] for r in with_vector(spark, df, suite, b).orderBy(F.col("amt").desc_nulls_last()).collect()]
        assert got == expected, b.kind


def test_json_binding_with_nested_ddl(spark):
    """Field names come from Spark's DDL parser, so nested types with commas are fine."""
    ddl = "location STRING, extra STRUCT<a: INT, b: INT>, id INT, tags MAP<STRING, INT>, department STRING"
    b = bind_json("payload", ddl)
    assert b.field_names == ["location", "extra", "id", "tags", "department"]
    df = spark.createDataFrame([('{"location":"US","extra":{"a":1,"b":2},"id":3,"department":"sales"}',)],
                               "payload string")
    rec = b.prepare(df).select(b.record().alias("r")).first()["r"]
    assert rec["location"] == "US" and rec["extra"]["b"] == 2 and rec["tags"] is None

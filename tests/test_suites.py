"""Golden per-rule counts and fixed records."""

from pyspark.sql import functions as F

from ruleframe.operators.results import rule_counts
from ruleframe.operators.runner import audit_compat, run_rules, template_vector, with_vector
from ruleframe.sources.bindings import bind_json, bind_struct
from ruleframe.sources.io import scratch_path
from ruleframe.sources.records import generate, generated_row_count
from ruleframe.sources.tables import customer_records
from ruleframe.suites import baseline_rules, decision_suite, sql_suite

from conftest import SF001, SF01

RULES = list(range(1, 16))

GOLDEN = {
    "gen_sql": [19994, 19994, 0, 0, 0, 0, 0, 19994, 0, 0, 19994, 19994, 0, 19994, 0],
    "gen_decision": [19994, 19994, 0, 0, 0, 0, 0, 19994, 0, 0, 19994, 0, 19994, 19994, 0],
    "cust_sf0.001": [16, 16, 27, 3, 0, 27, 17, 15, 5, 0, 18, 10, 19, 6, 0],
    "cust_sf0.01": [245, 123, 183, 68, 0, 242, 113, 160, 59, 0, 228, 124, 180, 56, 0],
}


def _true_counts(df):
    return [r.n_true for r in df.orderBy("rule_id").collect()]


def test_generated_row_count(spark):
    assert generated_row_count(100_000) == 99_970
    assert generated_row_count(1_000_000) == 999_960
    assert generate(spark, 100_000).count() == 99_970


def test_generated_first_payload(spark):
    first = generate(spark, 130).where("idPrefix = 'a' AND location = 'US'").select("payload").first()[0]
    assert first == '{"location":"US","idPrefix":"a","id":0,"page":1,"department":"sales"}'


def test_generated_golden_sql_and_decision(spark):
    g = generate(spark, 100_000)
    sql = rule_counts(with_vector(spark, g, sql_suite()), "quality", RULES)
    dec = rule_counts(with_vector(spark, g, decision_suite()), "quality", RULES)
    assert _true_counts(sql) == GOLDEN["gen_sql"]
    assert _true_counts(dec) == GOLDEN["gen_decision"]


def test_customer_golden_all_bindings(spark):
    for sf, key in ((SF001, "cust_sf0.001"), (SF01, "cust_sf0.01")):
        recs = customer_records(spark, sf)
        for b in (None, bind_struct("struct_payload"), bind_json("payload", "location STRING, idPrefix STRING, id BIGINT, page BIGINT, department STRING")):
            got = _true_counts(rule_counts(with_vector(spark, recs, sql_suite(), b), "quality", RULES))
            assert got == GOLDEN[key], (sf, b)


def test_baseline_equals_suite(spark):
    recs = customer_records(spark, SF01)
    a = with_vector(spark, recs, sql_suite()).select("key", F.col("quality").alias("a"))
    b = recs.select("key", template_vector(baseline_rules()).alias("b"))
    assert a.join(b, "key").where("NOT (a <=> b)").count() == 0


def test_single_record_rule_two_only(spark):
    df = spark.createDataFrame([("UK", "prefix", 2, 1, "marketing")],
                               "location string, idPrefix string, id int, page bigint, department string")
    for suite in (sql_suite(), decision_suite()):
        v = with_vector(spark, df, suite).first()["quality"]
        assert v == [i == 1 for i in range(15)]


def test_compat_audit_layout(spark):
    vec = [True] + [False] * 13 + [True]
    df = spark.createDataFrame([(vec,)], "v array<boolean>")
    q = df.select(audit_compat(F.col("v"), 15).alias("q")).first()["q"]
    rules = q["ruleSets"][1]["rules"]
    assert sorted(rules) == list(range(15))
    assert rules[13] is True and rules[14] is None
    assert all(rules[k] is False for k in range(13))
    assert q["overallResult"] is True and q["ruleSets"][1]["setResult"] is True


def test_corrected_audit_keys_are_rule_ids(spark):
    recs = customer_records(spark, SF001)
    out = run_rules(spark, recs, sql_suite()).select("key", "quality").first()
    rules = out["quality"]["ruleSets"][1]["rules"]
    assert sorted(rules) == RULES


def test_wide_suite_runs(spark):
    """600 rules (the suite repeated 40 times under distinct ids) still compile and agree."""
    from ruleframe.model import Id, Rule, RuleSet, RuleSuite

    base = sql_suite()
    rules = tuple(Rule(Id(c * 100 + r.id.id, 1), r.expr) for c in range(40) for _, r in base.rules())
    wide = RuleSuite(Id(7, 1), (RuleSet(Id(1, 1), rules),), base.functions)
    recs = customer_records(spark, SF001)
    got = rule_counts(with_vector(spark, recs, wide), "quality", [r.id.id for r in rules]).collect()
    by_id = {r.rule_id: r.n_true for r in got}
    for c in range(40):
        assert [by_id[c * 100 + i] for i in RULES] == GOLDEN["cust_sf0.001"]


def test_write_sweep(spark):
    from ruleframe.sources.records import write_sweep

    base = scratch_path(spark, "sweep")
    paths = write_sweep(spark, base, [1300, 2600, 3900], num_partitions=4)
    counts = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    assert counts == {1300: 1300, 2600: 2600, 3900: 3900}


def test_wide_audit_forms_agree(spark):
    """Audits of a 90-rule suite (map_from_arrays path) equal the 15-rule audits repeated."""
    from ruleframe.model import Id, Rule, RuleSet, RuleSuite
    from ruleframe.operators.runner import audit, audit_compat

    base = sql_suite()
    rules = tuple(Rule(Id(c * 100 + r.id.id, 1), r.expr) for c in range(6) for _, r in base.rules())
    wide = RuleSuite(Id(7, 1), (RuleSet(Id(1, 1), rules),), base.functions)
    recs = customer_records(spark, SF001)
    v = with_vector(spark, recs, wide).withColumn("a", audit(F.col("quality"), wide)) \
        .withColumn("c", audit_compat(F.col("quality"), 90))
    for row in v.select("quality", "a", "c").collect():
        vec = row["quality"]
        assert row["a"]["ruleSets"][1]["rules"] == {r.id.id: vec[i] for i, r in enumerate(rules)}
        assert row["c"]["ruleSets"][1]["rules"] == {i: (vec[i + 1] if i + 1 < 90 else None) for i in range(90)}


def test_generator_spreads_a_hot_key(spark):
    """A third of the keys equal: output tasks stay even (round robin, not a key hash)."""
    from pyspark.sql import functions as F
    from ruleframe.sources.records import generate_records

    keys = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("k"))
    g = generate_records(keys, "k", num_partitions=8)
    sizes = [r["n"] for r in g.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 * 130
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)


def test_count_evaluated_same_for_vector_and_both_audit_layouts(spark):
    """Failed / passed / undecided counts read the vector, the audit or the compatible audit alike."""
    from ruleframe.sources.io import count_evaluated
    from ruleframe.sources.tables import customer_edge_records

    # all fields NULL: every rule is NULL (undecided); plus the edge records, which all fail some rule
    blank = spark.createDataFrame([(None, None, None)] * 3, "location string, department string, id bigint")
    recs = customer_edge_records(spark, SF001).select("location", "department", "id").unionByName(blank)
    vec = count_evaluated(with_vector(spark, recs, sql_suite()), "quality").first()
    aud = count_evaluated(run_rules(spark, recs, sql_suite()), "quality").first()
    cmp_ = count_evaluated(run_rules(spark, recs, sql_suite(), compat=True), "quality").first()
    assert vec == aud == cmp_
    assert (vec["rows"], vec["n_failed"], vec["n_passed"], vec["n_undecided"]) == (153, 150, 0, 3)

"""Every supported operator as a query over the driver tables.

Each query takes (spark, sf_dir) and returns a DataFrame of scalar columns
(nested results are flattened so they can be checked against SQL).  The
library's own result columns stay nested; flattening is only the last step.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.functions.columns import applicable_for, case_lookup, group_members, is_missing
from ruleframe.functions.sql import register_functions
from ruleframe.model import FunctionDef, Id, Rule, RuleSet, RuleSuite
from ruleframe.operators.decision import (Condition, DecisionModel, DecisionTable, group_table, member_table,
                                          rule_hits)
from ruleframe.operators.joins import join_small
from ruleframe.operators.results import distinct_suite_results, flatten_audit, flatten_vector, rule_counts, suite_counts
from ruleframe.operators.runner import audit, audit_compat, rule_column, run_rules, template_vector, with_vector
from ruleframe.sources.bindings import bind_fields, bind_json, bind_struct, lossless, typed_record
from ruleframe.sources.io import cache_count, count_evaluated, is_folder, read_parquet, scratch_path, write_parquet
from ruleframe.sources.records import generate_records
from ruleframe.sources.tables import customer_edge_records, customer_records, read_table
from ruleframe.streaming.stream import run_to_parquet
from ruleframe.suites import (DECISION_SUITE_RULES, GROUPS, ORDERS_FIELDS, ORDERS_RULE_SETS, PRIORITY_GROUPS, RECORD_FIELDS,
                              SQL_SUITE_RULES, baseline_rules, decision_suite, make_suite, orders_suite, record_ddl,
                              sql_quote, sql_suite)

RULE_IDS = [r for r, _, _ in SQL_SUITE_RULES]
N_RULES = len(RULE_IDS)
RECORD_COLS = [n for n, _ in RECORD_FIELDS]
# Customer-bound records carry the customer key as id (BIGINT).
CUSTOMER_DDL = record_ddl("BIGINT")

# --- fixed values (test fixture) -------------------------------------------
# Market segment -> group name passed to the group functions; MACHINERY maps
# to a group that no table defines.
SEGMENT_GROUP = {
    "AUTOMOBILE": "Non UK",
    "BUILDING": "UK & US",
    "FURNITURE": "Americas",
    "HOUSEHOLD": "Europe",
    "MACHINERY": "Asia",
}
# ---------------------------------------------------------------------------


def _recs(spark, sf_dir):
    return customer_records(spark, sf_dir)


def _gen(spark, sf_dir):
    """Benchmark records: 130 per customer key, the keys spread over the shuffle partitions first."""
    return generate_records(read_table(spark, sf_dir, "customer"), "c_custkey",
                            num_partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))


def _grp(spark, sf_dir):
    """Records with a group name per customer, taken from its market segment."""
    r = customer_records(spark, sf_dir, keep=("c_mktsegment",))
    return r.select("key", "location", case_lookup(F.col("c_mktsegment"), SEGMENT_GROUP).alias("grp"))


def _vec_out(df, key_cols, col="quality"):
    return df.select(*key_cols, *flatten_vector(F.col(col), N_RULES))


def _audit_out(df, key_cols, compat, col="quality"):
    keys = list(range(N_RULES)) if compat else RULE_IDS
    return df.select(*key_cols, *flatten_audit(F.col(col), 1, keys, compat=compat))


def _decision_out(df, key_cols, col="quality", field="evaluate", prefix="r"):
    return df.select(*key_cols, *flatten_vector(F.col(col).getField(field), N_RULES, prefix))


# ---- sources, sinks, shaping ---------------------------------------------

def gen_records(spark, sf_dir):
    return _gen(spark, sf_dir).select(*RECORD_COLS)


def copy_records(spark, sf_dir):
    return _gen(spark, sf_dir).select(*RECORD_COLS, "payload")


def parquet_roundtrip(spark, sf_dir):
    path = write_parquet(_gen(spark, sf_dir), scratch_path(spark, "records"))
    return read_parquet(spark, path).select(*RECORD_COLS, "payload")


def struct_payload_fields(spark, sf_dir):
    return _recs(spark, sf_dir).select("key", "struct_payload.*")


def json_payload(spark, sf_dir):
    return _recs(spark, sf_dir).select("key", "payload")


def json_parse(spark, sf_dir):
    return (_recs(spark, sf_dir).select("key", F.from_json("payload", CUSTOMER_DDL).alias("p"))
            .select("key", "p.*"))


def suite_count(spark, sf_dir):
    return count_evaluated(run_rules(spark, _recs(spark, sf_dir), sql_suite()), "quality")


def suite_cache_count(spark, sf_dir):
    persisted, _ = cache_count(with_vector(spark, _recs(spark, sf_dir), sql_suite()).select("quality"))
    try:
        result = count_evaluated(persisted, "quality")
        return spark.createDataFrame(result.collect(), result.schema)  # one row
    finally:
        persisted.unpersist()


# ---- rules and suites -----------------------------------------------------

def rule_single(spark, sf_dir):
    s = sql_suite()
    register_functions(spark, s.functions)
    return _recs(spark, sf_dir).select("key", rule_column(s.sets[0].rules[0]).alias("r1"))


def rule_vector_q(spark, sf_dir):
    return _vec_out(with_vector(spark, _recs(spark, sf_dir), sql_suite(), bind_fields()), ["key"])


def _two_sets() -> RuleSuite:
    """Rules 1-8 as set 1; rules 9-15 as set 2 (version 3) with ids 1-7 (version 2)."""
    base = sql_suite()
    rules = base.sets[0].rules
    second = tuple(Rule(Id(i, 2), r.expr) for i, r in enumerate(rules[8:], 1))
    return RuleSuite(Id(1, 1), (RuleSet(Id(1, 1), rules[:8]), RuleSet(Id(2, 3), second)), base.functions)


def rule_suite_q(spark, sf_dir):
    """Two rule sets that share rule ids: set results and rule keys (r9-r15: rules 1-7 of set 2)."""
    suite = _two_sets()
    out = run_rules(spark, _recs(spark, sf_dir), suite)
    q = F.col("quality")
    sets = q.getField("ruleSets")
    cols = [q.getField("any_failed").alias("overall"),
            sets[F.lit(1).cast("bigint")].getField("any_failed").alias("set1"),
            sets[F.lit(2).cast("bigint")].getField("any_failed").alias("set2")]
    for s, first in zip(suite.sets, (1, 9)):
        m = sets[F.lit(s.id.id).cast("bigint")].getField("rules")
        cols += [m[F.lit(r.id.id).cast("bigint")].alias(f"r{first + i}") for i, r in enumerate(s.rules)]
    return out.select("key", *cols)


def sql_function_rule(spark, sf_dir):
    s = sql_suite()
    register_functions(spark, s.functions)
    cols = [F.expr(f"`dq is applicable for`({sql_quote(g)}, location)").alias(f"in_{i}")
            for i, g in enumerate(GROUPS, 1)]
    return _recs(spark, sf_dir).select("key", *cols, F.expr("isMissing(id)").alias("id_missing"))


def named_list_rule(spark, sf_dir):
    """The group rules with each group as a constant SQL function `Non UK`() etc."""
    lists = tuple(FunctionDef(g, (), "ARRAY<STRING>", "array(" + ", ".join(sql_quote(m) for m in ms) + ")",
                              Id(i, 1)) for i, (g, ms) in enumerate(GROUPS.items(), 1))
    rules = tuple(Rule(Id(rid, 1), f"array_contains(`{test}`(), {{location}}) AND {{department}} = {sql_quote(d)}")
                  for rid, test, d in SQL_SUITE_RULES if test in GROUPS)
    suite = RuleSuite(Id(3, 1), (RuleSet(Id(1, 1), rules),), lists)
    out = with_vector(spark, _recs(spark, sf_dir), suite)
    return out.select("key", *[F.get("quality", F.lit(i)).alias(f"r{r.id.id}") for i, r in enumerate(rules)])


# Rule text with braces that are no placeholders: quantifiers, a JSON path, a literal that looks like a field.
TEXT_RULES = (
    r"regexp_like(cast({id} AS STRING), '^[0-9]{3}$')",
    r"regexp_like(cast({id} AS STRING), '^[0-9]{1,2}$')",
    r"regexp_like({idPrefix}, '^[A-Z]{2,7}') /* {not} a field */",
    r"""get_json_object('{"a": {"location": "US"}}', '$.a.location') = {location}""",
    r"{department} <> '{department}'",
)


def rule_text(spark, sf_dir):
    """The same rule text over fields, the struct and the JSON."""
    suite = RuleSuite(Id(5, 1), (RuleSet(Id(1, 1), tuple(Rule(Id(i, 1), t) for i, t in enumerate(TEXT_RULES, 1))),))
    out = _recs(spark, sf_dir)
    for name, b in (("f", bind_fields()), ("s", bind_struct("struct_payload")), ("j", bind_json("payload", CUSTOMER_DDL))):
        out = with_vector(spark, out, suite, b, out=f"v{name}")
    return out.select("key", *[c for name in "fsj" for c in flatten_vector(F.col(f"v{name}"), len(TEXT_RULES), name)])


def wide_rule_counts(spark, sf_dir):
    """80 rules over JSON with bad records: counts by rule, NULL vectors included."""
    rules = tuple(Rule(Id(100 + k, 1), f"{{id}} % 80 = {k}") for k in range(80))
    suite = RuleSuite(Id(6, 1), (RuleSet(Id(1, 1), rules),))
    out = with_vector(spark, customer_edge_records(spark, sf_dir), suite,
                      bind_json("payload", CUSTOMER_DDL, bad_records_null=True))
    return rule_counts(out, "quality", [r.id.id for r in rules])


def stored_json_suite(spark, sf_dir):
    """A suite over JSON as it is stored (events.props) and columns beside it."""
    rules = ("{k} >= 50 AND {type} = 'click'", "{k} % 2 = 0", "{amount} > 20 OR {type} = 'error'",
             "{k} IS NULL OR {amount} IS NULL")
    suite = RuleSuite(Id(7, 1), (RuleSet(Id(1, 1), tuple(Rule(Id(i, 1), t) for i, t in enumerate(rules, 1))),))
    b = bind_json("props", "k INT", columns={"type": "event_type", "amount": "value"})
    out = with_vector(spark, read_table(spark, sf_dir, "events"), suite, b)
    return out.select("event_id", *flatten_vector(F.col("quality"), len(rules)))


def rule_membership(spark, sf_dir):
    cols = [applicable_for(g, F.col("location")).alias(f"in_{i}") for i, g in enumerate(GROUPS, 1)]
    return _recs(spark, sf_dir).select("key", *cols)


def rule_missing(spark, sf_dir):
    e = customer_edge_records(spark, sf_dir)
    return e.select("key", is_missing(F.col("id")).alias("id_missing"),
                    is_missing(F.col("code")).alias("code_missing"),
                    is_missing(F.col("location")).alias("location_missing"))


def baseline_vector(spark, sf_dir):
    g = _gen(spark, sf_dir)
    return _vec_out(g.withColumn("quality", template_vector(baseline_rules())), ["id", "idPrefix", "location"])


def rule_audit(spark, sf_dir):
    """The audit function over a vector column that the caller keeps."""
    out = with_vector(spark, _recs(spark, sf_dir), sql_suite(), out="vector")
    return _audit_out(out.withColumn("quality", audit(F.col("vector"), sql_suite())), ["key"], compat=False)


def rule_audit_compat(spark, sf_dir):
    g = _gen(spark, sf_dir)
    out = g.withColumn("quality", audit_compat(template_vector(baseline_rules()), N_RULES))
    return _audit_out(out, ["id", "idPrefix", "location"], compat=True)


def audit_interim(spark, sf_dir):
    r = _recs(spark, sf_dir).withColumn("rr", template_vector(baseline_rules()))
    out = r.withColumn("quality", audit_compat(F.col("rr"), N_RULES))
    return _audit_out(out, ["key"], compat=True)


def rule_runner(spark, sf_dir):
    return _audit_out(run_rules(spark, _recs(spark, sf_dir), sql_suite()), ["key"], compat=False)


def json_suite(spark, sf_dir):
    out = with_vector(spark, _recs(spark, sf_dir), sql_suite(), bind_json("payload", CUSTOMER_DDL))
    return _vec_out(out, ["key"])


def json_baseline_vector(spark, sf_dir):
    b = bind_json("payload", CUSTOMER_DDL)
    out = b.cleanup(b.prepare(_recs(spark, sf_dir)).withColumn("quality", template_vector(baseline_rules(), b)))
    return _vec_out(out, ["key"])


def json_audit(spark, sf_dir):
    b = bind_json("payload", CUSTOMER_DDL)
    staged = b.prepare(_recs(spark, sf_dir)).withColumn("rr", template_vector(baseline_rules(), b))
    return _audit_out(staged.withColumn("quality", audit_compat(F.col("rr"), N_RULES)), ["key"], compat=True)


def suite_metadata(spark, sf_dir):
    s = _two_sets()
    return suite_counts(with_vector(spark, _recs(spark, sf_dir), s), "quality", s)


def rule_counts_q(spark, sf_dir):
    return rule_counts(with_vector(spark, _recs(spark, sf_dir), sql_suite()), "quality", RULE_IDS)


def distinct_results_q(spark, sf_dir):
    d = distinct_suite_results(spark, _recs(spark, sf_dir), sql_suite(), compat=True)
    sets = F.get(F.col("result.ruleSets"), F.lit(0)).getField("value")
    cols = [F.col("result.overallResult").alias("overall"), sets.getField("setResult").alias("set_result")]
    cols += [F.get(sets.getField("rules"), F.lit(i)).getField("value").alias(f"r{i}") for i in range(N_RULES)]
    return d.select(*cols, "n")


# ---- scalar functions -----------------------------------------------------

def fn_array_case(spark, sf_dir):
    g = _grp(spark, sf_dir)
    m = group_members(F.col("grp"))
    return g.select("key", "grp", F.array_join(m, ",").alias("members"), F.size(m).alias("n_members"))


def fn_membership(spark, sf_dir):
    e = customer_edge_records(spark, sf_dir)
    cols = [(applicable_for(g, F.col("location")) & (F.col("department") == F.lit(d))).alias(f"r{rid}")
            for rid, g, d in SQL_SUITE_RULES if g in GROUPS]
    return e.select("key", *cols)


def fn_missing(spark, sf_dir):
    e = customer_edge_records(spark, sf_dir)
    return e.select("key", F.expr(r"if(id IS NULL, true, regexp_like(cast(id AS STRING), '^\\s*$'))").alias("id_missing"),
                    F.expr(r"if(code IS NULL, true, regexp_like(code, '^\\s*$'))").alias("code_missing"))


def fn_audit_build(spark, sf_dir):
    e = customer_edge_records(spark, sf_dir)
    out = with_vector(spark, e, sql_suite())
    return _audit_out(out.withColumn("quality", audit(F.col("quality"), sql_suite())), ["key"], compat=False)


# ---- decision models ------------------------------------------------------

def decision_table_lookup(spark, sf_dir):
    t = group_table()
    g = _grp(spark, sf_dir)
    first = DecisionTable("first_group", member_table().rows, output_type="string", hit_policy="FIRST", default="none")
    every = DecisionTable("all_groups", member_table().rows, output_type="string", hit_policy="COLLECT")
    joined = t.lookup(spark, g.withColumn("place", F.nullif("location", F.lit("UK"))), "grp", "members_join")
    joined = every.lookup(spark, first.lookup(spark, joined, "place", "first_join"), "place", "all_join")
    return joined.select("key", "grp", F.array_join(t.column(F.col("grp")), ",").alias("members_case"),
                         F.array_join("members_join", ",").alias("members_join"),
                         first.column(F.col("place")).alias("first_case"), "first_join",
                         F.array_join(every.column(F.col("place")), ",").alias("all_case"),
                         F.array_join("all_join", ",").alias("all_join"))


def decision_table_conflicts(spark, sf_dir):
    t = member_table()
    out = t.hit_counts(spark, _recs(spark, sf_dir).select("key", "location"), "location")
    broken = t.conflicts(spark).select(F.col("input").alias("bad"), F.col("hits").alias("more"))
    out = join_small(out, broken, [("location", "bad")], how="left")
    return out.select("key", "location", "hits", "policy_ok", F.col("more").isNotNull().alias("conflict"))


def decision_rules_join(spark, sf_dir):
    return rule_hits(spark, _recs(spark, sf_dir), DECISION_SUITE_RULES, "key")


def orders_rule_hits(spark, sf_dir):
    """Rules 1-5 of the orders suite as data, found by the join."""
    rules = [Condition(1, {"priority": PRIORITY_GROUPS["Urgent"], "status": ("F",)}),
             Condition(2, {"priority": PRIORITY_GROUPS["Urgent"], "status": ("O",)}),
             Condition(3, {"priority": PRIORITY_GROUPS["Routine"], "status": ("P",)}),
             Condition(4, {"priority": PRIORITY_GROUPS["Routine"], "status": ("F",)}),
             Condition(5, {"status": ("O",)}, missing=("priority",))]
    return rule_hits(spark, _orders(spark, sf_dir), rules, "o_orderkey", bind_fields(ORDERS_FIELDS))


def decision_functions(spark, sf_dir):
    register_functions(spark, sql_suite().functions + decision_suite().functions)
    return _grp(spark, sf_dir).select(
        "key", "grp", F.expr("`dq is applicable for`(grp, location)").alias("applicable_sql"),
        F.expr("`common.dq is applicable for`(grp, location)").alias("applicable_decision"),
        F.expr("`common.isMissing`(key)").alias("key_missing"))


def _model():
    """Three decisions: every rule, the membership rules, the missing-id rules; a service for the last."""
    by_test = lambda missing: tuple((1, rid) for rid, t, _ in DECISION_SUITE_RULES if (t not in GROUPS) == missing)
    return DecisionModel(decision_suite(), {"membership": by_test(False), "missing": by_test(True)},
                         {"DQService": ("evaluate",), "MissingService": ("missing",)})


def _names(decision, prefix="r"):
    keys = _model().all_decisions()[decision]
    return [F.get(f"quality.{decision}", F.lit(i)).alias(f"{prefix}{rid}") for i, (_, rid) in enumerate(keys)]


def decision_evaluate(spark, sf_dir):
    out = _model().evaluate(spark, _recs(spark, sf_dir), bind_struct("struct_payload"))
    return _decision_out(out, ["key"])


def decision_service(spark, sf_dir):
    out = _model().evaluate(spark, _recs(spark, sf_dir), bind_fields(), service="MissingService")
    return out.select("key", *_names("missing"))


def decision_all(spark, sf_dir):
    out = _model().evaluate(spark, _recs(spark, sf_dir), bind_fields(), service=None, with_context=True)
    ctx = [F.col("quality.context").getField(f"r{i}").alias(f"c{i}") for i in RULE_IDS]
    return out.select("key", *flatten_vector(F.col("quality.evaluate"), N_RULES), *_names("membership", "g"),
                      *_names("missing", "m"), *ctx)


def bind_json_q(spark, sf_dir):
    out = _model().evaluate(spark, _gen(spark, sf_dir), bind_json("payload"), service=None)
    return _decision_out(out, ["id", "idPrefix", "location"])


def bind_struct_q(spark, sf_dir):
    """The record as a stored struct: only the fields that the rules name are read."""
    path = write_parquet(_gen(spark, sf_dir).select("struct_payload"), scratch_path(spark, "structs"))
    rows = read_parquet(spark, path).withColumns({c: F.col(f"struct_payload.{c}") for c in ("id", "idPrefix", "location")})
    out = _model().evaluate(spark, rows, bind_struct("struct_payload"))
    return _decision_out(out, ["id", "idPrefix", "location"])


def bind_fields_q(spark, sf_dir):
    out = _model().evaluate(spark, _gen(spark, sf_dir), bind_fields(), service=None)
    return _decision_out(out, ["id", "idPrefix", "location"])


def result_struct(spark, sf_dir):
    """The typed result of every decision, its struct spread into columns."""
    out = _model().evaluate(spark, _recs(spark, sf_dir), bind_struct("struct_payload"), service=None)
    wide = out.select("key", "quality.*")
    return wide.select("key", *[F.size(c).alias(f"n_{c}") for c in wide.columns[1:]],
                       *[F.array_contains(c, F.lit(True)).alias(f"any_{c}") for c in wide.columns[1:]])


def result_json(spark, sf_dir):
    out = _model().evaluate(spark, _recs(spark, sf_dir), bind_json("payload", CUSTOMER_DDL), as_json=True)
    return out.select("key", F.col("quality").alias("result"))


def bad_record_null(spark, sf_dir):
    """Malformed, mistyped, NULL and blank payloads give no result; a cast that fails in a rule gives NULL."""
    e = customer_edge_records(spark, sf_dir)
    payload = (F.when((F.col("balance") >= 1000) & (F.col("balance") < 1500), F.lit(None))
               .when((F.col("balance") >= 1500) & (F.col("balance") < 2000), F.lit("  ")).otherwise(F.col("payload")))
    base = decision_suite()
    failing = Rule(Id(16, 1), "cast({department} AS INT) > 3")
    suite = RuleSuite(base.id, (RuleSet(base.sets[0].id, (*base.sets[0].rules, failing)),), base.functions)
    b = bind_json("payload", CUSTOMER_DDL, bad_records_null=True, errors_null=True)
    out = DecisionModel(suite).evaluate(spark, e.withColumn("payload", payload), b)
    return out.select("key", F.col("quality").isNull().alias("result_null"),
                      *flatten_vector(F.col("quality.evaluate"), N_RULES + 1))


# ---- a second suite: orders, bound by column mapping ----------------------

def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders")


def orders_audit(spark, sf_dir):
    """Both rule sets of the orders suite on every order: overall, set and rule results."""
    out = run_rules(spark, _orders(spark, sf_dir), orders_suite(), bind_fields(ORDERS_FIELDS))
    q = F.col("quality")
    cols = [q.getField("any_failed").alias("overall")]
    for sid, rules in ORDERS_RULE_SETS.items():
        s = q.getField("ruleSets")[F.lit(sid).cast("bigint")]
        cols.append(s.getField("any_failed").alias(f"set{sid}"))
        cols += [s.getField("rules")[F.lit(rid).cast("bigint")].alias(f"r{rid}") for rid, _ in rules]
    return out.select(F.col("o_orderkey").alias("key"), *cols)


def orders_rule_counts(spark, sf_dir):
    suite = orders_suite()
    out = with_vector(spark, _orders(spark, sf_dir), suite, bind_fields(ORDERS_FIELDS))
    return rule_counts(out, "quality", [r.id.id for _, r in suite.rules()])


def stream_rule_vector(spark, sf_dir):
    """The suite on a stream: customer file as a streaming source, checkpointed Parquet sink."""
    schema = read_table(spark, sf_dir, "customer").schema
    path = f"{sf_dir.rstrip('/')}/customer.parquet"
    reader = spark.readStream.schema(schema)
    if is_folder(spark, path):  # a table of part files
        stream = reader.parquet(path)
    else:  # file streams read folders: the data folder, filtered to the one file
        stream = reader.option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    out = with_vector(spark, customer_records(spark, sf_dir, customer=stream), sql_suite())
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    run_to_parquet(out.select("key", "quality"), sink, ckpt)
    return _vec_out(read_parquet(spark, sink), ["key"])


def typed_input(spark, sf_dir):
    e = customer_edge_records(spark, sf_dir)
    as_text = ", ".join(f"{n} STRING" for n, _ in RECORD_FIELDS)
    raw = e.select("key", F.from_json("payload", as_text).alias("p")).select("key", "p.*")
    fields = [(n, "BIGINT" if n == "id" else t) for n, t in RECORD_FIELDS]
    typed = typed_record(raw, fields, keep=("key",))
    # shown as text: a nullable integer reaches a checker as a float otherwise
    return typed.withColumns({c: F.col(c).cast("string") for c in ("id", "page")})


# ---- rules over other rules, nested records, errors, rules from a table, libraries -------------------------

def _chain() -> RuleSuite:
    """Rules that use other rules' results, before and after their own place."""
    rules = (Rule(Id(1, 1), "{department} IN ('sales', 'hr')", name="people"), Rule(Id(2, 1), "{id} % 3 = 0"),
             Rule(Id(3, 1), "{people} AND {r2}"), Rule(Id(4, 1), "NOT {r3} OR {abroad}"),
             Rule(Id(5, 1), "`dq is applicable for`('Non UK', {location})", name="abroad"),
             Rule(Id(6, 1), "{r4} AND NOT {r2} AND {page} < 9"))
    return RuleSuite(Id(8, 1), (RuleSet(Id(1, 1), rules),), sql_suite().functions)


def entry_chain(spark, sf_dir):
    """The vector, the audit and the decision model's entries of rules over other rules."""
    suite = _chain()
    out = with_vector(spark, customer_edge_records(spark, sf_dir), suite, out="v")
    out = run_rules(spark, out, suite)
    out = DecisionModel(suite).evaluate(spark, out, service=None, out="d", with_context=True)
    entries = [F.col("d.context").getField(n).alias(f"c{i}") for i, n in enumerate(suite.entry_names(), 1)]
    return out.select("key", F.col("quality.any_failed").alias("any_failed"), *flatten_vector(F.col("v"), 6), *entries)


NESTED_DDL = ("customer STRUCT<id: BIGINT, address: STRUCT<city: STRING, zone: STRUCT<code: STRING, page: BIGINT, spare: STRING>>>, "
              "tags ARRAY<STRUCT<name: STRING, weight: INT>>")
NESTED_RULES = ("{customer.address.city} = 'US' AND {customer.id} % 2 = 0", "{customer.address.zone.code} LIKE 'A%'",
                "{Customer.Address.Zone.Page} > 10 OR {town} IS NULL", "array_contains({tags.name}, {town})")


def nested_paths(spark, sf_dir):
    """One suite over nested fields, a nested struct and nested JSON."""
    e = customer_edge_records(spark, sf_dir)
    zone = F.struct(F.col("idPrefix").alias("code"), "page", F.lit("unused").alias("spare"))
    customer = F.struct(F.col("key").alias("id"), F.struct(F.col("location").alias("city"), zone.alias("zone")).alias("address"))
    tags = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("weight")) for i, n in enumerate(("US", "CH"))])
    out = e.select("key", customer.alias("customer"), tags.alias("tags"))
    out = out.withColumn("record", F.struct("customer", "tags")).withColumn("text", F.to_json("record"))
    suite = RuleSuite(Id(10, 1), (RuleSet(Id(1, 1), tuple(Rule(Id(i, 1), t) for i, t in enumerate(NESTED_RULES, 1))),))
    town = "customer.address.city"
    for name, b in (("f", bind_fields({"town": town})), ("s", bind_struct("record", {"town": f"record.{town}"})),
                    ("j", bind_json("text", NESTED_DDL, columns={"town": town}))):
        out = with_vector(spark, out, suite, b, out=f"v{name}")
    return out.select("key", *[c for n in "fsj" for c in flatten_vector(F.col(f"v{n}"), len(NESTED_RULES), n)])


# Each fails on some rows: written as ::, as a function, implicitly, by division, index, date, number and overflow.
FAILING_RULES = ("{v}::int > 700", "int({v}) > 700", "{v} > 700", "100 / {page} > 10", "array(1, 2)[{page}] = 1",
                 "to_date(concat('2', {v}), 'yyyy') > DATE'2500-01-01'", "to_number({v}, '999') > 700", "2147483640 + cast({page} AS INT) > 0",
                 "if({page} = 3, raise_error('three'), {page} > 1)", "{page} % 2 = 0")


def rule_errors_null(spark, sf_dir):
    """Rules that fail are NULL; with "result" a row with a failing rule has no result at all."""
    e = customer_edge_records(spark, sf_dir)
    v = F.lpad(F.pmod("key", F.lit(1000)).cast("string"), 4, "0")
    df = e.select("key", "page", F.when(F.col("balance") < 0, F.concat(F.lit("x"), v)).otherwise(F.substring(v, 2, 3)).alias("v"))
    suite = RuleSuite(Id(11, 1), (RuleSet(Id(1, 1), tuple(Rule(Id(i, 1), t) for i, t in enumerate(FAILING_RULES, 1))),))
    out = with_vector(spark, df, suite, bind_fields(errors_null="rule"), out="each")
    some = RuleSuite(Id(12, 1), (RuleSet(Id(1, 1), suite.sets[0].rules[:3]),))
    out = with_vector(spark, out, some, bind_fields(errors_null="result"), out="whole")
    return out.select("key", *flatten_vector(F.col("each"), len(FAILING_RULES)), F.col("whole").isNull().alias("no_result"),
                      *flatten_vector(F.col("whole"), 3, "w"))


def rules_frame_hits(spark, sf_dir):
    """Rules from a table: each day's statuses and prices of urgent orders, met by any order."""
    orders = _orders(spark, sf_dir)
    day = F.col("o_orderdate").cast("date")
    rules = orders.where("o_orderpriority = '1-URGENT'").groupBy(day.alias("day")).agg(
        F.collect_set("o_orderstatus").alias("status"), F.datediff(F.first(day), F.lit("1990-01-01").cast("date")).alias("rule_id"))
    prices = orders.where("o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 0").select(
        (-F.col("o_orderkey")).cast("int").alias("rule_id"), F.col("o_totalprice").alias("price"))
    rules = rules.unionByName(prices, allowMissingColumns=True)
    records = orders.select("o_orderkey", day.alias("day"), "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("total"))
    return rule_hits(spark, records, rules, "o_orderkey", bind_fields({"status": "o_orderstatus", "price": "total"}))


def _two_libraries() -> RuleSuite:
    """Two libraries with the same function names, the second under a prefix and with a function over its others."""
    either = FunctionDef("either", (("g", "STRING"), ("loc", "STRING"), ("v", "STRING")), "BOOLEAN",
                         "isMissing(v) OR `dq is applicable for`(g, loc)", Id(7, 2))
    rules = (Rule(Id(1, 1), "`dq is applicable for`({grp}, {location})"),
             Rule(Id(2, 3), "`model.dq is applicable for`({grp}, {location})"),
             Rule(Id(3, 1), "`model.either`({grp}, {location}, {id}) AND {id} % 2 = 0"), Rule(Id(4, 1), "isMissing({id})"),
             Rule(Id(5, 1), "{id} > 100"))
    base = RuleSuite(Id(13, 1), (RuleSet(Id(1, 1), rules),), sql_suite().functions)
    model = (make_suite(default=None).functions[0], make_suite().functions[1], either)
    return base.with_functions(model, "model.")


def imported_library(spark, sf_dir):
    suite = _two_libraries()
    out = with_vector(spark, _grp_records(spark, sf_dir), suite)
    return out.select("key", *flatten_vector(F.col("quality"), 5))


def _grp_records(spark, sf_dir):
    e = customer_edge_records(spark, sf_dir)
    return e.select("key", "id", "location", case_lookup(F.col("code"), SEGMENT_GROUP).alias("grp"))


def function_usage(spark, sf_dir):
    """Every function of two libraries: identity, rules that depend on it, and how often those are TRUE."""
    suite = _two_libraries()
    counts = suite_counts(with_vector(spark, _grp_records(spark, sf_dir), suite), "quality", suite)
    uses = suite.function_metadata(spark)
    both = join_small(uses, counts.select(F.col("rule_id").alias("counted"), "n_true"), [("rule_id", "counted")], how="left")
    return both.groupBy("function_name", "function_id", "function_version").agg(
        F.count("rule_id").alias("n_rules"), F.count_if("direct").alias("n_direct"),
        F.coalesce(F.sum("n_true"), F.lit(0)).cast("bigint").alias("n_true"))


# Text and other values that lose something in the declared type on some rows.
LOSSY_FIELDS = (("price", "DECIMAL(12,1)"), ("stamp", "DATE"), ("big", "FLOAT"), ("status", "CHAR(3)"), ("total", "INT"),
                ("moment", "DATE"), ("whole", "FLOAT"))


def typed_loss(spark, sf_dir):
    """One flag for each pair of types: whether the order's value keeps its meaning."""
    o, key = _orders(spark, sf_dir), F.col("o_orderkey")
    cents = (key % 7).cast("string")
    df = o.select(
        key.alias("key"), F.concat((key % 900).cast("string"), F.lit("."), cents, F.lit("0")).alias("price"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 3 == 0, F.lit(" 10:00:00")).otherwise(F.lit(""))).alias("stamp"),
        (F.lit(16777216) + key).cast("string").alias("big"),
        F.concat("o_orderstatus", F.substring("o_orderpriority", 3, 3)).alias("status_4"),
        F.col("o_orderstatus").alias("status_1"), F.col("o_totalprice").alias("total"),
        F.timestamp_seconds(key * 43200).cast("timestamp_ntz").alias("moment"), (F.lit(16777216) + key).alias("whole"))
    df = df.withColumn("status", F.when(F.col("key") % 2 == 0, F.col("status_4")).otherwise(F.col("status_1")))
    return df.select("key", *[lossless(df, name, typ)[1].alias(f"{name}_ok") for name, typ in LOSSY_FIELDS])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gen_records": gen_records,
    "copy_records": copy_records,
    "parquet_roundtrip": parquet_roundtrip,
    "struct_payload_fields": struct_payload_fields,
    "json_payload": json_payload,
    "json_parse": json_parse,
    "suite_count": suite_count,
    "suite_cache_count": suite_cache_count,
    "rule_single": rule_single,
    "rule_vector": rule_vector_q,
    "rule_suite": rule_suite_q,
    "sql_function_rule": sql_function_rule,
    "named_list_rule": named_list_rule,
    "rule_membership": rule_membership,
    "rule_missing": rule_missing,
    "baseline_vector": baseline_vector,
    "rule_audit": rule_audit,
    "rule_audit_compat": rule_audit_compat,
    "audit_interim": audit_interim,
    "rule_runner": rule_runner,
    "json_suite": json_suite,
    "json_baseline_vector": json_baseline_vector,
    "json_audit": json_audit,
    "suite_metadata": suite_metadata,
    "rule_counts": rule_counts_q,
    "distinct_results": distinct_results_q,
    "fn_array_case": fn_array_case,
    "fn_membership": fn_membership,
    "fn_missing": fn_missing,
    "fn_audit_build": fn_audit_build,
    "decision_table_lookup": decision_table_lookup,
    "decision_table_conflicts": decision_table_conflicts,
    "decision_rules_join": decision_rules_join,
    "decision_functions": decision_functions,
    "decision_evaluate": decision_evaluate,
    "decision_service": decision_service,
    "decision_all": decision_all,
    "bind_json": bind_json_q,
    "bind_struct": bind_struct_q,
    "bind_fields": bind_fields_q,
    "result_struct": result_struct,
    "result_json": result_json,
    "bad_record_null": bad_record_null,
    "typed_input": typed_input,
    "stream_rule_vector": stream_rule_vector,
    "rule_text": rule_text,
    "wide_rule_counts": wide_rule_counts,
    "stored_json_suite": stored_json_suite,
    "orders_rule_hits": orders_rule_hits,
    "orders_audit": orders_audit,
    "orders_rule_counts": orders_rule_counts,
    "entry_chain": entry_chain,
    "nested_paths": nested_paths,
    "rule_errors_null": rule_errors_null,
    "rules_frame_hits": rules_frame_hits,
    "imported_library": imported_library,
    "function_usage": function_usage,
    "typed_loss": typed_loss,
}

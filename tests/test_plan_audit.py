"""Every registered query's physical plan, read through explain().

Joins are broadcasts of sides with an exact row count; nothing runs in
Python; the only shuffles carry partial aggregates; scans read only the
columns a query needs.
"""

import re

import pytest

import __spark_entry__ as E
from ruleframe.plans.catalog import QUERIES
from ruleframe.plans.inspect import plan_text

from conftest import SF001

# Queries that end in an aggregation: one shuffle of per-task partial results.
AGGREGATING = {"suite_count", "suite_cache_count", "suite_metadata", "rule_counts", "distinct_results",
               "decision_table_conflicts", "orders_rule_counts", "wide_rule_counts", "decision_table_lookup", "function_usage",
               "rules_frame_hits"}
# Columns of the scanned tables that no query needs.
UNUSED = ("c_name", "o_custkey", "o_orderdate", "n_comment")
USES_DATES = {"rules_frame_hits", "typed_loss"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin", "ShuffledHashJoin",
             "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def _operators(plan: str) -> list[str]:
    """Operator lines of the physical plan, top-down, without tree drawing."""
    body = plan.split("== Physical Plan ==", 1)[1]
    ops = []
    for line in body.splitlines():
        line = re.sub(r"^[\s:+\-|*()0-9]*", "", line)
        if line and not line.startswith("=="):
            ops.append(line)
    return ops


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = plan_text(QUERIES[name](spark, SF001), "simple")
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    ops = _operators(plan)
    # the generator spreads its keys first: a round robin of the 130x smaller side
    shuffles = [i for i, op in enumerate(ops) if op.startswith("Exchange ") and "RoundRobinPartitioning" not in op]
    if name not in AGGREGATING:
        assert not shuffles, f"{name} shuffles: {[ops[i] for i in shuffles]}"
    for i in shuffles:
        below = ops[i + 1]
        assert re.match(r"(Hash|Sort|ObjectHash)Aggregate", below) and "partial_" in below or "functions=[]" in below, (
            f"{name}: shuffle without partial aggregation below: {below}")
    # no scan reads a column no query uses
    for schema in re.findall(r"ReadSchema: (struct<[^\]\n]*>)", plan):
        for col in UNUSED:
            assert col + ":" not in schema or col == "o_orderdate" and name in USES_DATES, schema


def test_counts_evaluate_rules(spark):
    """A count of the suite outcome keeps the rule inputs in the scan."""
    plan = plan_text(E.queries()["suite_count"](spark, SF001), "simple")
    assert "c_mktsegment" in plan and "n_regionkey" in plan


# Interpreted row operators allowed: Spark's JSON parser has no generated
# code, and distinct results make maps comparable on aggregated rows only.
INTERPRETED_OK = ("from_json(",)
AFTER_AGGREGATION = {"distinct_results"}
# A vector of more than runner.WIDE rules leaves whole-stage code on purpose (its one method would be too long
# for the JVM to compile): generated code of its own, told by the guard that vector_of appends.
WIDE_SUITES = {"wide_rule_counts"}


def test_row_operators_in_whole_stage_codegen(spark):
    """Projections, filters and generators run in generated code, except the JSON parser."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans show codegen stages only when run
    try:
        for name, q in sorted(QUERIES.items()):
            body = plan_text(q(spark, SF001), "simple").split("== Physical Plan ==", 1)[1]
            for line in body.splitlines():
                if not re.match(r"^[\s:+\-|]*(Project|Filter|Generate) ", line):
                    continue  # a line starting with "*(n)" is inside whole-stage codegen
                if any(k in line for k in INTERPRETED_OK) or name in WIDE_SUITES and "filter(array((xxhash64(" in line:
                    continue
                assert name in AFTER_AGGREGATION and "__n" in line, f"{name}: {line.strip()[:160]}"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

"""Random records: Spark rule vectors against a brute-force Python evaluator."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ruleframe.operators.decision import DecisionModel
from ruleframe.operators.runner import with_vector
from ruleframe.sources.bindings import bind_fields, bind_json, bind_struct
from ruleframe.suites import DECISION_SUITE_RULES, GROUPS, MISSING, SQL_SUITE_RULES, decision_suite, sql_suite

LOCS = [None, "US", "UK", "CH", "MX", "BR", "FR", ""]
DEPTS = [None, "sales", "marketing", "hr", "it", "ops", "legal"]
IDS = [None, "", "  ", "\t", "s", "0", "17", " 5 "]


def _and(a, b):
    if a is False or b is False:
        return False
    if a is None or b is None:
        return None
    return True


def _eval(rule_table, loc, dept, id_):
    out = []
    for _, test, d in rule_table:
        if test == MISSING:
            lhs = True if id_ is None else bool(re.fullmatch(r"\s*", id_))
        else:
            lhs = None if loc is None else loc in GROUPS[test]
        rhs = None if dept is None else dept == d
        out.append(_and(lhs, rhs))
    return out


records = st.lists(st.tuples(st.sampled_from(LOCS), st.sampled_from(DEPTS), st.sampled_from(IDS)),
                   min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(records)
def test_sql_suite_matches_brute_force(spark, recs):
    rows = [(i, loc, "p", id_, 1, dept) for i, (loc, dept, id_) in enumerate(recs)]
    df = spark.createDataFrame(rows, "k int, location string, idPrefix string, id string, page bigint, department string")
    got = {r["k"]: r["quality"] for r in with_vector(spark, df, sql_suite()).select("k", "quality").collect()}
    for i, (loc, dept, id_) in enumerate(recs):
        assert got[i] == _eval(SQL_SUITE_RULES, loc, dept, id_), (loc, dept, id_)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(records)
def test_decision_model_all_bindings_match_brute_force(spark, recs):
    rows = [(i, loc, "p", id_, 1, dept) for i, (loc, dept, id_) in enumerate(recs)]
    df = spark.createDataFrame(rows, "k int, location string, idPrefix string, id string, page bigint, department string")
    df = df.selectExpr("*", "to_json(named_struct('location', location, 'idPrefix', idPrefix, 'id', id, "
                       "'page', page, 'department', department)) AS payload",
                       "named_struct('location', location, 'idPrefix', idPrefix, 'id', id, 'page', page, "
                       "'department', department) AS struct_payload")
    m = DecisionModel(decision_suite())
    ddl = "location STRING, idPrefix STRING, id STRING, page BIGINT, department STRING"
    for b in (bind_fields(), bind_struct("struct_payload"), bind_json("payload", ddl)):
        got = {r["k"]: r["e"] for r in m.evaluate(spark, df, b).selectExpr("k", "quality.evaluate AS e").collect()}
        for i, (loc, dept, id_) in enumerate(recs):
            assert got[i] == _eval(DECISION_SUITE_RULES, loc, dept, id_), (b.kind, loc, dept, id_)


# Join keys: two columns, NULLs allowed; a small key space makes hot keys.
KEY = st.tuples(st.sampled_from([None, 0, 1, 2, 3]), st.sampled_from([None, "a", "b"]))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(KEY, min_size=1, max_size=80), st.lists(KEY, min_size=0, max_size=12),
       st.sampled_from(["inner", "left"]), st.sampled_from([0, 1 << 20]))
def test_join_small_matches_nested_loops(spark, big_keys, small_keys, how, limit):
    """Join by broadcast or shuffle = brute-force join (all rows kept, none doubled)."""
    from collections import Counter

    from ruleframe.operators.joins import join_small

    big = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(big_keys)], "rid int, a int, b string")
    small = spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(small_keys)], "sid int, sa int, sb string")
    got = Counter(tuple(r) for r in join_small(big, small, [("a", "sa"), ("b", "sb")], how=how,
                                               limit=limit).select("rid", "sid").collect())
    want = Counter()
    for i, (a, b) in enumerate(big_keys):
        hits = [j for j, (sa, sb) in enumerate(small_keys)
                if a is not None and b is not None and (a, b) == (sa, sb)]
        for j in hits:
            want[(i, j)] += 1
        if not hits and how == "left":
            want[(i, None)] += 1
    assert got == want

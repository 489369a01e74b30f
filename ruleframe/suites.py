"""The benchmark rule suites.

Two suites over the record (location, idPrefix, id, page, department): the
SQL suite and the decision-model suite.  They agree except for rules 11-13.
"""

from __future__ import annotations

from ruleframe.model import FunctionDef, Id, Rule, RuleSet, RuleSuite

# --- fixed values (must equal the benchmark's definitions) -----------------
# Location groups, in definition order: group name -> member locations.
GROUPS = {
    "Non UK": ("US", "CH", "MX", "BR"),
    "UK & US": ("US", "UK"),
    "Americas": ("US", "MX", "BR"),
    "Europe": ("CH",),
}

# SQL suite, rules 1..15: (rule id, test, department).  A test is a group
# name (location membership) or "isMissing" (id is null or blank).
SQL_SUITE_RULES = (
    (1, "Non UK", "sales"),
    (2, "UK & US", "marketing"),
    (3, "Americas", "hr"),
    (4, "Europe", "it"),
    (5, "isMissing", "ops"),
    (6, "Non UK", "marketing"),
    (7, "UK & US", "hr"),
    (8, "Americas", "it"),
    (9, "Europe", "sales"),
    (10, "isMissing", "sales"),
    (11, "Non UK", "it"),
    (12, "UK & US", "sales"),
    (13, "Americas", "marketing"),
    (14, "Europe", "hr"),
    (15, "isMissing", "hr"),
)

# Decision-model suite, rules 1..15 (rules 11, 12 and 13 differ).
DECISION_SUITE_RULES = (
    (1, "Non UK", "sales"),
    (2, "UK & US", "marketing"),
    (3, "Americas", "hr"),
    (4, "Europe", "it"),
    (5, "isMissing", "ops"),
    (6, "Non UK", "marketing"),
    (7, "UK & US", "hr"),
    (8, "Americas", "it"),
    (9, "Europe", "sales"),
    (10, "isMissing", "sales"),
    (11, "Non UK", "sales"),
    (12, "UK & US", "hr"),
    (13, "Americas", "sales"),
    (14, "Europe", "hr"),
    (15, "isMissing", "hr"),
)

# Record type of the benchmark data, as DDL.
RECORD_FIELDS = (
    ("location", "STRING"),
    ("idPrefix", "STRING"),
    ("id", "INT"),
    ("page", "BIGINT"),
    ("department", "STRING"),
)

# Blank test used by isMissing: null, empty or whitespace only.
BLANK_PATTERN = r"^\s*$"

# Function names used by the suites; the decision model imports its
# functions from the "common" library under that prefix.
APPLICABLE_FN = "dq is applicable for"
MISSING_FN = "isMissing"
DECISION_LIBRARY = "common"
# ---------------------------------------------------------------------------

MISSING = "isMissing"


def sql_quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def group_case_sql(group_sql: str, default: str | None = "array()") -> str:
    """CASE mapping a group name to its member array.

    ``default`` is the ELSE branch: ``array()`` (unknown group -> no member)
    for the SQL suite, ``None`` (unknown group -> NULL) for a decision table
    without a default row.
    """
    whens = " ".join(
        f"WHEN {group_sql} = {sql_quote(g)} THEN array({', '.join(sql_quote(m) for m in ms)})"
        for g, ms in GROUPS.items()
    )
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def blank_pattern_sql() -> str:
    return sql_quote(BLANK_PATTERN)


def applicable_function(default: str | None = "array()", prefix: str = "") -> FunctionDef:
    """`dq is applicable for`(grp, loc): is ``loc`` a member of group ``grp``."""
    return FunctionDef(
        prefix + APPLICABLE_FN,
        (("grp", "STRING"), ("loc", "STRING")),
        "BOOLEAN",
        f"array_contains({group_case_sql('grp', default)}, loc)",
        Id(5, 1),
    )


def missing_function(prefix: str = "") -> FunctionDef:
    """isMissing(v): null, empty or blank (the value is compared as text)."""
    return FunctionDef(
        prefix + MISSING_FN,
        (("v", "STRING"),),
        "BOOLEAN",
        # NULL -> TRUE, else the blank match; ``v`` is read once so the
        # analyzer's parameter projection collapses into the caller.
        f"coalesce(regexp_like(v, {blank_pattern_sql()}), true)",
        Id(6, 1),
    )


def rule_template(test: str, department: str, prefix: str = "") -> str:
    """Rule text with {field} placeholders, calling the suite's functions."""
    if test == MISSING:
        lhs = f"`{prefix}{MISSING_FN}`({{id}})"
    else:
        lhs = f"`{prefix}{APPLICABLE_FN}`({sql_quote(test)}, {{location}})"
    return f"{lhs} AND {{department}} = {sql_quote(department)}"


def inlined_template(test: str, department: str) -> str:
    """Hand-inlined rule text: no function call, literal CASE (folds away)."""
    if test == MISSING:
        lhs = f"if({{id}} IS NULL, true, regexp_like({{id}}, {blank_pattern_sql()}))"
    else:
        lhs = f"array_contains({group_case_sql(sql_quote(test))}, {{location}})"
    return f"{lhs} AND {{department}} = {sql_quote(department)}"


def make_suite(rule_table=SQL_SUITE_RULES, *, suite_id: Id = Id(1, 1), set_id: Id = Id(1, 1),
               default: str | None = "array()", prefix: str = "") -> RuleSuite:
    rules = tuple(Rule(Id(rid, 1), rule_template(test, dept, prefix)) for rid, test, dept in rule_table)
    return RuleSuite(suite_id, (RuleSet(set_id, rules),),
                     (applicable_function(default, prefix), missing_function(prefix)))


def sql_suite() -> RuleSuite:
    return make_suite(SQL_SUITE_RULES)


def decision_suite() -> RuleSuite:
    """Decision-model rules; the group table has no default row (unknown -> NULL).

    Functions come from the "common" library: `common.dq is applicable for`
    and `common.isMissing`.
    """
    return make_suite(DECISION_SUITE_RULES, suite_id=Id(2, 1), default=None, prefix=DECISION_LIBRARY + ".")


def baseline_rules(rule_table=SQL_SUITE_RULES) -> list[str]:
    """The hand-inlined baseline: one SQL template per rule."""
    return [inlined_template(test, dept) for _, test, dept in rule_table]


def record_ddl(id_type: str = "INT") -> str:
    return ", ".join(f"{n} {id_type if n == 'id' else t}" for n, t in RECORD_FIELDS)


# --- fixed values (test fixture: a second, user-written suite over orders) --
# Priority groups: group name -> member priorities.
PRIORITY_GROUPS = {
    "Urgent": ("1-URGENT", "2-HIGH"),
    "Routine": ("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
}
PRIORITY_FN = "priority in"
# Rule sets: set id -> rules (rule id, rule text over {status}, {priority}, {total}).
ORDERS_RULE_SETS = {
    1: (
        (1, "`priority in`('Urgent', {priority}) AND {status} = 'F'"),
        (2, "`priority in`('Urgent', {priority}) AND {status} = 'O'"),
        (3, "`priority in`('Routine', {priority}) AND {status} = 'P'"),
        (4, "`priority in`('Routine', {priority}) AND {status} = 'F'"),
    ),
    2: (
        (5, "isMissing({priority}) AND {status} = 'O'"),
        (6, "{total} > 300000 AND {status} = 'F'"),
    ),
}
# Record fields of the orders suite -> orders columns.
ORDERS_FIELDS = {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}
# ---------------------------------------------------------------------------


def priority_function() -> FunctionDef:
    """`priority in`(grp, p): is priority ``p`` in group ``grp`` (unknown group: FALSE)."""
    whens = " ".join(f"WHEN grp = {sql_quote(g)} THEN array({', '.join(sql_quote(m) for m in ms)})"
                     for g, ms in PRIORITY_GROUPS.items())
    return FunctionDef(PRIORITY_FN, (("grp", "STRING"), ("p", "STRING")), "BOOLEAN",
                       f"array_contains(CASE {whens} ELSE array() END, p)", Id(7, 1))


def orders_suite() -> RuleSuite:
    """A user suite of two rule sets over orders, with its own function library."""
    sets = tuple(RuleSet(Id(sid, 1), tuple(Rule(Id(rid, 1), text) for rid, text in rules))
                 for sid, rules in ORDERS_RULE_SETS.items())
    return RuleSuite(Id(3, 1), sets, (priority_function(), missing_function()))

"""ruleframe: row-level data-quality rules as plain Spark columns.

A rule is a named, versioned boolean SQL expression over the fields of a
record.  Rules are grouped into sets and suites that share SQL functions.
A suite compiles to ordinary Catalyst expressions (no Python on the hot
path), evaluated against a record bound from separate columns, a struct
column or a JSON string column.
"""

from ruleframe.model import FunctionDef, Id, Rule, RuleSet, RuleSuite
from ruleframe.sources.bindings import Binding, bind_fields, bind_json, bind_struct
from ruleframe.operators.runner import audit, audit_compat, rule_vector, run_rules

__all__ = [
    "Binding",
    "FunctionDef",
    "Id",
    "Rule",
    "RuleSet",
    "RuleSuite",
    "audit",
    "audit_compat",
    "bind_fields",
    "bind_json",
    "bind_struct",
    "rule_vector",
    "run_rules",
]

"""SQL function registration and Column builders for rule bodies."""

from ruleframe.functions.sql import register_functions
from ruleframe.functions.columns import applicable_for, case_lookup, group_members, is_missing

__all__ = ["applicable_for", "case_lookup", "group_members", "is_missing", "register_functions"]

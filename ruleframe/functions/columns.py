"""Column builders equivalent to the suite functions, for DataFrame users."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleframe.suites import BLANK_PATTERN, GROUPS


def case_lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """Small constant lookup as a CASE chain (constant-folds, stays in codegen)."""
    out = None
    for k, v in mapping.items():
        out = (F.when(key == F.lit(k), F.lit(v)) if out is None
               else out.when(key == F.lit(k), F.lit(v)))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def group_members(group: Column, unknown_empty: bool = True) -> Column:
    """Group name -> array of member locations (empty or NULL when unknown)."""
    out = None
    for g, ms in GROUPS.items():
        arr = F.array(*[F.lit(m) for m in ms])
        out = F.when(group == F.lit(g), arr) if out is None else out.when(group == F.lit(g), arr)
    if unknown_empty:
        return out.otherwise(F.array().cast("array<string>"))
    return out


def applicable_for(group: str | Column, location: Column, unknown_empty: bool = True) -> Column:
    g = F.lit(group) if isinstance(group, str) else group
    return F.array_contains(group_members(g, unknown_empty), location)


def is_missing(value: Column) -> Column:
    """True when null, empty or whitespace only; the value is compared as text."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit(True)).otherwise(s.rlike(BLANK_PATTERN))

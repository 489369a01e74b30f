"""Register a suite's functions as session-scoped SQL functions."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import SparkSession

from ruleframe.model import FunctionDef, library_order, scoped


def register_functions(spark: SparkSession, functions: Iterable[FunctionDef]) -> None:
    """Issue ``CREATE OR REPLACE TEMPORARY FUNCTION`` for each definition, under its own name.

    For callers who write the names in SQL of their own: a function of the
    session with that name is replaced.  A catalog operation on the driver
    (no job).  Temporary functions live in the session; re-registering the
    same definition is harmless.
    """
    for f in library_order(functions):
        spark.sql(f.create_sql())


def register_scoped(spark: SparkSession, functions: Iterable[FunctionDef]) -> dict[str, str]:
    """Registers a suite's functions under session names of their own; plain name (lower case) -> session name.

    Nothing that the user or another suite registered is replaced.
    """
    moved, names = scoped(functions)
    for f in moved:
        spark.sql(f.create_sql())
    return names

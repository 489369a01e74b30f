"""Read a DataFrame's plan the way a user does: through ``explain``."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_in_plan(df: DataFrame, needle: str, mode: str = "formatted") -> int:
    return plan_text(df, mode).count(needle)

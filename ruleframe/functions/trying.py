"""NULL instead of an error, for any expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HASHED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def row_guard(df: DataFrame) -> Column | None:
    """A condition that holds for every row, but that the optimizer can't know of; None if no column serves.

    Its column is the narrowest there is: the condition reads it.
    """
    kinds = [(i, f.name) for f in df.schema.fields for i, t in enumerate(_HASHED) if isinstance(f.dataType, t)]
    return guard(F.col(f"`{min(kinds)[1].replace('`', '``')}`")) if kinds else None


def guard(value: Column) -> Column:
    return F.xxhash64(value) <= F.lit(2**63 - 1)


def null_on_error(value: Column, holds: Column | None) -> Column:
    """``value``, or NULL where evaluating it fails: any cast, division, index, overflow or ``raise_error``.

    Spark evaluates the part inside a try.  ``holds`` (see :func:`row_guard`)
    keeps it in a conditional branch: what is evaluated on every row may be
    shared between expressions and computed before the try begins.
    """
    session = SparkSession.active()
    utils = session._jvm.org.apache.spark.sql.classic.ExpressionUtils
    tried = session._jvm.org.apache.spark.sql.catalyst.expressions.TryEval(utils.expression(value._jc))
    tried = Column(utils.column(tried))
    return tried if holds is None else F.when(holds, tried)

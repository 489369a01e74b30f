"""Hook for a rule that SQL cannot express: a vectorized (Arrow) pandas UDF.

Rules should be SQL; this is the slow path, for the rare predicate that
needs Python.  The function receives pandas Series batches (thousands of
rows per call), never single rows, and its result can be used in rule text
after registration (``spark.udf.register``) or as a Column.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf


def pandas_rule(fn: Callable[..., pd.Series], name: str | None = None,
                spark: SparkSession | None = None) -> Callable[..., Column]:
    """Wrap ``fn(*series) -> boolean Series`` as a pandas UDF; register as ``name`` if given."""
    udf = pandas_udf(fn, "boolean")
    if name and spark is not None:
        spark.udf.register(name, udf)
    return udf

"""Join of a large frame with a small side whose row count is known on the driver."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side of at most this many bytes (as text) is broadcast.
BROADCAST_BYTES = 32 << 20


def text_bytes(small: DataFrame) -> int:
    """Size of a frame as text: one aggregation over it, partial in each task."""
    return small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on: Sequence[tuple[str, str]], small_bytes: int | None = None,
               how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join ``big`` to ``small`` on (big column, small column) pairs.

    ``small`` is broadcast if it holds at most ``limit`` bytes: ``small_bytes``
    where the caller knows them (built from driver-side rows), else measured.
    A larger one is joined by shuffle, its hot keys split at run time by the
    adaptive skew join.  ``how`` is "inner" or "left" (``big`` kept).
    """
    if (text_bytes(small) if small_bytes is None else small_bytes) <= limit:
        small = F.broadcast(small)
    return big.join(small, [big[b] == small[s] for b, s in on], how)

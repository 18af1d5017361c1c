"""Joins with tables whose size is looked at before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast.
BROADCAST_ROWS = 20_000


def join_dimension(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a table that is small as a rule: counted first, broadcast up to the limit, shuffled beyond it."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)

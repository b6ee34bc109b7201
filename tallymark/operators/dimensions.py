"""Lookup tables of a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes (as text) up to which a lookup table is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def dimension(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, marked for broadcast if it has at most ``rows`` rows of together at most ``size`` bytes; a larger one is
    joined by shuffle."""
    length = F.octet_length(F.to_json(F.struct("*")))
    n, total = table.limit(rows + 1).agg(F.count("*"), F.sum(length)).first()
    return F.broadcast(table) if n <= rows and (total or 0) <= size else table

"""Size checks that guard every explicit broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast side must stay below this many rows; above it the join falls back to a shuffle
# join. MAX_BROADCAST_BYTES bounds data shipped to executors by other means (KNN query blocks).
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def maybe_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its size is proven small.

    ``known_rows`` is a bound the caller already holds (e.g. a fixed dictionary). Otherwise the
    frame is counted with a capped scan (``limit(max_rows + 1)``), which stops early on a big
    input; above the bound the frame is returned as is and the join stays a shuffle join.
    """
    if known_rows is None:
        known_rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if known_rows <= max_rows else df

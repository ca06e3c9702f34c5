"""Size-checked dimension joins and small-table helpers.

A side is broadcast only after it was seen to be small: its rows are fetched up to a bound and
their bytes measured. Beyond either bound the join is an ordinary shuffle join, which AQE may still
turn into a broadcast or split for skew at run time. Nothing is cached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension tables up to this many rows and Arrow bytes are broadcast to every task.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


class TooLarge(ValueError):
    """A model that must fit on the driver (a head matrix) exceeded its bound."""


def small_copy(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame | None:
    """The table as a local relation if it is within the bounds, else None. One job; at most
    ``max_rows + 1`` rows come to the driver, and the table is not computed again."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return None
    return df.sparkSession.createDataFrame(rows.to_pylist(), df.schema) if rows.num_rows else df.sparkSession.createDataFrame([], df.schema)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str = "inner",
    null_safe: bool = False,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Join a dimension-like table on key columns: broadcast when its measured size is within the
    bounds, else a shuffle join with the same result. ``null_safe``: null keys match null keys."""
    local = small_copy(small, max_rows, max_bytes)
    side = small if local is None else F.broadcast(local)
    if not null_safe:
        return big.join(side, on, how)
    keys = [on] if isinstance(on, str) else list(on)
    renamed = side.select(*[F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in small.columns])
    if local is not None:
        renamed = F.broadcast(renamed)
    match: Column = F.lit(True)
    for k in keys:
        match = match & big[k].eqNullSafe(renamed[f"__k_{k}"])
    return big.join(renamed, match, how).drop(*[f"__k_{k}" for k in keys])


class _Held:
    """Stand-in for a broadcast variable when no SparkContext is reachable."""

    def __init__(self, value):
        self.value = value

    def unpersist(self):
        return None


def share(spark, value):
    """Ship a small driver-side value (weights, heads) to tasks: a broadcast variable when
    the SparkContext is reachable, else the value travels with the task closure."""
    try:
        return spark.sparkContext.broadcast(value)
    except Exception:  # noqa: BLE001
        return _Held(value)


def collect_small(df: DataFrame, max_rows: int, what: str = "table") -> list:
    """Rows of a table whose size is bounded by construction.

    At most ``max_rows + 1`` rows ever reach the driver; one more than the bound raises.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLarge(f"{what} has more than {max_rows} rows")
    return rows

"""Numbering rows in a global order by sample sort.

``row_number() over (order by O)`` sends all rows to one task. Here Spark samples the rows and deals
them out by ranges of the whole order key, the tie-breaking column included, so a value that a third
of all rows share is split like any other. Every range is sorted and counted by its own task; the
rows before a range are a running sum over one row per range. The order key may be of any ordered
type. The dealt rows are written once, so counting and numbering see the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import stored

# Rows that one task sorts, about; the number of ranges is sized from it.
ROWS_PER_RANGE = 1_000_000
# monotonically_increasing_id: the partition above these bits, the row's place in it below.
_PLACE_BITS = 33


def _last(c: Column | str) -> Column:
    """Ascending order with nulls last."""
    return F.asc_nulls_last(c) if isinstance(c, str) else c.asc_nulls_last()


def sample_sort(df: DataFrame, order_cols: Sequence[Column | str], ranges: int) -> DataFrame:
    """The rows with ``__range`` (rising along the order) and ``__place`` (from 0, in the order, within
    the range), stored."""
    order = [_last(c) for c in order_cols]
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    return placed.select(*df.columns, F.shiftright("__at", _PLACE_BITS).alias("__range"), F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("__place"))


def global_row_number(df: DataFrame, order_cols: Sequence[Column | str], out: str = "rn",
                      rows_per_range: int = ROWS_PER_RANGE, ranges: int | None = None) -> tuple[DataFrame, int]:
    """Add ``out`` = 1-based row number in the order of ``order_cols``, nulls last, and return the
    number of rows too. The last order column should be a unique key: rows that are equal in all of
    them cannot be split and are numbered in any order.

    The input is stored, so project it to the narrow columns that are needed."""
    src = stored(df, "rows")
    n = src.count()
    ranges = max(1, -(-n // rows_per_range)) if ranges is None else ranges
    if ranges == 1:
        one = src.coalesce(1).sortWithinPartitions(*[_last(c) for c in order_cols])
        return one.withColumn(out, F.monotonically_increasing_id() + 1), n
    placed = sample_sort(src, order_cols, ranges)
    # one row per range
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    numbered = placed.join(offsets, "__range").withColumn(out, F.col("__off") + F.col("__place") + 1)
    return numbered.drop("__range", "__place", "__off"), n

"""Array-column expressions for row-local ranking, metrics and scoring.

Candidates of one item live in one array, so ranking, top-k, MAP, loss and dot products
are row-local higher-order functions: no shuffle, no window, usable on streams.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sort_key(v: Column) -> Column:
    """Ascending sort key for a descending score: -score, with null and NaN last (+inf)."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.nanvl(-v.cast("double"), inf), inf)


def rank_desc(scores: Column | str, ties: str = "low") -> Column:
    """WN-5 (array form): candidate indices ordered by score, best first, over the whole list
    whatever its length.

    ``ties="low"`` puts the lower index first on equal scores (D-4, stable descending
    sort); ``ties="high"`` puts the higher index first (D-5, Borda). Null and NaN scores
    rank last (D-7), in index order (a score of -inf ties with them). A null list stays null.
    """
    sign = 1 if ties == "low" else -1

    def keyed(v: Column, i: Column) -> Column:
        return F.struct(_sort_key(v).alias("key"), (i * sign).alias("idx"))

    return F.transform(F.sort_array(F.transform(_col(scores), keyed)), lambda s: s["idx"] * sign)


def ranks_text(ranks: Column | str, sep: str = " ") -> Column:
    """A ranking as text, e.g. ``"2 0 1"``."""
    return F.array_join(_col(ranks).cast("array<string>"), sep)


def top_k(ranks: Column | str, k: int) -> Column:
    """SL-3: the first k entries of a ranking."""
    return F.slice(_col(ranks), 1, k)


def top1(ranks: Column | str) -> Column:
    """SL-4: the best candidate; null for an empty ranking."""
    return F.get(_col(ranks), 0)


def lcm_upto(k: int) -> int:
    return reduce(lambda a, b: a * b // math.gcd(a, b), range(1, k + 1), 1)


def hit_position(ranks: Column | str, y: Column | str, k: int) -> Column:
    """AG-15: 1-based position of the truth within the first k entries; 0 if absent or missing."""
    return F.coalesce(F.array_position(top_k(ranks, k), _col(y).cast("int")), F.lit(0)).cast("int")


# lcm(1..k) times this many items still fits a long
LONG_SCALE_MAX_K = 20


def ap_scaled(ranks: Column | str, y: Column | str, k: int) -> Column:
    """AG-15: average precision at k times lcm(1..k), as an exact integer (k up to 20).

    1/position of the first hit within the first k entries, else 0; a missing truth is 0.
    """
    if k > LONG_SCALE_MAX_K:
        raise ValueError(f"lcm(1..{k}) does not fit; use hit_position and map_at_k")
    pos = hit_position(ranks, y, k)
    return F.when(pos > 0, F.expr(f"{lcm_upto(k)}L") / pos).otherwise(F.lit(0)).cast("long")


def borda_points(ranks: Column | str) -> Column:
    """AG-20: points per candidate index for one ranking: K - position (0-based), K being the
    ranking's own length. The ranking must be a permutation of 0..K-1 (D-16); any other one
    raises when the row is evaluated."""
    ranks = _col(ranks)
    size = F.size(ranks)
    pairs = F.transform(ranks, lambda c, p: F.struct(c.alias("cand"), (size - p).cast("long").alias("pts")))
    # K different entries from 0 to K-1
    whole = (size == 0) | ((F.size(F.array_distinct(ranks)) == size) & (F.array_min(ranks) == 0) & (F.array_max(ranks) == size - 1))
    whole = whole & ~F.exists(ranks, F.isnull)
    checked = F.when(F.coalesce(whole, F.lit(False)), pairs).otherwise(
        F.raise_error(F.concat(F.lit("not a permutation of 0..K-1: "), F.coalesce(F.to_json(ranks), F.lit("null"))))
    )
    return F.transform(F.array_sort(checked), lambda s: s["pts"])


def add_arrays(arrays: Column | str) -> Column:
    """Element-wise sum of an array of equal-length numeric arrays (a short, bounded list).
    Arrays of different lengths raise when the row is evaluated."""
    arrays = _col(arrays)
    sizes = F.transform(arrays, F.size)
    even = F.array_min(sizes) == F.array_max(sizes)
    first = F.when(even, F.get(arrays, 0)).otherwise(
        F.raise_error(F.concat(F.lit("runs differ in their number of candidates: "), F.to_json(sizes)))
    )
    return F.aggregate(
        F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))),
        first,
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )


def softmax_xent(logits: Column | str, y: Column | str) -> Column:
    """AG-22: softmax cross-entropy over the whole candidate list, numerically stable."""
    x = F.transform(_col(logits), lambda v: v.cast("double"))
    m = F.array_max(x)
    total = F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, b: a + b)
    return m + F.log(total) - F.get(x, _col(y).cast("int"))


def dot(a: Column | str, b: Column | str, zero: Column | None = None) -> Column:
    """ML-1: dot product of two equal-length numeric arrays."""
    zero = F.lit(0.0) if zero is None else zero
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), zero, lambda s, v: s + v)


def max_abs(vec: Column | str) -> Column:
    """Largest absolute value of a numeric array, as double."""
    return F.array_max(F.transform(_col(vec), lambda v: F.abs(v.cast("double"))))


def quantize(vec: Column | str, levels: int = 127, scale: Column | str | None = None) -> Column:
    """ML-2: per-vector absmax quantisation: floor(v * levels / max|v| + 0.5) as bigint.

    Pass ``scale`` (a column holding ``max_abs(vec)``) to compute the maximum once per row;
    higher-order functions are interpreted, so the maximum must not sit inside the lambda.
    """
    m = max_abs(vec) if scale is None else _col(scale)
    return F.transform(
        _col(vec),
        lambda v: F.when(m == 0, F.lit(0).cast("long")).otherwise(
            F.floor(v.cast("double") * levels / m + F.lit(0.5)).cast("long")
        ),
    )

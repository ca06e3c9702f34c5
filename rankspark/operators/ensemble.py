"""SO-1, JN-6, AG-20, AG-21: combine several runs of rankings or scores per item."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.arrays import add_arrays, borda_points, rank_desc


def union_runs(runs: Sequence[DataFrame], run_col: str = "run_id") -> DataFrame:
    """SO-1: stack run tables by column name, tagging each with its position."""
    tagged = [
        r if run_col in r.columns else r.withColumn(run_col, F.lit(i).cast("long"))
        for i, r in enumerate(runs)
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def align_runs(runs: DataFrame, n_runs: int, item_col: str = "item_id", run_col: str = "run_id") -> DataFrame:
    """JN-6: items present in all ``n_runs`` runs (the reference silently truncates)."""
    return (
        runs.groupBy(item_col)
        .agg(F.countDistinct(run_col).alias("n_runs"))
        .where(F.col("n_runs") == n_runs)
    )


def check_rankings(runs: DataFrame, k: int, ranks_col: str = "ranks") -> int:
    """D-16: rows whose ranking is not a permutation of 0..k-1 (count; one job)."""
    r = F.col(ranks_col)
    ok = (F.size(r) == k) & (F.size(F.array_distinct(r)) == k) & (F.array_min(r) >= 0) & (F.array_max(r) < k)
    return runs.where(~F.coalesce(ok, F.lit(False))).count()


def borda(runs: DataFrame, item_col: str = "item_id", ranks_col: str = "ranks", out: str = "ranks",
          keep: Sequence[str] = ()) -> DataFrame:
    """AG-20: Borda count over runs; ties to the higher candidate index (D-5).

    ``keep`` columns are per-item constants (e.g. the truth) carried through. A ranking that is
    not a permutation of 0..K-1, or an item whose runs differ in K, raises (D-16); items may
    differ in K among each other.

    One shuffle on the item key: points per ranking are computed before it, and the per-run
    point arrays of an item (one per run, a bounded group) are added element-wise.
    """
    pts = runs.select(item_col, *keep, borda_points(ranks_col).alias("__pts"))
    return (
        pts.groupBy(item_col)
        .agg(add_arrays(F.collect_list("__pts")).alias("__borda"), *[F.first(c).alias(c) for c in keep])
        .select(item_col, *keep, rank_desc("__borda", ties="high").alias(out))
    )


def mean_logit(scores: DataFrame, item_col: str = "item_id", logits_col: str = "logits", out: str = "ranks") -> DataFrame:
    """AG-21: average logits over runs, then rank (ties to the lower index). Items whose runs
    differ in their number of candidates raise."""
    arr = scores.select(item_col, F.transform(logits_col, lambda x: x.cast("double")).alias("__l"))
    return (
        arr.groupBy(item_col)
        .agg(add_arrays(F.collect_list("__l")).alias("__sum"), F.count(F.lit(1)).alias("__n"))
        .select(
            item_col,
            rank_desc(F.transform("__sum", lambda x: x / F.col("__n")), ties="low").alias(out),
        )
    )

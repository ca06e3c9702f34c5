"""JN-5, AG-15..17, AG-22..24: evaluation of rankings and scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.arrays import LONG_SCALE_MAX_K, hit_position, lcm_upto, softmax_xent


def align_truth(truth: DataFrame, preds: DataFrame, key: str = "item_id") -> DataFrame:
    """JN-5 report: matched keys and keys present on one side only (one row).

    The reference zips by line order and silently drops the longer tail (D-1); here the
    sides are matched by key and the unmatched counts are reported. One shuffle of keys.
    """
    t = truth.select(key, F.lit(1).alias("__t")).distinct()
    p = preds.select(key, F.lit(1).alias("__p")).distinct()
    j = t.join(p, key, "full")
    return j.agg(
        F.count(F.when(F.col("__t").isNotNull() & F.col("__p").isNotNull(), 1)).alias("n_matched"),
        F.count(F.when(F.col("__p").isNull(), 1)).alias("n_truth_only"),
        F.count(F.when(F.col("__t").isNull(), 1)).alias("n_pred_only"),
    )


def join_truth(truth: DataFrame, preds: DataFrame, key: str = "item_id") -> DataFrame:
    """JN-5: predictions with their truth, matched on the key (inner)."""
    return preds.join(truth, key, "inner")


def map_at_k(preds: DataFrame, k: int = 3, ranks_col: str = "ranks", y_col: str = "y_true",
             by: Sequence[str] = ()) -> DataFrame:
    """AG-15: MAP@k per group, for any k: ``n_items``, ``ap_sum`` (AP x lcm(1..k), exact; a long
    up to k = 20, else a decimal, null where even that is too small) and ``map``.

    Hits are counted per position, so a group holding a third of the rows is no hot spot and no
    scaled value is summed over rows. Zero items give MAP 0 (D-13).
    """
    by = list(by)
    hits = preds.select(*by, hit_position(ranks_col, y_col, k).alias("__p")).groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    scale = lcm_upto(k)
    digits = len(str(scale))
    if digits <= 19:
        part = F.when(F.col("__p") > 0, F.col("__n").cast("decimal(19,0)") * (F.lit(scale).cast("decimal(19,0)") / F.col("__p")).cast("decimal(19,0)"))
        total = F.sum(part).cast("decimal(38,0)")
    else:
        per_hit = F.create_map(*[x for p in range(1, k + 1) for x in (F.lit(p), F.lit(str(scale // p)))])
        part = F.when(F.col("__p") > 0, F.element_at(per_hit, F.col("__p")).try_cast(f"decimal({min(38, digits)},0)") * F.col("__n"))
        total = F.try_sum(part).try_cast("decimal(38,0)")
    total = F.when(F.max("__p") > 0, total).otherwise(F.lit(0).cast("decimal(38,0)"))
    agg = hits.groupBy(*by).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_items"),
        F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("ap_sum") if k <= LONG_SCALE_MAX_K else total.alias("ap_sum"),
        F.coalesce(F.sum(F.when(F.col("__p") > 0, F.col("__n") / F.col("__p"))), F.lit(0.0)).alias("__ap"),
    )
    agg = agg.withColumn("map", F.when(F.col("n_items") == 0, F.lit(0.0)).otherwise(F.col("__ap") / F.col("n_items"))).drop("__ap")
    return agg.withColumn("ap_sum", F.col("ap_sum").cast("long")) if k <= LONG_SCALE_MAX_K else agg


# Labels up to which the dense K x K grid is filled with zeros.
DENSE_MAX_LABELS = 1000


def confusion(preds: DataFrame, n_labels: int, y_col: str = "y_true", pred_col: str = "pred_idx",
              by: Sequence[str] = ()) -> DataFrame:
    """AG-16: counts of (true, predicted), with every cell of the K x K grid present up to
    ``DENSE_MAX_LABELS`` labels; beyond that only the cells that occur, as the grid would outgrow
    the data (``n_labels`` squared rows a group).

    Indices outside 0..K-1 are not counted (the reference would wrap negatives, D-18);
    ``confusion_errors`` counts them.
    """
    by = list(by)
    # no filter here: cells outside the grid simply find no partner in the left join
    counts = preds.groupBy(*by, F.col(y_col).cast("long").alias("true_idx"),
                           F.col(pred_col).cast("long").alias("pred_idx")).agg(F.count(F.lit(1)).alias("n"))
    if n_labels > DENSE_MAX_LABELS:
        return counts.where(F.col("true_idx").between(0, n_labels - 1) & F.col("pred_idx").between(0, n_labels - 1))
    axis = F.sequence(F.lit(0).cast("long"), F.lit(n_labels - 1).cast("long"))
    if by:
        # every group with any row has a count row: take groups from the small count table
        groups = counts.select(*by).distinct()
    else:
        groups = preds.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(axis).alias("true_idx")).select(
        *by, "true_idx", F.explode(axis).alias("pred_idx")
    )
    # null-safe keys: no inferred isnotnull filter is pushed into (and recomputes) the ranking
    keys = by + ["true_idx", "pred_idx"]
    c = counts.select(*[F.col(x).alias(f"__c_{x}") for x in keys], "n")
    cond = [grid[x].eqNullSafe(c[f"__c_{x}"]) for x in keys]
    return grid.join(c, cond, "left").select(
        *by, "true_idx", "pred_idx", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )


def confusion_errors(preds: DataFrame, n_labels: int, y_col: str = "y_true", pred_col: str = "pred_idx") -> DataFrame:
    """Rows whose true or predicted index is outside the label range (one row)."""
    bad = ~(F.col(y_col).between(0, n_labels - 1) & F.col(pred_col).between(0, n_labels - 1))
    return preds.agg(F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias("n_errors"))


def confusion_normalized(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AG-17: each row of the matrix divided by its sum; an empty row stays 0."""
    w = Window.partitionBy(*by, "true_idx")
    total = F.sum("n").over(w)
    return cm.withColumn("rate", F.col("n") / F.when(total == 0, F.lit(1)).otherwise(total))


def candidate_loss(scores: DataFrame, logits_col: str = "logits", y_col: str = "y_true",
                   by: Sequence[str] = ()) -> DataFrame:
    """AG-22: mean softmax cross-entropy over each item's whole candidate list, per group.
    ``n_items`` counts the items in the mean; one without scores or truth has no loss."""
    loss = scores.select(*by, softmax_xent(logits_col, y_col).alias("__loss"))
    return loss.groupBy(*by).agg(F.avg("__loss").alias("loss"), F.count("__loss").alias("n_items"))


def leaderboard(per_fold: DataFrame, model_col: str = "model", loss_col: str = "loss",
                map_col: str = "map") -> DataFrame:
    """AG-23: mean, sample std and count over seeds/folds per model, best first."""
    return (
        per_fold.groupBy(model_col)
        .agg(
            F.avg(loss_col).alias("mean_loss"),
            F.stddev_samp(loss_col).alias("std_loss"),
            F.avg(map_col).alias("mean_map"),
            F.stddev_samp(map_col).alias("std_map"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy(F.col("mean_loss"), F.col("mean_map").desc())
    )


def hardest_fold(per_fold: DataFrame, fold_col: str = "fold", loss_col: str = "loss") -> DataFrame:
    """AG-24: the fold with the largest loss (one row); of equal ones the smallest."""
    return per_fold.agg(
        F.max_by(F.col(fold_col), F.struct(F.col(loss_col), -F.col(fold_col))).alias(fold_col), F.max(loss_col).alias(loss_col)
    )


@dataclass
class Report:
    alignment: DataFrame            # n_matched, n_truth_only, n_pred_only
    map: DataFrame                  # n_items, ap_sum, map
    confusion: DataFrame            # true_idx, pred_idx, n (+ true/pred label names)
    confusion_normalized: DataFrame
    errors: DataFrame               # indices outside the label range


def evaluate(truth: DataFrame, preds: DataFrame, vocab: DataFrame, k: int = 3, key: str = "row_id",
             y_col: str = "label_idx", ranks_col: str = "ranks") -> Report:
    """E2(c): truth and rankings matched by key -> MAP@k, top-1 confusion, label names."""
    from rankspark.operators.prepare import decode_labels
    from rankspark.operators.ranking import top_1_prediction

    n_labels = vocab.count()
    joined = join_truth(truth.select(key, F.col(y_col).alias("y_true")), preds.select(key, ranks_col), key)
    top = top_1_prediction(joined, ranks_col)
    cm = confusion(top, n_labels)
    named = decode_labels(decode_labels(cm, vocab, "true_idx", "true_label"), vocab, "pred_idx", "pred_label")
    return Report(
        alignment=align_truth(truth, preds, key),
        map=map_at_k(joined, k, ranks_col),
        confusion=named,
        confusion_normalized=confusion_normalized(cm),
        errors=confusion_errors(top, n_labels),
    )

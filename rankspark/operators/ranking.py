"""WN-5, SL-3, SL-4, PF-11: rank candidates, top-k, top-1, submission strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.arrays import rank_desc, top1, top_k
from rankspark.functions.arrays import ranks_text as _ranks_text
from rankspark.operators.prepare import decode_labels


def rank_candidates(scores: DataFrame, logits_col: str = "logits", out: str = "ranks") -> DataFrame:
    """WN-5, array form: row-local, no shuffle; works on streams as well. Lists may differ in
    length from row to row; every candidate of a list is ranked."""
    return scores.withColumn(out, rank_desc(logits_col, ties="low"))


def rank_array(scores_col: str = "logits"):
    """WN-5 as a column: candidate indices best first (stable, ties to the lower index)."""
    return rank_desc(scores_col, ties="low")


def rank_long(scores: DataFrame, item_cols: Sequence[str], cand_col: str = "cand_idx",
              score_col: str = "logit", out: str = "rnk") -> DataFrame:
    """WN-5, long form: ``row_number`` per item ordered by score desc, index asc.

    NaN and null rank last (D-7). The window is keyed by item, whose group is one item's
    candidate set (bounded), so it never gathers a large group.
    """
    s = F.col(score_col).cast("double")
    bad = (s.isNull() | F.isnan(s)).cast("int")
    w = Window.partitionBy(*item_cols).orderBy(bad, s.desc(), F.col(cand_col))
    return scores.withColumn(out, F.row_number().over(w))


def ranks_to_long(df: DataFrame, ranks_col: str = "ranks", keep: Sequence[str] = ()) -> DataFrame:
    """One row per ranked entry: ``rnk`` (1-based) and ``cand_idx``."""
    return df.select(*keep, F.posexplode(ranks_col).alias("pos", "cand_idx")).select(
        *keep, (F.col("pos") + 1).alias("rnk"), F.col("cand_idx").cast("long").alias("cand_idx")
    )


def top_k_ranks(df: DataFrame, k: int, ranks_col: str = "ranks", out: str = "top") -> DataFrame:
    """SL-3: the first k entries of every ranking (row-local)."""
    return df.withColumn(out, top_k(ranks_col, k))


def top_1_prediction(df: DataFrame, ranks_col: str = "ranks", out: str = "pred_idx") -> DataFrame:
    """SL-4: the top-1 candidate (row-local)."""
    return df.withColumn(out, top1(ranks_col).cast("long"))


def ranks_text(ranks_col: str = "ranks", sep: str = " "):
    """A ranking as text, e.g. ``"2 0 1"`` (JSONL-free exchange format)."""
    return _ranks_text(ranks_col, sep)


def submission(ranked: DataFrame, vocab: DataFrame, key: str = "row_id", ranks_col: str = "ranks",
               k: int = 3, out: str = "prediction") -> DataFrame:
    """PF-11 + JN-2: top-k label names joined by a space, one row per key.

    The k entries are decoded by a join with the vocabulary and put back in order. An empty or
    null ranking gives an empty prediction; an index outside the vocabulary is left out. A label
    with a space would be read as two and raises (D-17).
    """
    entries = ranked.select(key, F.posexplode_outer(top_k(ranks_col, k)).alias("pos", "__idx")).withColumn(
        "__idx", F.col("__idx").cast("long")
    )
    named = decode_labels(entries, vocab, "__idx", "__label")
    label = F.when(F.contains("__label", F.lit(" ")), F.raise_error(F.concat(F.lit("label contains a space: "), F.col("__label")))).otherwise(F.col("__label"))
    names = F.array_sort(F.collect_list(F.when(F.col("__label").isNotNull(), F.struct("pos", label.alias("__label")))))
    return named.groupBy(key).agg(F.array_join(F.transform(names, lambda s: s["__label"]), " ").alias(out))

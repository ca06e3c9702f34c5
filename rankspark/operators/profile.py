"""E3 profile: counts, crosstabs, quantiles, box-plot statistics, histograms, deciles.

Every table is a partial+final aggregation (map-side combine) or a join of data with a
small per-group statistics table; no step gathers a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.text import ASSESSMENTS, answer_correct, assessment, has_misconception, word_count_arrow
from rankspark.operators.windows import ROWS_PER_RANGE, global_row_number
from rankspark.session import stored


def derive(df: DataFrame, text: str = "explanation", category: str = "category") -> DataFrame:
    """Derived profile columns: ``n_words``, ``ans_correct``, ``expl_assess``, ``has_misconception``."""
    return df.select(
        "*",
        word_count_arrow(text).alias("n_words"),
        answer_correct(category).alias("ans_correct"),
        assessment(category).alias("expl_assess"),
        has_misconception(category).alias("has_misconception"),
    )


def value_counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """AG-4 / AG-5: rows per non-null key (null keys dropped, D-3)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def top_values(df: DataFrame, key: str, n: int = 20, where=None, out: str = "n") -> DataFrame:
    """AG-6: the n most frequent keys; ties by key ascending (D-6)."""
    src = df if where is None else df.where(where)
    return value_counts(src, key, out).orderBy(F.col(out).desc(), F.col(key)).limit(n)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str] = ASSESSMENTS) -> DataFrame:
    """AG-7: counts of row x column with zeros filled; pivot values given (no extra job)."""
    src = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return src.groupBy(row).pivot(col, list(values)).count().na.fill(0, list(values))


def crosstab_normalized(ct: DataFrame, row: str, values: Sequence[str] = ASSESSMENTS) -> DataFrame:
    """AG-8: each crosstab row divided by its total."""
    total = sum((F.col(v) for v in values), F.lit(0))
    return ct.select(row, *[(F.col(v) / total).alias(v) for v in values])


def _quartiles(value: F.Column, exact: bool) -> F.Column:
    """Quartiles of a column: exact linear interpolation (``percentile``, whose buffer is a
    value -> count map, bounded by the number of distinct values, e.g. word counts) or
    ``percentile_approx`` (fixed-size sketch) for continuous values in huge groups."""
    if exact:
        return F.percentile(value, [0.25, 0.5, 0.75])
    return F.percentile_approx(value, [0.25, 0.5, 0.75], 10000).cast("array<double>")


def describe_by(df: DataFrame, key: str, value: str, exact: bool = True) -> DataFrame:
    """AG-9: count, mean, sample std, min, quartiles (linear interpolation), max per key."""
    q = _quartiles(F.col(value), exact)
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.col(value)).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        q.alias("__q"),
        F.max(value).cast("double").alias("max"),
    )
    return stats.select(
        key, "count", "mean", "std", "min",
        F.get("__q", 0).alias("q25"), F.get("__q", 1).alias("q50"), F.get("__q", 2).alias("q75"), "max",
    )


def boxplot_by(df: DataFrame, key: str, value: str, whis: float = 1.5, exact: bool = True) -> DataFrame:
    """AG-10 / AG-11: box-plot statistics per key, fliers excluded from the whiskers.

    Rows are first counted per (key, value). Quartiles, means and whiskers come from those
    counts, so a key with a third of all rows brings its distinct values to the join, not its rows.
    """
    src = df.where(F.col(key).isNotNull()).select(key, F.col(value).cast("double").alias("__v"))
    hist = src.groupBy(key, "__v").agg(F.count(F.lit(1)).alias("__c"))
    stats = [F.sum("__c").alias("n"), (F.sum(F.col("__v") * F.col("__c")) / F.sum(F.when(F.col("__v").isNotNull(), F.col("__c")))).alias("mean")]
    if exact:
        q = hist.groupBy(key).agg(*stats, F.percentile("__v", [0.25, 0.5, 0.75], F.col("__c")).alias("__q"))
    else:
        approx = src.groupBy(key).agg(_quartiles(F.col("__v"), False).alias("__q"))
        q = hist.groupBy(key).agg(*stats).join(approx, key)
    q = q.select(key, "n", "mean", F.get("__q", 0).alias("q1"), F.get("__q", 1).alias("med"), F.get("__q", 2).alias("q3"))
    q = q.withColumn("__lo", F.col("q1") - whis * (F.col("q3") - F.col("q1"))).withColumn(
        "__hi", F.col("q3") + whis * (F.col("q3") - F.col("q1"))
    )
    w = hist.join(q.select(key, "__lo", "__hi"), key).groupBy(key).agg(
        F.min(F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))).alias("__wlo"),
        F.max(F.when(F.col("__v") <= F.col("__hi"), F.col("__v"))).alias("__whi"),
    )
    out = q.join(w, key)
    return out.select(
        key, "n", "mean", "q1", "med", "q3",
        F.least(F.coalesce("__wlo", "q1"), F.col("q1")).alias("whislo"),
        F.greatest(F.coalesce("__whi", "q3"), F.col("q3")).alias("whishi"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """AG-12 / AG-13: equal-width histogram over [min, max], last bin closed (D-9).

    One pass counts the values, and the counts are stored: range and bins come from them, so the
    input is read once and the value computed once a row. The range is a scalar subquery, empty bins
    are filled from the bin axis, and no values give no rows.
    """
    counted = df.groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counted = stored(counted, "counts").where("__v IS NOT NULL")
    ends = counted.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).where("lo IS NOT NULL")
    pad = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.select((F.col("lo") - pad).alias("lo0"), (F.col("hi") + pad).alias("hi0"))
    lo, hi = ends.select("lo0").scalar(), ends.select("hi0").scalar()
    b = F.least(F.floor((F.col("__v") - lo) * bins / (hi - lo)), F.lit(bins - 1))
    counts = counted.groupBy(b.cast("long").alias("bin")).agg(F.sum("__c").alias("n"))
    axis = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    width = F.col("hi0") - F.col("lo0")
    edges = axis.select("bin", (F.col("lo0") + F.col("bin") * width / bins).alias("lo"), (F.col("lo0") + (F.col("bin") + 1) * width / bins).alias("hi"))
    return edges.join(counts, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def rank_first(df: DataFrame, value: str, order_col: str = "row_id", out: str = "rnk",
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """WN-2: rank by value, ties by ``order_col`` (pandas ``rank(method="first")``). Rows without
    a value are ranked after all others, so every row has a rank.

    A sample sort on (value, order_col), both of any ordered type: a value shared by a third of the
    rows is spread over as many ranges as its rows need. The input is stored; project it first.
    """
    return global_row_number(df, [value, order_col], out, rows_per_range)[0]


def decile(rank_col: str, n: int) -> F.Column:
    """WN-3: equal-frequency decile (0-based) of a 1..n rank, as ``qcut(rank, 10)`` labels.

    Bin j holds ranks r with e_j < r <= e_{j+1}, e_j = 1 + j (n-1)/10; integer form
    ``ceil(10 (r-1) / (n-1)) - 1`` clamped at 0. n = 1 gives decile 0.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    ceil_bin = F.expr(f"(10 * (CAST(`{rank_col}` AS BIGINT) - 1) + {n - 2}) div {n - 1}")
    return F.greatest(ceil_bin - 1, F.lit(0)).cast("long")


def length_deciles(df: DataFrame, value: str = "n_words", order_col: str = "row_id",
                   rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """WN-2 + WN-3: ``rnk`` and ``decile`` per row (input stored; project it first)."""
    ranked, n = global_row_number(df, [value, order_col], "rnk", rows_per_range)
    return ranked.withColumn("decile", decile("rnk", n))


def rate_by_decile(df: DataFrame, flag: str = "has_misconception", value: str = "n_words",
                   order_col: str = "row_id") -> DataFrame:
    """AG-14: mean of a flag per length decile."""
    d = length_deciles(df.select(order_col, value, flag), value, order_col)
    return d.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("rate")
    )


def profile(df: DataFrame, question: str = "question_id", text: str = "explanation",
            category: str = "category", misconception: str = "misconception") -> dict[str, DataFrame]:
    """E3: every profile table of a response table, keyed by name (each its own job), from one
    stored narrow projection; the text is read once."""
    d = stored(derive(df, text, category).drop(text), "profile")
    ct = crosstab(d, "ans_correct", "expl_assess")
    narrow = d.select("row_id", "n_words", "has_misconception")
    return {
        "category_counts": value_counts(d, category),
        "responses_per_question": value_counts(d, question),
        "top_misconceptions": top_values(d, misconception, 20, where=F.col("has_misconception")),
        "crosstab": ct,
        "crosstab_normalized": crosstab_normalized(ct, "ans_correct"),
        "length_by_assessment": describe_by(d, "expl_assess", "n_words"),
        "boxplot_by_category": boxplot_by(d, category, "n_words"),
        "boxplot_by_assessment": boxplot_by(d, "expl_assess", "n_words"),
        "length_histogram": histogram(d, "n_words", 40),
        "responses_histogram": histogram(value_counts(d, question), "n", 30),
        "rate_by_decile": rate_by_decile(narrow),
    }

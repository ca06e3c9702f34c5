"""WN-4, PF-5, JN-8: stratified shuffled k-fold assignment and fold splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators.windows import global_row_number


def shuffle_key(key: str, seed: int) -> F.Column:
    """Seeded, engine-independent shuffle order: md5 of ``'<seed>:<key>'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int = 5, seed: int = 42,
                     out: str = "fold", ranges: int | None = None) -> DataFrame:
    """WN-4: stratified shuffled k-fold.

    Rows are ordered by (stratum, seeded hash); the fold is (global position - 1) mod k.
    Within a stratum consecutive rows go to consecutive folds, so per-stratum fold sizes
    differ by at most 1, and since each stratum starts where the previous one ended, the
    total fold sizes differ by at most 1 too. Rows without a stratum are a stratum of their
    own, ordered last; every row gets a fold.

    The position comes from a sample sort, so neither a stratum with a third of all rows nor one
    stratum per row meets in one task. ``ranges`` defaults to what the row count asks for.
    """
    src = df.withColumn("__h", shuffle_key(key, seed))
    ranked, _ = global_row_number(src, [stratum, "__h", key], "__g", ranges=ranges)
    return ranked.withColumn(out, ((F.col("__g") - 1) % k).cast("int")).drop("__h", "__g")


def attach_folds(df: DataFrame, folds: DataFrame, key: str, fold_col: str = "fold") -> DataFrame:
    """JN-8: fold (and any other fold-table column) per row by an equi join on the row key. Both
    sides have a row per data row, so it is a plain join."""
    return df.join(folds, key, "inner")


def fold_split(df: DataFrame, f: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """PF-5: (train, valid) = (fold is not f, fold is f); rows without a fold train. On a table
    written with ``partitionBy(fold)`` both filters become partition pruning."""
    return df.where(~F.col(fold_col).eqNullSafe(F.lit(f))), df.where(F.col(fold_col) == f)

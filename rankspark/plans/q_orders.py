"""Fold queries (WN-4, PF-5, JN-8) over ``orders``, stratified by status:priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import folds
from rankspark.plans import oracle as O
from rankspark.plans.catalog import register
from rankspark.sources import fixtures as fx
from rankspark.sources.tables import read_table

K = 5
SEED = 42

FOLDS_CTE = f"""WITH strat AS (
  SELECT o_orderkey, concat(o_orderstatus, ':', o_orderpriority) AS stratum FROM orders),
folds AS (
  SELECT o_orderkey, stratum, CAST((row_number() OVER (
      ORDER BY stratum, md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % {K} AS INTEGER) AS fold
  FROM strat)
"""


R_FOLDS = O.with_ctes(O.RESPONSES) + f""", f AS (
  SELECT row_id, category, CAST((row_number() OVER (
      ORDER BY category NULLS LAST, md5('{SEED}:' || CAST(row_id AS VARCHAR)), row_id) - 1) % {K} AS INTEGER) AS fold
  FROM responses)
"""


def _folds(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.concat("o_orderstatus", F.lit(":"), "o_orderpriority").alias("stratum")
    )
    return folds.stratified_folds(o, "o_orderkey", "stratum", K, SEED)


@register("stratified_folds", FOLDS_CTE + "SELECT o_orderkey, fold FROM folds", ("WN-4", "IO-6"))
def q_stratified_folds(spark, sf):
    return _folds(spark, sf).select("o_orderkey", "fold")


@register(
    "fold_sizes",
    FOLDS_CTE + "SELECT stratum, fold, count(*) AS n FROM folds GROUP BY stratum, fold",
    ("WN-4",),
)
def q_fold_sizes(spark, sf):
    return _folds(spark, sf).groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fold_split",
    FOLDS_CTE + """SELECT CASE WHEN f.fold = 0 THEN 'valid' ELSE 'train' END AS split, count(*) AS n_rows,
        count(DISTINCT f.stratum) AS n_strata, count(DISTINCT o.o_custkey) AS n_customers
      FROM orders o JOIN folds f USING (o_orderkey) GROUP BY 1""",
    ("PF-5", "JN-8"),
)
def q_fold_split(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    fl = _folds(spark, sf).select("o_orderkey", "stratum", "fold")
    joined = folds.attach_folds(orders, fl, "o_orderkey")
    # one grouped aggregate over both halves of the split
    return joined.groupBy(F.when(F.col("fold") == 0, F.lit("valid")).otherwise(F.lit("train")).alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("stratum").alias("n_strata"), F.countDistinct("o_custkey").alias("n_customers"),
    )


@register(
    "fold_documents",
    R_FOLDS + "SELECT row_id, category, fold FROM f",
    ("WN-4",),
)
def q_fold_documents(spark, sf):
    """Stratum ``category``, null for documents without a label: every document gets a fold."""
    r = fx.responses(spark, sf).select("row_id", "category")
    return folds.stratified_folds(r, "row_id", "category", K, SEED).select("row_id", "category", "fold")

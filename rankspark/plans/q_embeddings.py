"""Scoring queries over ``embeddings`` (ML-1, ML-2, ML-3, ML-5, minimum slice)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankspark.functions.arrays import ap_scaled, top1
from rankspark.operators import ensemble, metrics, ranking, score
from rankspark.operators.joins import share
from rankspark.plans.catalog import register
from rankspark.sources import fixtures as fx

N_RUNS = 3
LEVELS = 127

EMB = f"""WITH ex AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
qz AS (
  SELECT vec_id, label, d, CAST(floor(v * {LEVELS} / max(abs(v)) OVER (PARTITION BY vec_id) + 0.5) AS BIGINT) AS q FROM ex),
run_ids AS (SELECT CAST(r AS BIGINT) AS run_id FROM range({N_RUNS}) t(r)),
head AS (
  SELECT r.run_id, qz.label AS c, d, CAST(floor(CAST(sum(q) AS DOUBLE) / count(*)) AS BIGINT) AS w
  FROM qz CROSS JOIN run_ids r WHERE vec_id % {N_RUNS} <> r.run_id GROUP BY 1, 2, 3),
sc AS (
  SELECT run_id, vec_id AS item_id, CAST(label AS BIGINT) AS y_true, CAST(c AS BIGINT) AS cand_idx,
    CAST(sum(q * w) AS BIGINT) AS logit
  FROM qz JOIN head USING (d) GROUP BY 1, 2, 3, 4),
fhead AS (
  SELECT r.run_id, e.label AS c, d, avg(v) AS w
  FROM ex e CROSS JOIN run_ids r WHERE vec_id % {N_RUNS} <> r.run_id GROUP BY 1, 2, 3),
fsc AS (
  SELECT run_id, vec_id AS item_id, CAST(label AS BIGINT) AS y_true, CAST(c AS BIGINT) AS cand_idx, sum(v * w) AS logit
  FROM ex JOIN fhead USING (d) GROUP BY 1, 2, 3, 4),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, item_id ORDER BY logit DESC, cand_idx) AS rnk FROM sc),
franked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, item_id ORDER BY logit DESC, cand_idx) AS rnk FROM fsc)
"""
AP6 = "CASE rnk WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END"


def _items(spark, sf):
    return score.with_quantized(fx.embedding_items(spark, sf), "embedding", LEVELS)


def _int_heads(items):
    return score.centroid_heads(items, "q", n_runs=N_RUNS, integer=True)


def int8_scores(spark, sf, held_out_only: bool = False):
    """(scores, K): INT8 logits per (run, item) under leave-one-third-out centroid heads."""
    items = _items(spark, sf)
    return score.score_items_k(items, _int_heads(items), "q", integer=True,
                               held_out_only=held_out_only, n_runs=N_RUNS)


def float_scores(spark, sf):
    """(scores, K): float logits under float centroid heads (ML-1)."""
    items = fx.embedding_items(spark, sf)
    heads = score.centroid_heads(items, "embedding", n_runs=N_RUNS, integer=False)
    return score.score_items_k(items, heads, "embedding", integer=False)


def _ranked(scores_k):
    return ranking.rank_candidates(scores_k[0])


@register(
    "int8_borda_map",
    EMB + f""", k AS (SELECT count(DISTINCT cand_idx) AS k FROM sc),
      bp AS (SELECT item_id, any_value(y_true) AS y_true, cand_idx, sum(k.k - (rnk - 1)) AS pts
             FROM ranked CROSS JOIN k GROUP BY item_id, cand_idx),
      br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pts DESC, cand_idx DESC) AS rnk FROM bp)
      SELECT count(*) AS n_items, CAST(sum({AP6}) AS BIGINT) AS ap_sum,
        round(CAST(sum({AP6}) AS DOUBLE) / CAST(6 * count(*) AS DOUBLE), 6) AS map
      FROM br WHERE cand_idx = y_true""",
    ("ML-2", "WN-5", "AG-20", "AG-15"),
)
def q_int8_borda_map(spark, sf):
    """Minimum slice: INT8 -> 3 leave-one-third-out centroid heads -> rank -> Borda -> MAP@3."""
    b = ensemble.borda(_ranked(int8_scores(spark, sf)), keep=("y_true",))
    m = metrics.map_at_k(b, 3)
    return m.select("n_items", "ap_sum", F.round("map", 6).alias("map"))


@register(
    "int8_score",
    EMB + "SELECT run_id, item_id, y_true, cand_idx, logit FROM sc",
    ("ML-2",),
)
def q_int8_score(spark, sf):
    return score.to_long(int8_scores(spark, sf)[0])


@register(
    "linear_score",
    EMB + "SELECT run_id, item_id, y_true, cand_idx, round(logit, 6) AS logit FROM fsc",
    ("ML-1",),
)
def q_linear_score(spark, sf):
    return score.to_long(float_scores(spark, sf)[0]).withColumn("logit", F.round("logit", 6))


@register(
    "int8_agreement",
    EMB + f""", i1 AS (SELECT run_id, item_id, cand_idx AS p FROM ranked WHERE rnk = 1),
      f1 AS (SELECT run_id, item_id, cand_idx AS p FROM franked WHERE rnk = 1),
      ia AS (SELECT run_id, item_id, {AP6} AS ap FROM ranked WHERE cand_idx = y_true),
      fa AS (SELECT run_id, item_id, {AP6} AS ap FROM franked WHERE cand_idx = y_true)
      SELECT i1.run_id, count(*) AS n_items, count(*) FILTER (WHERE i1.p = f1.p) AS n_top_1_agree,
        CAST(sum(fa.ap) AS BIGINT) AS ap_sum_float, CAST(sum(ia.ap) AS BIGINT) AS ap_sum_int8
      FROM i1 JOIN f1 USING (run_id, item_id) JOIN ia USING (run_id, item_id) JOIN fa USING (run_id, item_id)
      GROUP BY i1.run_id""",
    ("ML-2",),
)
def q_int8_agreement(spark, sf):
    """Both score sets in one pass over the items: no join of scored rows."""
    items = _items(spark, sf)
    both = score.score_pair(items, score.centroid_heads(items, "embedding", n_runs=N_RUNS, integer=False), _int_heads(items))
    j = both.select("run_id", "y_true", ranking.rank_array("logits_int").alias("ri"), ranking.rank_array("logits").alias("rf"))
    return j.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(top1("ri") == top1("rf"), 1)).alias("n_top_1_agree"),
        F.sum(ap_scaled("rf", "y_true", 3)).cast("long").alias("ap_sum_float"),
        F.sum(ap_scaled("ri", "y_true", 3)).cast("long").alias("ap_sum_int8"),
    )


@register(
    "shared_head",
    EMB + """, w AS (SELECT d, floor(avg(q)) AS w FROM qz GROUP BY d),
      b AS (SELECT CAST(count(DISTINCT label) AS DOUBLE) AS b FROM embeddings),
      cand AS (SELECT vec_id, CAST(k AS BIGINT) AS cand_idx, d, q * (1 + (d + k) % 3) AS h
               FROM qz, range(7) t(k) WHERE k < 2 + vec_id % 5)
      SELECT vec_id AS item_id, cand_idx, sum(h * w) + any_value(b.b) AS logit FROM cand JOIN w USING (d) CROSS JOIN b GROUP BY vec_id, cand_idx""",
    ("ML-1",),
)
def q_shared_head(spark, sf):
    """One weight vector and bias over each item's own candidate vectors (2 to 6 of them)."""
    items = _items(spark, sf)
    sums = items.select(F.posexplode("q").alias("d", "v")).groupBy("d").agg(F.floor(F.avg("v")).cast("double").alias("w"))
    weights = [r["w"] for r in sums.orderBy("d").collect()]  # one row per dimension
    bias = items.agg(F.countDistinct("label")).first()[0]
    k = F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 5 + 1)
    vectors = F.transform(k, lambda c: F.transform("q", lambda v, d: v * (1 + (d + c) % 3)))
    scored = score.shared_head(items.select("vec_id", vectors.alias("candidates")), weights, float(bias))
    return scored.select(F.col("vec_id").alias("item_id"), F.posexplode("logits").alias("cand_idx", "logit")).withColumn("cand_idx", F.col("cand_idx").cast("long"))


def numpy_dot_scorer(heads: np.ndarray, runs: list[int]):
    """A user-style scorer factory: integer dot products of quantised vectors with heads."""

    def make():
        def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["q"].to_numpy()).astype(np.int64)
            out = []
            for i, run in enumerate(runs):
                logits = x @ heads[i].T
                n, k = logits.shape
                out.append(pd.DataFrame({
                    "run_id": np.full(n * k, run, dtype=np.int64),
                    "item_id": np.repeat(pdf["vec_id"].to_numpy(), k),
                    "y_true": np.repeat(pdf["label"].to_numpy().astype(np.int64), k),
                    "cand_idx": np.tile(np.arange(k, dtype=np.int64), n),
                    "logit": logits.reshape(-1),
                }))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
                columns=["run_id", "item_id", "y_true", "cand_idx", "logit"])

        return scorer

    return make


@register("plug_scorer", EMB + "SELECT run_id, item_id, y_true, cand_idx, logit FROM sc", ("ML-3", "UF-2"))
def q_plug_scorer(spark, sf):
    items = _items(spark, sf)
    runs, classes, m = score.head_matrix(_int_heads(items))
    heads = np.array(m.tolist(), dtype=np.int64)
    bc = share(spark, heads)

    def make():
        return numpy_dot_scorer(bc.value, runs)()

    return score.score_with(items.select("vec_id", "label", "q"), make,
                            "run_id long, item_id long, y_true long, cand_idx long, logit long")


@register(
    "cv_oof_map",
    EMB + f"""SELECT run_id AS fold, count(*) AS n_items, CAST(sum({AP6}) AS BIGINT) AS ap_sum,
        round(CAST(sum({AP6}) AS DOUBLE) / CAST(6 * count(*) AS DOUBLE), 6) AS map
      FROM ranked WHERE cand_idx = y_true AND item_id % {N_RUNS} = run_id GROUP BY run_id""",
    ("ML-5",),
)
def q_cv_oof_map(spark, sf):
    oof = _ranked(int8_scores(spark, sf, held_out_only=True))
    m = metrics.map_at_k(oof, 3, by=["run_id"])
    return m.select(F.col("run_id").alias("fold"), "n_items", "ap_sum", F.round("map", 6).alias("map"))

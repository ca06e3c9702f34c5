"""Queries that fit: the shared head (ML-4), its cross-validation (ML-5), trials of a user's objective (UF-3).

Candidate vectors are the scores of the runs, so the head learns how to blend them; DuckDB repeats the
Newton steps as a recursive query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators import conditional, metrics, tune
from rankspark.plans import oracle as O
from rankspark.plans.catalog import register
from rankspark.plans.q_events import N_TRIALS, SPACE, TRIALS_SQL
from rankspark.sources import fixtures as fx

N_FOLDS = fx.N_FOLDS_LEADERBOARD
STEPS = 5
L2 = 0.05
GRID = [0.01, 20.0]


def stacked_items(spark, sf) -> DataFrame:
    """item_id, y_true, fold, candidates: per candidate the score of run 0 and the mean of the others."""
    runs = fx.event_scores(spark, sf).groupBy("item_id").agg(
        F.max("y_true").alias("y_true"), *[F.max(F.when(F.col("run_id") == r, F.col("logits"))).alias(f"l{r}") for r in range(fx.N_RUNS)])
    rest = F.zip_with("l1", "l2", lambda a, b: (a + b) / (2.0 * fx.SCORE_MOD))
    vectors = F.zip_with("l0", rest, lambda a, b: F.array(a / float(fx.SCORE_MOD), b))
    return runs.select("item_id", "y_true", (F.col("item_id") % N_FOLDS).cast("int").alias("fold"), vectors.alias("candidates"))


def _newton_sql(keys: str, cases: str, where: str) -> str:
    """Newton steps for every row of ``cases`` (columns ``keys`` and l2): one head per row."""
    k = f"{keys}, " if keys else ""
    return f"""feat AS (
  SELECT item_id, cand_idx, item_id % {N_FOLDS} AS item_fold, any_value(cand_idx = y_true) AS hit,
    max(logit) FILTER (WHERE run_id = 0) / 10007.0::DOUBLE AS x1, sum(logit) FILTER (WHERE run_id > 0) / 20014.0::DOUBLE AS x2
  FROM event_scores GROUP BY item_id, cand_idx),
cases AS ({cases}),
newton AS (
  SELECT {k}l2, 0 AS step, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM cases
  UNION ALL
  SELECT {k}l2, step + 1, w1 - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), w2 - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (
    SELECT {k}l2, step, w1, w2, avg(m1 - t1) + l2 * w1 AS g1, avg(m2 - t2) + l2 * w2 AS g2,
      avg(s11 - m1 * m1) + l2 AS h11, avg(s12 - m1 * m2) AS h12, avg(s22 - m2 * m2) + l2 AS h22
    FROM (
      SELECT {k}l2, step, w1, w2, item_id, sum(e * x1) / sum(e) AS m1, sum(e * x2) / sum(e) AS m2,
        sum(e * x1 * x1) / sum(e) AS s11, sum(e * x1 * x2) / sum(e) AS s12, sum(e * x2 * x2) / sum(e) AS s22,
        max(x1) FILTER (WHERE hit) AS t1, max(x2) FILTER (WHERE hit) AS t2
      FROM (SELECT n.*, f.item_id, f.hit, f.x1, f.x2, exp(w1 * x1 + w2 * x2) AS e FROM newton n JOIN feat f ON {where} WHERE step < {STEPS}) z
      GROUP BY {k}l2, step, w1, w2, item_id) y
    GROUP BY {k}l2, step, w1, w2) x)"""


FIT_SQL = "WITH RECURSIVE " + ",\n".join((*O.EVENT_ALL, _newton_sql("", f"SELECT {L2}::DOUBLE AS l2", "true"))) + """
SELECT step::BIGINT AS step, round(avg(loss), 6) AS loss, round(w1, 6) AS w1, round(w2, 6) AS w2
FROM (SELECT step, w1, w2, ln(sum(exp(w1 * x1 + w2 * x2))) - max(w1 * x1 + w2 * x2) FILTER (WHERE hit) AS loss
      FROM newton, feat GROUP BY step, w1, w2, item_id) t GROUP BY step, w1, w2"""


@register("fit_shared_head", FIT_SQL, ("ML-4",))
def q_fit_shared_head(spark, sf):
    """Loss and weights of the shared head after every Newton step."""
    fitted = conditional.fit_shared_head(stacked_items(spark, sf), l2=L2, steps=STEPS, tol=0.0)
    h = conditional.history_frame(spark, fitted)
    return h.select("step", F.round("loss", 6).alias("loss"), F.round(F.col("w")[0], 6).alias("w1"), F.round(F.col("w")[1], 6).alias("w2"))


CV_CASES = f"SELECT fold, l2 FROM range({N_FOLDS}) t(fold), (VALUES {', '.join(f'({x}::DOUBLE)' for x in GRID)}) g(l2)"
CV_SQL = "WITH RECURSIVE " + ",\n".join((*O.EVENT_ALL, _newton_sql("fold", CV_CASES, "f.item_fold <> n.fold"))) + f""",
oof AS (
  SELECT fold, l2, item_id, hit, row_number() OVER (PARTITION BY fold, l2, item_id ORDER BY w1 * x1 + w2 * x2 DESC, cand_idx) AS rnk
  FROM newton JOIN feat ON item_fold = fold WHERE step = {STEPS}),
per_fold AS (
  SELECT l2, fold, count(*) AS n_items, sum(CASE rnk WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END)::DOUBLE / (6 * count(*)) AS map
  FROM oof WHERE hit GROUP BY l2, fold),
mean AS (SELECT l2, avg(map) AS mean_map FROM per_fold GROUP BY l2)
SELECT l2, fold::INTEGER AS fold, n_items, round(map, 6) AS map, round(mean_map, 6) AS mean_map FROM per_fold JOIN mean USING (l2)"""


@register("cv_shared_head", CV_SQL, ("ML-5",))
def q_cv_shared_head(spark, sf):
    """Fits and scores: ``CrossValidator`` with a fold column, every value's held-out MAP@3 per fold."""
    items = conditional.stored(stacked_items(spark, sf), "cv-items", "fold")
    model = conditional.cross_validate_grid(items, GRID, N_FOLDS, steps=STEPS, tol=0.0, parallelism=2)
    out = None
    for i, l2 in enumerate(GRID):
        scored = conditional.out_of_fold(items, model, i)
        part = metrics.map_at_k(scored, 3, by=["fold"]).select(
            F.lit(l2).alias("l2"), "fold", "n_items", F.round("map", 6).alias("map"), F.lit(round(float(model.avgMetrics[i]), 6)).alias("mean_map"))
        out = part if out is None else out.unionByName(part)
    return out


class BlendObjective(tune.MergeObjective):
    """MAP@3 of two runs blended by a trial's weight, in numpy: the state counts the items and the
    hits at each of the first three places. Weights above 8 are refused, to show failed trials."""

    def zero(self, params):
        if params["weight"] > 8:
            raise ValueError(f"weight {params['weight']} above 8")
        return np.zeros(4, np.int64)

    def add(self, state, rows, params):
        blend = params["weight"] * np.stack(rows["l0"]) + (10 - params["weight"]) * np.stack(rows["l1"])
        true = rows["y_true"].to_numpy()
        own = blend[np.arange(len(true)), true][:, None]
        place = (blend > own).sum(1) + ((blend == own) & (np.arange(blend.shape[1]) < true[:, None])).sum(1)
        return state + np.concatenate([[len(true)], np.bincount(place, minlength=3)[:3]])

    def merge(self, a, b):
        return a + b

    def score(self, state, params):
        return round(float(state[1:] @ [6, 3, 2]) / (6 * state[0]), 6) if state[0] else 0.0


@register(
    "trial_objective",
    TRIALS_SQL + """SELECT trial, weight, CASE WHEN weight <= 8 THEN score END AS score,
        CASE WHEN weight > 8 THEN 'ValueError: weight ' || weight || ' above 8' END AS error FROM trials JOIN scored USING (trial)""",
    ("UF-3", "ML-6"),
)
def q_trial_objective(spark, sf):
    """A user's Python objective over all events, all trials in one pass on the executors."""
    two = fx.event_scores(spark, sf).where("run_id < 2").groupBy("item_id").agg(
        F.max("y_true").alias("y_true"), *[F.max(F.when(F.col("run_id") == r, F.col("logits"))).alias(f"l{r}") for r in range(2)])
    return tune.search_over(two, tune.trial_grid(spark, SPACE, N_TRIALS, seed=42), BlendObjective()).select("trial", "weight", "score", "error")

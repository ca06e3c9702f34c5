"""E2 queries over the multi-run event scores: rank, top-k, ensemble, evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions.arrays import ap_scaled, softmax_xent
from rankspark.operators import ensemble, metrics, ranking, tune
from rankspark.operators.joins import lookup_join
from rankspark.operators.prepare import encode_labels, label_vocab, with_label
from rankspark.plans import oracle as O
from rankspark.plans.catalog import register
from rankspark.sources import fixtures as fx
from rankspark.sources.tables import read_table


def _scores(spark, sf):
    return fx.event_scores(spark, sf)


def _run_ranks(spark, sf):
    return ranking.rank_candidates(_scores(spark, sf))


EV = O.with_ctes(*O.EVENT_ALL)
EV_RR = O.with_ctes(*O.EVENT_ALL, O.RUN_RANKS)


@register("rank_candidates", EV_RR + "SELECT run_id, item_id, ranks FROM run_ranks", ("WN-5",))
def q_rank_candidates(spark, sf):
    return _run_ranks(spark, sf).select("run_id", "item_id", ranking.ranks_text("ranks").alias("ranks"))


@register(
    "rank_long",
    EV + "SELECT run_id, item_id, cand_idx, CAST(rnk AS BIGINT) AS rnk FROM ranked",
    ("WN-5",),
)
def q_rank_long(spark, sf):
    long = fx.event_scores_long(spark, sf)
    r = ranking.rank_long(long, ["run_id", "item_id"], "cand_idx", "logit")
    return r.select("run_id", "item_id", "cand_idx", F.col("rnk").cast("long").alias("rnk"))


@register(
    "top_3_per_item",
    EV + """SELECT run_id, item_id, string_agg(CAST(cand_idx AS VARCHAR), ' ' ORDER BY rnk) AS top_3
            FROM ranked WHERE rnk <= 3 GROUP BY run_id, item_id""",
    ("SL-3",),
)
def q_top3(spark, sf):
    r = ranking.top_k_ranks(_run_ranks(spark, sf), 3, out="top")
    return r.select("run_id", "item_id", ranking.ranks_text("top").alias("top_3"))


@register(
    "top_1_prediction",
    EV + "SELECT run_id, item_id, cand_idx AS pred_idx FROM ranked WHERE rnk = 1",
    ("SL-4",),
)
def q_top1(spark, sf):
    return ranking.top_1_prediction(_run_ranks(spark, sf)).select("run_id", "item_id", "pred_idx")


MAP_SQL = EV + """SELECT run_id, count(*) AS n_items,
    CAST(sum(CASE rnk WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END) AS BIGINT) AS ap_sum,
    round(CAST(sum(CASE rnk WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END) AS DOUBLE) / CAST(6 * count(*) AS DOUBLE), 6) AS map
  FROM ranked WHERE cand_idx = y_true GROUP BY run_id"""


@register("map_at_3", MAP_SQL, ("AG-15",))
def q_map_at_3(spark, sf):
    m = metrics.map_at_k(_run_ranks(spark, sf), 3, by=["run_id"])
    return m.select("run_id", "n_items", "ap_sum", F.round("map", 6).alias("map"))


@register(
    "union_runs",
    """WITH runs AS (
      SELECT event_id AS item_id, event_type AS name, 0 AS run_id FROM events
      UNION ALL SELECT doc_id, source, 1 FROM documents
      UNION ALL SELECT o_orderkey, o_orderpriority, 2 FROM orders)
    SELECT CAST(run_id AS BIGINT) AS run_id, item_id, name FROM runs""",
    ("SO-1",),
)
def q_union_runs(spark, sf):
    """Three separately read tables, columns in different order, stacked by name."""
    runs = [
        read_table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("name")),
        read_table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("item_id")),
        read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("name")),
    ]
    return ensemble.union_runs(runs).select("run_id", "item_id", "name")


@register(
    "align_runs",
    EV + "SELECT item_id, count(DISTINCT run_id) AS n_runs FROM event_scores GROUP BY item_id HAVING count(DISTINCT run_id) = 3",
    ("JN-6",),
)
def q_align_runs(spark, sf):
    return ensemble.align_runs(_run_ranks(spark, sf), fx.N_RUNS)


@register(
    "borda",
    O.with_ctes(*O.EVENT_ALL, O.K_EVENTS, O.BORDA)
    + "SELECT item_id, string_agg(CAST(cand_idx AS VARCHAR), ' ' ORDER BY rnk) AS ranks FROM borda_ranked GROUP BY item_id",
    ("AG-20",),
)
def q_borda(spark, sf):
    b = ensemble.borda(_run_ranks(spark, sf))
    return b.select("item_id", ranking.ranks_text("ranks").alias("ranks"))


@register(
    "mean_logit",
    EV + """, ml AS (SELECT item_id, cand_idx, avg(logit) AS s FROM event_scores GROUP BY item_id, cand_idx),
            mr AS (SELECT item_id, cand_idx, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, cand_idx) AS rnk FROM ml)
            SELECT item_id, string_agg(CAST(cand_idx AS VARCHAR), ' ' ORDER BY rnk) AS ranks FROM mr GROUP BY item_id""",
    ("AG-21",),
)
def q_mean_logit(spark, sf):
    m = ensemble.mean_logit(_scores(spark, sf))
    return m.select("item_id", ranking.ranks_text("ranks").alias("ranks"))


LOSS_CTE = """, lse AS (
  SELECT run_id, item_id, any_value(y_true) AS y_true, max(logit) AS m FROM event_scores GROUP BY run_id, item_id),
item_loss AS (
  SELECT s.run_id, s.item_id,
    l.m + ln(sum(exp(CAST(s.logit AS DOUBLE) - l.m))) - max(CASE WHEN s.cand_idx = l.y_true THEN s.logit END) AS loss
  FROM event_scores s JOIN lse l ON s.run_id = l.run_id AND s.item_id = l.item_id
  GROUP BY s.run_id, s.item_id, l.m)"""


@register(
    "candidate_loss",
    EV + LOSS_CTE + " SELECT run_id, count(*) AS n_items, round(avg(loss), 6) AS loss FROM item_loss GROUP BY run_id",
    ("AG-22",),
)
def q_candidate_loss(spark, sf):
    loss = metrics.candidate_loss(_scores(spark, sf), by=["run_id"])
    return loss.select("run_id", "n_items", F.round("loss", 6).alias("loss"))


CONF_SQL_CTE = """, top1 AS (SELECT run_id, item_id, y_true, cand_idx AS pred_idx FROM ranked WHERE rnk = 1),
cnt AS (SELECT run_id, y_true AS true_idx, pred_idx, count(*) AS n FROM top1 GROUP BY ALL),
grid AS (SELECT r.run_id, a.label_idx AS true_idx, b.label_idx AS pred_idx
         FROM (SELECT DISTINCT run_id FROM top1) r CROSS JOIN event_labels a CROSS JOIN event_labels b),
cm AS (SELECT g.run_id, g.true_idx, g.pred_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN cnt c USING (run_id, true_idx, pred_idx))"""


def _confusion(spark, sf):
    n_labels = fx.event_labels(spark, sf).count()
    return metrics.confusion(ranking.top_1_prediction(_run_ranks(spark, sf)), n_labels, by=["run_id"])


@register("confusion", EV + CONF_SQL_CTE + " SELECT * FROM cm", ("AG-16",))
def q_confusion(spark, sf):
    return _confusion(spark, sf)


@register(
    "confusion_normalized",
    EV + CONF_SQL_CTE + """ SELECT run_id, true_idx, pred_idx, n,
        round(n / CASE WHEN sum(n) OVER (PARTITION BY run_id, true_idx) = 0 THEN 1
                       ELSE sum(n) OVER (PARTITION BY run_id, true_idx) END, 6) AS rate FROM cm""",
    ("AG-17",),
)
def q_confusion_normalized(spark, sf):
    return metrics.confusion_normalized(_confusion(spark, sf), by=["run_id"]).withColumn("rate", F.round("rate", 6))


@register(
    "submission",
    O.with_ctes(*O.EVENT_ALL, O.K_EVENTS, O.BORDA)
    + """SELECT b.item_id AS row_id, string_agg(l.label, ' ' ORDER BY b.rnk) AS prediction
         FROM borda_ranked b JOIN event_labels l ON b.cand_idx = l.label_idx
         WHERE b.rnk <= 3 GROUP BY b.item_id""",
    ("PF-11", "JN-2"),
)
def q_submission(spark, sf):
    b = ensemble.borda(_run_ranks(spark, sf)).withColumnRenamed("item_id", "row_id")
    return ranking.submission(b, fx.event_labels(spark, sf), key="row_id")


@register(
    "align_truth",
    O.with_ctes(*O.EVENT_ALL, O.K_EVENTS, O.BORDA)
    + """, t AS (SELECT DISTINCT event_id AS item_id FROM events),
         p AS (SELECT DISTINCT item_id FROM borda_ranked)
         SELECT count(*) FILTER (WHERE t.item_id IS NOT NULL AND p.item_id IS NOT NULL) AS n_matched,
                count(*) FILTER (WHERE p.item_id IS NULL) AS n_truth_only,
                count(*) FILTER (WHERE t.item_id IS NULL) AS n_pred_only
         FROM t FULL OUTER JOIN p ON t.item_id = p.item_id""",
    ("JN-5",),
)
def q_align_truth(spark, sf):
    truth = read_table(spark, sf, "events").select(F.col("event_id").alias("item_id"))
    preds = ensemble.borda(_run_ranks(spark, sf))
    return metrics.align_truth(truth, preds, "item_id")


PER_FOLD_CTE = LOSS_CTE + """,
per_fold AS (
  SELECT il.run_id, il.item_id % 5 AS fold, avg(il.loss) AS loss,
    CAST(sum(CASE r.rnk WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END) AS DOUBLE) / CAST(6 * count(*) AS DOUBLE) AS map
  FROM item_loss il JOIN ranked r ON il.run_id = r.run_id AND il.item_id = r.item_id AND r.cand_idx = r.y_true
  GROUP BY il.run_id, il.item_id % 5)"""


def _per_fold(spark, sf):
    ranked = _run_ranks(spark, sf).withColumn("fold", F.col("item_id") % fx.N_FOLDS_LEADERBOARD)
    return ranked.groupBy("run_id", "fold").agg(
        F.avg(softmax_xent("logits", "y_true")).alias("loss"),
        (F.sum(ap_scaled("ranks", "y_true", 3)).cast("double") / (F.count(F.lit(1)) * 6).cast("double")).alias("map"),
    )


@register(
    "leaderboard",
    EV + PER_FOLD_CTE + """ SELECT run_id AS model, round(avg(loss), 6) AS mean_loss, round(stddev_samp(loss), 6) AS std_loss,
        round(avg(map), 6) AS mean_map, round(stddev_samp(map), 6) AS std_map, count(*) AS n
      FROM per_fold GROUP BY run_id""",
    ("AG-23",),
)
def q_leaderboard(spark, sf):
    lb = metrics.leaderboard(_per_fold(spark, sf).withColumnRenamed("run_id", "model"))
    return lb.select("model", *[F.round(c, 6).alias(c) for c in ("mean_loss", "std_loss", "mean_map", "std_map")], "n")


@register(
    "hardest_fold",
    EV + PER_FOLD_CTE + """, fl AS (SELECT fold, avg(loss) AS loss FROM per_fold GROUP BY fold)
        SELECT CAST(arg_max(fold, loss) AS BIGINT) AS fold, round(max(loss), 6) AS loss FROM fl""",
    ("AG-24",),
)
def q_hardest_fold(spark, sf):
    fl = _per_fold(spark, sf).groupBy("fold").agg(F.avg("loss").alias("loss"))
    h = metrics.hardest_fold(fl)
    return h.select(F.col("fold").cast("long").alias("fold"), F.round("loss", 6).alias("loss"))


@register(
    "event_label_vocab",
    O.with_ctes(O.EVENT_LABELS) + "SELECT label, label_idx FROM event_labels",
    ("AG-2", "WN-1", "SO-2"),
)
def q_event_vocab(spark, sf):
    return label_vocab(read_table(spark, sf, "events").select(F.col("event_type").alias("label")))


# --- candidate lists of different lengths (per question) --------------------------------------

QV = O.with_ctes(O.RESPONSES, O.QUESTION_CANDIDATES, O.RUN_IDS, O.RESPONSE_SCORES)


@register(
    "rank_by_question",
    QV + """SELECT run_id, item_id, string_agg(CAST(cand_idx AS VARCHAR), ' ' ORDER BY rnk) AS ranks
            FROM rranked GROUP BY run_id, item_id""",
    ("WN-5", "JN-4"),
)
def q_rank_by_question(spark, sf):
    r = ranking.rank_candidates(fx.response_scores(spark, sf))
    return r.select("run_id", "item_id", ranking.ranks_text("ranks").alias("ranks"))


@register(
    "borda_by_question",
    QV + """, sz AS (SELECT item_id, count(DISTINCT cand_idx) AS k FROM rranked GROUP BY item_id),
        bp AS (SELECT item_id, cand_idx, sum(k - (rnk - 1)) AS pts FROM rranked JOIN sz USING (item_id) GROUP BY item_id, cand_idx),
        br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pts DESC, cand_idx DESC) AS rnk FROM bp)
        SELECT item_id, string_agg(CAST(cand_idx AS VARCHAR), ' ' ORDER BY rnk) AS ranks FROM br GROUP BY item_id""",
    ("AG-20",),
)
def q_borda_by_question(spark, sf):
    b = ensemble.borda(ranking.rank_candidates(fx.response_scores(spark, sf)))
    return b.select("item_id", ranking.ranks_text("ranks").alias("ranks"))


def _map_sql(k: int) -> str:
    return QV + f"""SELECT run_id, count(DISTINCT item_id) AS n_items,
        round(sum(CASE WHEN cand_idx = y_true AND rnk <= {k} THEN 1.0 / rnk ELSE 0.0 END) / count(DISTINCT item_id), 6) AS map
        FROM rranked GROUP BY run_id"""


def _map_by_question(spark, sf, k):
    m = metrics.map_at_k(ranking.rank_candidates(fx.response_scores(spark, sf)), k, by=["run_id"])
    return m.select("run_id", "n_items", F.round("map", 6).alias("map"))


@register("map_at_20", _map_sql(20), ("AG-15",))
def q_map_at_20(spark, sf):
    return _map_by_question(spark, sf, 20)


@register("map_at_50", _map_sql(50), ("AG-15",))
def q_map_at_50(spark, sf):
    return _map_by_question(spark, sf, 50)


@register(
    "submission_partial",
    O.with_ctes(O.RESPONSES, O.QUESTION_CANDIDATES, O.VOCAB_ALL) + """,
        r AS (SELECT row_id, CASE WHEN category IS NULL THEN [] ELSE [v.label_idx, 999999, 0] END AS ranks
              FROM responses LEFT JOIN vocab_all v ON v.label = concat(coalesce(category, 'NA'), ':', coalesce(misconception, 'NA'))),
        e AS (SELECT row_id, unnest(ranks) AS idx, generate_subscripts(ranks, 1) AS pos FROM r)
        SELECT r.row_id, coalesce(string_agg(v.label, ' ' ORDER BY e.pos), '') AS prediction
        FROM r LEFT JOIN e USING (row_id) LEFT JOIN vocab_all v ON v.label_idx = e.idx GROUP BY r.row_id""",
    ("PF-11", "JN-2"),
)
def q_submission_partial(spark, sf):
    """Rankings that are empty, or hold an index outside the vocabulary: every key keeps a row."""
    r = with_label(fx.responses(spark, sf).select("row_id", "category", "misconception"))
    vocab = label_vocab(r)
    coded = encode_labels(r, vocab)
    ranks = F.when(F.col("category").isNull(), F.array().cast("array<long>")).otherwise(F.array("label_idx", F.lit(999999).cast("long"), F.lit(0).cast("long")))
    return ranking.submission(coded.select("row_id", ranks.alias("ranks")), vocab)


# --- trials (SC-8, ML-6, AG-18): an integer blend of two runs, scored for all trials at once ---

N_TRIALS = 8
SPACE = [tune.Param("weight", "int", 0, 10), tune.Param("rate", "log", 1e-5, 1e-3), tune.Param("decay", "uniform", 0.0, 0.1)]


def _unit_sql(name: str) -> str:
    return f"(CAST(concat('0x', substr(md5('42:{name}:' || CAST(trial AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)"


TRIALS_SQL = EV + f""", trials AS (SELECT trial, CAST(floor({_unit_sql('weight')} * 11) AS BIGINT) AS weight,
      exp(ln(1e-5) + {_unit_sql('rate')} * (ln(1e-3) - ln(1e-5))) AS rate, {_unit_sql('decay')} * 0.1 AS decay
      FROM (SELECT CAST(t AS BIGINT) AS trial FROM range({N_TRIALS}) t(t))),
    blend AS (SELECT t.trial, a.item_id, a.y_true, a.cand_idx, t.weight * a.logit + (10 - t.weight) * b.logit AS logit
      FROM event_scores a JOIN event_scores b ON a.item_id = b.item_id AND a.cand_idx = b.cand_idx AND a.run_id = 0 AND b.run_id = 1
      CROSS JOIN trials t),
    br AS (SELECT *, row_number() OVER (PARTITION BY trial, item_id ORDER BY logit DESC, cand_idx) AS rnk FROM blend),
    scored AS (SELECT trial, round(CAST(sum(CASE rnk WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END) AS DOUBLE) / (6 * count(*)), 6) AS score
      FROM br WHERE cand_idx = y_true GROUP BY trial)
"""


def _trials(spark, sf):
    """Every item under every trial: its blended list, ranked; scored by MAP@3 in one job."""
    trials = tune.trial_grid(spark, SPACE, N_TRIALS, seed=42)
    two = _scores(spark, sf).where("run_id < 2").groupBy("item_id").agg(
        F.max("y_true").alias("y_true"), F.max(F.when(F.col("run_id") == 0, F.col("logits"))).alias("l0"), F.max(F.when(F.col("run_id") == 1, F.col("logits"))).alias("l1"))
    cases = two.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_TRIALS - 1).cast("long"))))
    cases = lookup_join(cases, trials.select("trial", "weight"), "trial")
    logits = F.zip_with("l0", "l1", lambda a, b: F.col("weight") * a + (10 - F.col("weight")) * b)
    ranked = ranking.rank_candidates(cases.select("trial", "item_id", "y_true", logits.alias("logits")))
    return tune.score_trials(ranked, trials, lambda c, by: metrics.map_at_k(c, 3, by=by).withColumn("map", F.round("map", 6)), "map")


@register("trial_search", TRIALS_SQL + "SELECT trial, weight, round(rate, 9) AS rate, round(decay, 9) AS decay, score FROM trials JOIN scored USING (trial)", ("ML-6", "SC-8"))
def q_trial_search(spark, sf):
    t = _trials(spark, sf)
    return t.select("trial", "weight", F.round("rate", 9).alias("rate"), F.round("decay", 9).alias("decay"), "score")


@register(
    "best_trial",
    TRIALS_SQL + """SELECT trial, weight, score AS best_value FROM trials JOIN scored USING (trial)
        ORDER BY score DESC, trial LIMIT 1""",
    ("AG-18",),
)
def q_best_trial(spark, sf):
    return tune.best_trial(_trials(spark, sf), ["weight"])

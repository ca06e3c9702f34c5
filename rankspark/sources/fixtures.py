"""Fixture views: the reference's inputs re-expressed over the driver tables.

The education data of the reference is not available, so each input is a view over the
driver tables (see FIXTURES.md section 4). Every view reads whole tables, so its work grows
with them. The same views exist as SQL in ``rankspark.plans.oracle`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators.prepare import encode_labels, label_vocab
from rankspark.sources.tables import read_table

# --- fixed values (fixture definitions, FIXTURES.md section 4) ------------------------------
N_RUNS = 3                      # runs (model seeds) in the multi-run score view
SCORE_ITEM_MUL = 7919           # logit = (item*7919 + cand*104729 + run*15485863) % 10007
SCORE_CAND_MUL = 104729
SCORE_RUN_MUL = 15485863
SCORE_MOD = 10007
SCORE_TRUTH_BONUS = 3000        # added to the true candidate's logit
MISCONCEPTION_MOD = 7           # misconception name = 'M' || doc_id % 7
N_FOLDS_LEADERBOARD = 5         # fold of an event item = item_id % 5
# ------------------------------------------------------------------------------------------

UNROLLED = 32                   # candidates up to which a score list is a plain array expression


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response table: documents with their (optional) labels.

    ``row_id, question_id, mc_answer, explanation, category, misconception``.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select(
        "doc_id", "quality", "toxic", F.lit(True).alias("__labelled")
    )
    j = d.join(lab, "doc_id", "left")
    category = F.when(F.col("__labelled").isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(
            F.when(F.col("quality") == 1, F.lit("True")).otherwise(F.lit("False")),
            F.lit("_"),
            F.when(F.col("toxic") == 1, F.lit("Misconception"))
            .when(F.col("n_chars") % 2 == 0, F.lit("Correct"))
            .otherwise(F.lit("Neither")),
        )
    )
    misconception = F.when(
        F.col("toxic") == 1, F.concat(F.lit("M"), (F.col("doc_id") % MISCONCEPTION_MOD).cast("string"))
    )
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("question_id"),
        F.col("lang").alias("mc_answer"),
        F.col("text").alias("explanation"),
        category.alias("category"),
        misconception.alias("misconception"),
    )


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label vocabulary of the multi-run view: event types with a dense index."""
    return label_vocab(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("label")))


def _logit(item, cand, run, y):
    """The synthetic score of a candidate (the same formula as in the SQL fixture)."""
    base = (item * SCORE_ITEM_MUL + cand * SCORE_CAND_MUL + run * SCORE_RUN_MUL) % SCORE_MOD
    return base + F.when(cand == y, F.lit(SCORE_TRUTH_BONUS)).otherwise(F.lit(0))


def event_scores(spark: SparkSession, sf_dir: str, n_runs: int = N_RUNS) -> DataFrame:
    """Multi-run candidate scores, array form: ``run_id, item_id, y_true, logits``.

    One row per (run, item); ``logits[c]`` is the score of candidate c. Candidates are the
    dense label indices 0..K-1, K from the stored labels. Up to ``UNROLLED`` candidates are written out
    as plain expressions, which Spark compiles; longer lists are made by an array function.
    """
    labels = event_labels(spark, sf_dir)
    k = labels.count()
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("label"))
    ev = encode_labels(events, labels, out="y_true", how="inner").select("item_id", "y_true")
    runs = ev.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_runs - 1).cast("long"))).alias("run_id"),
        "item_id",
        "y_true",
    )
    score = lambda c: _logit(F.col("item_id"), c, F.col("run_id"), F.col("y_true"))
    if 0 < k <= UNROLLED:
        logits = F.array(*[score(F.lit(c).cast("long")) for c in range(k)])
    else:
        logits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), score)
    return runs.select("run_id", "item_id", "y_true", logits.alias("logits"))


def response_scores(spark: SparkSession, sf_dir: str, n_runs: int = N_RUNS) -> DataFrame:
    """Scores over per-question candidate lists, whose lengths differ from question to question:
    ``run_id, item_id, y_true, logits``. The truth is the place of the response's own label in its
    question's list, null if it isn't there; it earns the same bonus as for events."""
    from rankspark.operators.prepare import attach_question_candidates, with_label

    r = with_label(responses(spark, sf_dir).select("row_id", "question_id", "category", "misconception"))
    j = attach_question_candidates(r)
    place = F.array_position("candidates", F.col("label"))
    j = j.select(F.col("row_id").alias("item_id"), F.when(place > 0, place - 1).cast("long").alias("y_true"), F.size("candidates").alias("k"))
    runs = j.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_runs - 1).cast("long"))).alias("run_id"), "*")
    logits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1), lambda c: _logit(F.col("item_id"), c, F.col("run_id"), F.col("y_true")))
    return runs.select("run_id", "item_id", "y_true", logits.alias("logits"))


def event_scores_long(spark: SparkSession, sf_dir: str, n_runs: int = N_RUNS) -> DataFrame:
    """Long form: ``run_id, item_id, y_true, cand_idx, logit``."""
    arr = event_scores(spark, sf_dir, n_runs)
    return arr.select(
        "run_id", "item_id", "y_true",
        F.posexplode("logits").alias("cand_idx", "logit"),
    ).withColumn("cand_idx", F.col("cand_idx").cast("long"))


def embedding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate embeddings with their class: ``vec_id, embedding, label``."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")

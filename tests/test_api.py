"""Workflow-level API: column mapping, prepare, evaluate, profile, cross_validate."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import fit, metrics, prepare, profile, ranking
from rankspark.session import stored
from rankspark.sources import fixtures as fx
from rankspark.sources.io import map_columns


def test_column_map_renames(spark):
    df = spark.createDataFrame([("q", "e", 1)], "QuestionText string, StudentExplanation string, other long")
    assert map_columns(df).columns == ["question_text", "explanation", "other"]
    assert map_columns(df, {"other": "row_id"}).columns == ["question_text", "explanation", "row_id"]


def test_prepare_shapes(spark, sf_dir):
    p = prepare.prepare(fx.responses(spark, sf_dir), k=5, seed=42, dedup_keys=("mc_answer", "explanation"))
    clean = stored(p.clean, "clean")
    n = clean.count()
    assert n == clean.select("row_id").distinct().count()
    k = p.labels.count()
    assert clean.where(F.size("candidates") != k).count() == 0
    sizes = [r["count"] for r in clean.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_evaluate_report(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, label_idx long")
    truth = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (9, 0)], "row_id long, label_idx long")
    preds = spark.createDataFrame([(1, [0, 1, 2]), (2, [2, 1, 0]), (3, [0, 1, 2]), (7, [0, 1, 2])],
                                  "row_id long, ranks array<int>")
    r = metrics.evaluate(truth, preds, vocab)
    assert abs(r.map.first()["map"] - 11 / 18) < 1e-12
    a = r.alignment.first()
    assert (a["n_matched"], a["n_truth_only"], a["n_pred_only"]) == (3, 1, 1)
    cm = {(x["true_label"], x["pred_label"]): x["n"] for x in r.confusion.collect()}
    assert len(cm) == 9 and cm[("a", "a")] == 1 and cm[("b", "c")] == 1 and cm[("c", "a")] == 1
    assert r.errors.first()["n_errors"] == 0


def test_profile_tables(spark, sf_dir):
    tables = profile.profile(fx.responses(spark, sf_dir))
    assert set(tables) >= {"category_counts", "crosstab", "rate_by_decile", "length_histogram"}
    cat = {r["category"]: r["n"] for r in tables["category_counts"].collect()}
    ct = tables["crosstab"].collect()
    assert sum(cat.values()) == sum(r["Correct"] + r["Misconception"] + r["Neither"] for r in ct)
    assert tables["length_histogram"].count() == 40


def test_cross_validate_generic(spark, sf_dir):
    items = fx.embedding_items(spark, sf_dir).withColumn("fold", (F.col("vec_id") % 3).cast("int"))

    def fit_fn(train):
        return fit.fit_head(train, steps=2, lr=20.0, l2=0.001, seed=1)

    def score_fn(valid, head):
        return ranking.rank_candidates(fit.score_head(valid, head))

    oof = fit.cross_validate(items, 3, fit_fn, score_fn)
    assert oof.count() == items.count()
    per_fold = metrics.map_at_k(oof, 3, by=["fold"]).collect()
    assert len(per_fold) == 3 and all(0.0 <= r["map"] <= 1.0 for r in per_fold)

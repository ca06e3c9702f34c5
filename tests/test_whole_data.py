"""Nothing is cut, dropped or invented: null keys, ragged lists, any k, any worker."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rankspark.functions import arrays as A
from rankspark.operators import folds, metrics, prepare, profile, prompts, ranking, tune
from rankspark.operators.joins import lookup_join
from rankspark.plans.catalog import load_all
from rankspark.sources import fixtures as fx
from rankspark.sources import io
from rankspark.streaming.rankings import stream_items

REG = load_all()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_folds_of_rows_without_a_stratum(spark, sf_dir):
    r = fx.responses(spark, sf_dir).select("row_id", "category")
    for ranges in (None, 1, 7):
        f = folds.stratified_folds(r, "row_id", "category", 5, 42, ranges=ranges)
        sizes = {x["fold"]: x["count"] for x in f.groupBy("fold").count().collect()}
        assert sum(sizes.values()) == r.count() and max(sizes.values()) - min(sizes.values()) <= 1
        null = [x["count"] for x in f.where("category IS NULL").groupBy("fold").count().collect()]
        assert max(null) - min(null) <= 1 and sum(null) == r.where("category IS NULL").count()


def test_null_values_are_ranked_last(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(30)], "row_id long, v long")
    for size in (1_000_000, 4):
        got = {r["row_id"]: r["rnk"] for r in profile.rank_first(df, "v", rows_per_range=size).collect()}
        want = sorted(range(30), key=lambda i: (i % 3 == 0, i % 4 if i % 3 else 0, i))
        assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(1, 31))
    d = profile.length_deciles(df, "v").groupBy("decile").count().collect()
    assert sorted((r["decile"], r["count"]) for r in d) == [(i, 3) for i in range(10)]


def test_lists_of_any_length_are_ranked_whole(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 9.0], 2), (2, [3.0], 0), (3, [], None), (4, None, 0)], "item_id long, logits array<double>, y_true long")
    got = {r["item_id"]: r["ranks"] for r in ranking.rank_candidates(df).collect()}
    assert got == {1: [2, 1, 0], 2: [0], 3: [], 4: None}
    loss = metrics.candidate_loss(df).first()
    assert loss["n_items"] == 2 and loss["loss"] == pytest.approx((0.0184799 + 0.0) / 2, abs=1e-6)


def test_map_for_large_k_and_many_items(spark):
    one = spark.createDataFrame([(0, list(range(60))), (49, list(range(60))), (55, list(range(60)))], "y_true long, ranks array<int>")
    for k in (20, 40, 50, 60, 120):
        m = metrics.map_at_k(one, k).first()
        want = (1 + (1 / 50 if k >= 50 else 0) + (1 / 56 if k >= 56 else 0)) / 3
        assert m["map"] == pytest.approx(want, abs=1e-12) and m["n_items"] == 3
        if k <= 60:
            assert int(m["ap_sum"]) == sum(A.lcm_upto(k) // p for p in (1, 50, 56) if p <= k)
    # scaled sums beyond the long range
    many = spark.range(100_000).select(F.lit(0).cast("long").alias("y_true"), F.array(F.lit(0)).alias("ranks"))
    m = metrics.map_at_k(many, 40).first()
    assert m["map"] == 1.0 and int(m["ap_sum"]) == 100_000 * A.lcm_upto(40) > 2**63


def test_confusion_beyond_the_dense_grid(spark):
    preds = spark.createDataFrame([(0, 1), (0, 1), (5000, 0), (9999, 0)], "y_true long, pred_idx long")
    cells = {(r["true_idx"], r["pred_idx"]): r["n"] for r in metrics.confusion(preds, 6000).collect()}
    assert cells == {(0, 1): 2, (5000, 0): 1}


def test_lookup_join_is_the_same_within_and_beyond_the_bound(spark):
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    big = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "z")], "i long, k string")
    small = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k string, v long")
    for how, safe in (("left", True), ("inner", True), ("left", False), ("inner", False)):
        near = sorted(map(tuple, lookup_join(big, small, "k", how, safe).select("i", "k", "v").collect()))
        far = sorted(map(tuple, lookup_join(big, small, "k", how, safe, max_rows=1).select("i", "k", "v").collect()))
        assert near == far
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_csv_to_clean_table(spark, scratch):
    """IO-1 feeds E1: numeric keys, three-column dedup key, folds for all rows."""
    path = os.path.join(scratch, "r.csv")
    rows = ["row_id,QuestionId,QuestionText,MC_Answer,StudentExplanation,Category,Misconception"]
    rows += [f'{i},{q},"What, then?",A,"said ""{e}""",{c},{m}' for i, q, e, c, m in [
        (10, 1, "x", "True_Correct", "NA"), (2, 1, "x", "True_Correct", "NA"), (3, 2, "x", "False_Misconception", "M1"),
        (4, 2, "y", "NA", ""), (11, 1, "z", "False_Neither", "null")]]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\n")
    df = io.read_responses(spark, path)
    assert dict(df.dtypes)["row_id"] == "bigint"
    p = prepare.prepare(df, k=2, candidates="question")
    clean = {r["row_id"]: r for r in p.clean.collect()}
    assert sorted(clean) == [2, 3, 4, 11]
    assert clean[4]["label"] == "NA:NA" and len(clean[3]["candidates"]) == 6 and len(clean[2]["candidates"]) == 4
    assert clean[2]["explanation"] == 'said "x"' and clean[2]["question_text"] == "What, then?"
    assert sorted(r["fold"] for r in clean.values()) == [0, 0, 1, 1]
    full = prepare.prepare(df, k=2).clean.first()["candidates"]
    assert full == sorted(full) and len(full) == p.labels.count() == 4
    # the same table goes on to prompts, with the question's own text
    item = prompts.with_prefix(prompts.to_items(df)).where("row_id = 2").first()
    assert "**Question:** What, then?" in item["prefix"]


def _score_by_length(items):
    """A stand-in model: the score of a candidate is its length plus that of the prefix, mod 7."""
    return items.withColumn("logits", F.transform("suffixes", lambda s: ((F.length(s) + F.length("prefix")) % 7).cast("double")))


def test_items_to_rankings_in_batch_and_stream(spark, scratch):
    """IO-2 -> SC-3 -> score -> WN-5 -> IO-8, and the same from arriving files."""
    df = spark.createDataFrame(
        [(i, f"q{i % 2}", "A", f"because {i}", "True_Correct", "M1" if i % 2 else None, "What is 2+2?") for i in range(6)],
        "row_id long, question_id string, mc_answer string, explanation string, category string, misconception string, question_text string")
    items = prompts.to_items(df)
    io.write_items(items.drop("suffix_words"), os.path.join(scratch, "items"))
    with open(os.path.join(scratch, "items", "bad.json"), "w", encoding="utf-8") as f:
        f.write("{not json\n")
    back = io.read_items(spark, os.path.join(scratch, "items")).where("_corrupt_record IS NULL")
    assert sorted(back.select("row_id", "bundle.*", "suffixes").collect()) == sorted(items.select("row_id", "bundle.*", "suffixes").collect())
    prefixed = prompts.with_prefix(back)
    assert all("**Question:** What is 2+2?" in r["prefix"] for r in prefixed.collect())
    assert prompts.explode_prompts(prefixed).count() == 3 * 4 + 3 * 6
    words = [sorted(map(tuple, prompts.packing_budget(x).select("row_id", "suffix_words").collect())) for x in (prefixed, prompts.with_prefix(items))]
    assert words[0] == words[1]
    batch = {r["row_id"]: r["ranks"] for r in ranking.rank_candidates(_score_by_length(prefixed)).collect()}
    assert {len(x) for x in batch.values()} == {4, 6}
    out = os.path.join(scratch, "out")
    q = stream_items(spark, os.path.join(scratch, "items"), out, os.path.join(scratch, "ck"), _score_by_length, max_files_per_trigger=1)
    q.awaitTermination(120)
    assert {r["row_id"]: r["ranks"] for r in spark.read.json(out).collect()} == batch


def test_trials_report_their_errors(spark):
    trials = tune.trial_grid(spark, [tune.Param("n", "int", 1, 5)], 3, seed=1)

    def some(params):
        if params["trial"] == 1:
            raise ValueError("too big")
        return float(params["n"])

    got = {r["trial"]: r for r in tune.search(spark, trials, some).collect()}
    assert got[1]["score"] is None and "too big" in got[1]["error"] and got[0]["error"] is None
    with pytest.raises(RuntimeError, match="every trial failed"):
        tune.search(spark, trials, lambda p: 1 / 0)


def _mean():
    class _Mean(tune.MergeObjective):
        """The mean of column v plus the trial's shift; trial 1 fails on a row, trial 3 in the end."""

        def zero(self, params):
            return (0, 0)

        def add(self, state, rows, params):
            if params["trial"] == 1 and (rows["v"] == 7).any():
                raise ValueError("a seven")
            return state[0] + int(rows["v"].sum()), state[1] + len(rows)

        def merge(self, a, b):
            return a[0] + b[0], a[1] + b[1]

        def score(self, state, params):
            if params["trial"] == 3:
                return 1 / 0
            return state[0] / state[1] + params["trial"] if state[1] else None

    return _Mean()  # a class made here travels by value


def test_trials_share_one_pass_over_the_rows(spark):
    trials = spark.range(4).withColumnRenamed("id", "trial")
    rows = spark.createDataFrame([(i,) for i in range(100)], "v long")
    for parts in (1, 9):
        got = {r["trial"]: (r["score"], r["error"]) for r in tune.search_over(rows.repartition(parts), trials, _mean()).collect()}
        assert got[0] == (49.5, None) and got[2] == (51.5, None)
        assert got[1] == (None, "ValueError: a seven") and got[3][0] is None and "ZeroDivisionError" in got[3][1]
    empty = {r["trial"]: r["score"] for r in tune.search_over(rows.where("v < 0"), trials, _mean()).collect()}
    assert empty[0] is None and len(empty) == 4
    with pytest.raises(RuntimeError, match="every trial failed"):
        tune.search_over(rows, trials.where("trial = 1"), _mean())


def test_unlabelled_rows_are_no_class(spark):
    from rankspark.operators import fit

    items = spark.createDataFrame([(i, [float(i % 2), 1.0], None if i == 5 else i % 2) for i in range(6)], "vec_id long, embedding array<double>, label long")
    assert fit.fit_head(items, steps=1).classes == [0, 1]


def test_tasks_run_without_the_package_on_the_workers(tmp_path):
    """From another working folder, with only the driver's path knowing the package."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
from rankspark.operators import score
from rankspark.functions.text import word_count_arrow
df = s.createDataFrame([(1, 'a b  c', [[1.0, 2.0], [0.5, 0.0]])], 'i long, t string, candidates array<array<double>>')
assert df.select(word_count_arrow('t')).first()[0] == 3
assert score.shared_head(df, [1.0, 2.0], 0.5).first()['logits'] == [5.5, 1.0]
print(json.dumps('fine')) if False else print('fine')
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]
    assert json.dumps("fine")


@pytest.mark.parametrize("name", ["candidates_by_question", "render_prompts", "boxplot_category", "prepare_clean", "fold_split", "map_at_3"])
def test_nothing_stays_cached(spark, sf_dir, name):
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    REG[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_no_text_is_shuffled_on_the_question(spark, sf_dir):
    """The per-question table is broadcast after it was seen to be small, so the plan holds no
    exchange of the responses' text on the question key."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prompts.to_items(fx.responses(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan
    assert not [x for x in plan.split("\n") if "hashpartitioning(question_id" in x or "hashpartitioning(source" in x]


def test_dedup_sorts_and_shuffles_no_text(spark, sf_dir):
    plan = prepare.first_rows(fx.responses(spark, sf_dir), carry=["category"])._jdf.queryExecution().executedPlan().toString()
    aggregates = [x for x in plan.split("\n") if "Aggregate" in x]
    assert aggregates and not any("explanation" in x.split("functions=")[0] for x in aggregates)

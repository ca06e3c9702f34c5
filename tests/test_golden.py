"""Golden vectors and hand-made rows for each semantic decision."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from rankspark.functions import arrays as A
from rankspark.functions import text as T
from rankspark.operators import ensemble, metrics, prepare, profile
from rankspark.sources import io


def _map(spark, y, ranks, k=3):
    rows = [(i, yy, rr) for i, (yy, rr) in enumerate(zip(y, ranks, strict=False))]
    df = spark.createDataFrame(rows, "item_id long, y_true long, ranks array<int>")
    return metrics.map_at_k(df, k).first()["map"]


def test_map_perfect_top1(spark):
    assert _map(spark, [0, 1, 2], [[0, 1, 2], [1, 0, 2], [2, 1, 0]]) == 1.0


def test_map_positions_1_2_3(spark):
    v = _map(spark, [0, 1, 2], [[0, 1, 2], [2, 1, 0], [0, 1, 2]])
    assert 0.0 < v < 1.0
    assert v == pytest.approx(11 / 18, abs=1e-12)


def test_map_repeated_entries_first_hit_counts(spark):
    assert _map(spark, [0, 0, 0], [[0, 1, 2], [0, 0, 0], [0, 1, 0]]) == 1.0


def test_map_empty_is_zero(spark):
    assert _map(spark, [], []) == 0.0


def test_map_missing_truth_scores_zero(spark):
    assert _map(spark, [None, 1], [[0, 1, 2], [1, 0, 2]]) == 0.5


def test_rank_ties_and_bad_scores(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0, 3.0, None],)], "s array<double>")
    assert df.select(A.rank_desc("s").alias("r")).first()["r"] == [2, 3, 0, 1, 4]


def test_borda_tie_goes_to_higher_index(spark):
    df = spark.createDataFrame([([1, 1, 1, 0],)], "s array<long>")
    assert df.select(A.rank_desc("s", ties="high").alias("r")).first()["r"] == [2, 1, 0, 3]


def test_borda_points_and_order(spark):
    runs = spark.createDataFrame(
        [(0, 7, [0, 1, 2, 3]), (1, 7, [3, 2, 1, 0])], "run_id long, item_id long, ranks array<int>"
    )
    # points: run0 [4,3,2,1], run1 [1,2,3,4] -> all 5: ties -> higher index first
    assert ensemble.borda(runs).first()["ranks"] == [3, 2, 1, 0]


def test_loss_values(spark):
    df = spark.createDataFrame([(0, [2.0, 1.0, 0.0]), (2, [1000.0, 0.0, 999.0])], "y long, l array<double>")
    got = [r[0] for r in df.select(A.softmax_xent("l", "y")).collect()]
    assert got[0] == pytest.approx(0.4076059644, abs=1e-9)
    assert got[1] == pytest.approx(1.3132616875, abs=1e-9)


def test_category_without_underscore(spark):
    df = spark.createDataFrame([("NoUnderscore",), (None,)], "c string")
    r = df.select(T.assessment("c").alias("a"), T.has_misconception("c").alias("m")).collect()
    assert r[0]["a"] is None and r[0]["m"] is False
    assert r[1]["a"] is None and r[1]["m"] is False


def test_missing_tokens(spark):
    vals = ["NA", "none", "None", "null", "N/A", " nan"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r[0] for r in df.select(T.null_tokens("c")).collect()]
    assert got == [None, "none", None, None, None, " nan"]


def test_describe_quartiles(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 10]], "k string, v long")
    r = profile.describe_by(df, "k", "v").first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.75, 2.5, 4.75)
    assert r["std"] == pytest.approx(4.0824829, abs=1e-7)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 10]], "v long")
    h = profile.histogram(df, "v", 3).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3, 0, 1]


def test_histogram_equal_min_max_widens(spark):
    df = spark.createDataFrame([(5,), (5,)], "v long")
    h = profile.histogram(df, "v", 2).orderBy("bin").collect()
    assert [h[0]["lo"], h[0]["hi"], h[1]["hi"]] == [4.5, 5.0, 5.5]
    assert [r["n"] for r in h] == [0, 2]


def test_candidate_parsing(spark):
    df = spark.createDataFrame([('["a","b"]',), ("['a', 'b']",), ("5",)], "c string")
    got = [r[0] for r in df.select(T.parse_candidates("c")).collect()]
    assert got == [["a", "b"], ["['a',", "'b']"], ["5"]]


def test_csv_quoting_and_missing(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('row_id,StudentExplanation,Misconception\n1,"a ""q"", b\nc",NA\n')
    df = io.read_responses(spark, path)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["explanation"] == 'a "q", b\nc'
    assert rows[0]["misconception"] is None


def test_dedup_keeps_first_and_null_equals_null(spark):
    rows = [
        (1, "q1", "A", None, "x"), (2, "q1", "A", None, "y"),
        (3, "q1", "B", "t", "z"), (4, "q2", "B", "t", "w"), (0, "q2", "B", "t", "v"),
    ]
    df = spark.createDataFrame(rows, "row_id long, question_id string, mc_answer string, explanation string, category string")
    got = sorted((r["row_id"], r["category"]) for r in prepare.dedup_responses(df).collect())
    assert got == [(0, "v"), (1, "x"), (3, "z")]


def test_question_candidate_rule(spark):
    rows = [("q2", f"M{i}") for i in range(2)] + [("q3", f"M{i}") for i in range(3)] + \
           [("q4", f"M{i}") for i in range(4)] + [("q0", None)]
    df = spark.createDataFrame(rows, "question_id string, misconception string")
    c = prepare.question_candidates(prepare.question_misconceptions(df))
    sizes = {r["question_id"]: len(r["candidates"]) for r in c.collect()}
    assert sizes == {"q2": 8, "q3": 10, "q4": 12, "q0": 4}


def test_answer_key_ties_to_smaller_answer(spark):
    rows = [("q", "B", "True_Correct"), ("q", "A", "True_Neither"), ("q", "C", "False_Correct"),
            ("q", "C", "False_Correct")]
    df = spark.createDataFrame(rows, "question_id string, mc_answer string, category string")
    assert prepare.answer_key(df).first()["answer"] == "A"


def test_confusion_zero_fill_and_normalized_empty_row(spark):
    preds = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (5, 0)], "y_true long, pred_idx long")
    cm = metrics.confusion(preds, 3)
    assert cm.count() == 9
    cells = {(r["true_idx"], r["pred_idx"]): r["n"] for r in cm.collect()}
    assert cells[(0, 1)] == 2 and cells[(1, 0)] == 1 and cells[(2, 2)] == 0
    norm = {(r["true_idx"], r["pred_idx"]): r["rate"] for r in metrics.confusion_normalized(cm).collect()}
    assert norm[(0, 1)] == 1.0 and norm[(2, 0)] == 0.0
    assert metrics.confusion_errors(preds, 3).first()["n_errors"] == 1


def test_word_count_equals_python_split(spark):
    texts = ["a b  c", " x y　z\x1cw", "", None, "tab\there\nnew\x0bline", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.word_count("t")).collect()]
    assert got == [len(t.split()) if isinstance(t, str) else 0 for t in texts]


def test_render_prefix_template(spark):
    df = spark.createDataFrame([("Q", None)], "q string, e string")
    fields = {n: F.col("q") for n in T.PREFIX_FIELDS}
    fields["explanation"] = F.col("e")
    got = df.select(T.render_prefix(fields)).first()[0]
    assert got.startswith("<|im_start|>user\n**Question:** Q\n")
    assert got.endswith("**Student Explanation:** \n<|im_end|>\n<|im_start|>assistant\n")
    assert got.count("\n") == 9


def test_align_truth_reports_unmatched(spark):
    truth = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    preds = spark.createDataFrame([(2,), (3,), (4,), (5,)], "item_id long")
    r = metrics.align_truth(truth, preds).first()
    assert (r["n_matched"], r["n_truth_only"], r["n_pred_only"]) == (2, 1, 2)


def test_align_runs_keeps_complete_items(spark):
    runs = spark.createDataFrame([(0, 1), (1, 1), (0, 2)], "run_id long, item_id long")
    assert [r["item_id"] for r in ensemble.align_runs(runs, 2).collect()] == [1]


def test_published_category_tables(spark):
    # fixed values: published category counts and their row-normalised crosstab
    counts = {"True_Correct": 14802, "False_Misconception": 9457, "False_Neither": 6542,
              "True_Neither": 5265, "True_Misconception": 403, "False_Correct": 227}
    expected_norm = {False: (0.013990, 0.582830, 0.403180), True: (0.723107, 0.019687, 0.257206)}
    cats = spark.createDataFrame([(c, n) for c, n in counts.items()], "category string, n long")
    rows = cats.select("category", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    d = profile.derive(rows.withColumn("explanation", F.lit("x")))
    got = {r["category"]: r["n"] for r in profile.value_counts(d, "category").collect()}
    assert got == counts and sum(got.values()) == 36696
    ct = profile.crosstab(d, "ans_correct", "expl_assess")
    norm = profile.crosstab_normalized(ct, "ans_correct").collect()
    for r in norm:
        exp = expected_norm[r["ans_correct"]]
        assert (round(r["Correct"], 6), round(r["Misconception"], 6), round(r["Neither"], 6)) == exp
    col_sums = ct.agg(*[F.sum(c).alias(c) for c in T.ASSESSMENTS]).first()
    assert (col_sums["Correct"], col_sums["Misconception"], col_sums["Neither"]) == (15029, 9860, 11807)


def test_submission_keeps_every_key(spark):
    from rankspark.operators import ranking

    vocab = spark.createDataFrame([("True_Correct:NA", 0), ("False_Neither:NA", 1), ("True_Misconception:M1", 2),
                                   ("False_Correct:NA", 3)], "label string, label_idx long")
    ranked = spark.createDataFrame([(1, [2, 0, 1, 3]), (2, [3, 1]), (3, []), (4, None), (5, [9, 1])], "row_id long, ranks array<int>")
    a = {r["row_id"]: r["prediction"] for r in ranking.submission(ranked, vocab).collect()}
    assert a == {1: "True_Misconception:M1 True_Correct:NA False_Neither:NA", 2: "False_Correct:NA False_Neither:NA",
                 3: "", 4: "", 5: "False_Neither:NA"}


def test_word_counts_equal_python_split_on_all_whitespace(spark):
    import random

    ws = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    rng = random.Random(7)
    alphabet = ws + list("ab​é漢")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    texts += ["", " ", None, "  a  ", "\x1c", "a\x1db"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = df.select("i", T.word_count("t").alias("jvm"), T.word_count_arrow("t").alias("arrow")).collect()
    want = {i: (len(t.split()) if t is not None else 0) for i, t in enumerate(texts)}
    assert all(r["jvm"] == want[r["i"]] and r["arrow"] == want[r["i"]] for r in rows)


def test_borda_validation_and_space_labels(spark):
    from pyspark.errors import PySparkException

    from rankspark.operators import ranking

    schema = "run_id long, item_id long, ranks array<int>"
    runs = spark.createDataFrame([(0, 1, [0, 1, 2]), (1, 1, [0, 0, 2])], schema)
    assert ensemble.check_rankings(runs, 3) == 1
    with pytest.raises(PySparkException, match="not a permutation"):
        ensemble.borda(runs).collect()
    # runs of one item that differ in length raise; items may differ among each other
    with pytest.raises(PySparkException, match="differ in their number"):
        ensemble.borda(spark.createDataFrame([(0, 1, [2, 0, 1]), (1, 1, [0, 1])], schema)).collect()
    mixed = spark.createDataFrame([(0, 1, [2, 0, 1]), (1, 1, [2, 1, 0]), (0, 2, [1, 0]), (1, 2, [1, 0]), (0, 3, []), (1, 3, [])], schema)
    assert {r["item_id"]: r["ranks"] for r in ensemble.borda(mixed).collect()} == {1: [2, 1, 0], 2: [1, 0], 3: []}
    with pytest.raises(PySparkException, match="differ in their number"):
        ensemble.mean_logit(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "item_id long, logits array<double>")).collect()
    vocab = spark.createDataFrame([("a b", 0), ("c", 1)], "label string, label_idx long")
    ranked = spark.createDataFrame([(1, [0, 1])], "row_id long, ranks array<int>")
    with pytest.raises(PySparkException, match="contains a space"):
        ranking.submission(ranked, vocab, k=2).collect()
    # D-17 concerns submissions only: a candidate list may hold any label
    assert prepare.attach_all_candidates(ranked, vocab).first()["candidates"] == ["a b", "c"]


def test_aliases_match(spark, sf_dir):
    from rankspark.operators import ranking, score
    from rankspark.sources import fixtures as fx

    items = score.with_quantized(fx.embedding_items(spark, sf_dir))
    heads = score.centroid_heads(items, "q")
    a = sorted(score.int8_score(items, heads).collect())
    b = sorted(score.score_items(items, heads, "q", integer=True).collect())
    assert a == b
    df = spark.createDataFrame([([3.0, 1.0, 3.0],)], "logits array<double>")
    assert df.select(ranking.rank_array("logits").alias("r")).first()["r"] == [0, 2, 1]
    r = fx.responses(spark, sf_dir).limit(5)
    vocab = spark.createDataFrame([("x", 0)], "label string, label_idx long")
    assert prepare.attach_candidates(r, vocab, "all").first()["candidates"] == ["x"]

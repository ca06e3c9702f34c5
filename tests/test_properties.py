"""Property tests (hypothesis) for the invariants in SURVEY section 5."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankspark.functions import arrays as A
from rankspark.operators import ensemble, folds, metrics, profile, ranking
from rankspark.operators.windows import global_row_number, sample_sort

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 8))
def test_sample_sort_equals_global_window(spark, values, ranges):
    # a hot value: a third of the rows share value 0; text keys, some of them null
    rows = [(i, v) for i, v in enumerate(values)] + [(1000 + i, 0) for i in range(len(values) // 2)]
    df = spark.createDataFrame([(i, None if v == 5 else f"k{v}") for i, v in rows], "id long, v string").repartition(3)
    numbered, n = global_row_number(df, ["v", "id"], ranges=ranges)
    got = {r["id"]: r["rn"] for r in numbered.collect()}
    want = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.orderBy(F.asc_nulls_last("v"), "id"))).collect()}
    assert got == want and n == len(rows)


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"))
    sizes = [r["count"] for r in sample_sort(df, ["v", "id"], 10).groupBy("__range").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 3000 and max(sizes) < 600


@SETTINGS
@given(st.lists(st.sampled_from(["a", "b", None, "hot"]), min_size=5, max_size=80), st.integers(2, 6))
def test_stratified_folds_balanced(spark, strata, k):
    rows = [(i, s) for i, s in enumerate(strata)]
    df = spark.createDataFrame(rows, "id long, s string")
    f = folds.stratified_folds(df, "id", "s", k=k, seed=7, ranges=4)
    assert f.count() == len(rows)
    per = f.groupBy("s", "fold").count().collect()
    by_s = {}
    for r in per:
        by_s.setdefault(r["s"], {})[r["fold"]] = r["count"]
    for s, counts in by_s.items():
        n = sum(counts.values())
        sizes = [counts.get(j, 0) for j in range(k)] if n >= k else list(counts.values())
        assert max(sizes) - min(sizes) <= 1
    totals = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(totals) - min(totals) <= 1


@SETTINGS
@given(st.lists(st.lists(st.integers(-5, 5), min_size=4, max_size=4), min_size=1, max_size=20))
def test_array_ranking_is_permutation_and_equals_window(spark, logits):
    rows = [(i, l) for i, l in enumerate(logits)]
    df = spark.createDataFrame(rows, "item_id long, logits array<long>")
    arr = {r["item_id"]: r["ranks"] for r in ranking.rank_candidates(df).collect()}
    for r in arr.values():
        assert sorted(r) == [0, 1, 2, 3]
    long = df.select("item_id", F.posexplode("logits").alias("cand_idx", "logit"))
    w = ranking.rank_long(long, ["item_id"], "cand_idx", "logit").collect()
    from_window = {}
    for r in sorted(w, key=lambda r: (r["item_id"], r["rnk"])):
        from_window.setdefault(r["item_id"], []).append(r["cand_idx"])
    assert arr == from_window


@SETTINGS
@given(st.lists(st.permutations([0, 1, 2, 3, 4]), min_size=2, max_size=5))
def test_borda_independent_of_run_order(spark, perms):
    rows = [(r, 1, list(p)) for r, p in enumerate(perms)]
    rev = [(len(perms) - 1 - r, 1, list(p)) for r, p in enumerate(perms)]
    schema = "run_id long, item_id long, ranks array<int>"
    a = ensemble.borda(spark.createDataFrame(rows, schema)).first()["ranks"]
    b = ensemble.borda(spark.createDataFrame(rev, schema).repartition(3)).first()["ranks"]
    assert a == b
    # brute force
    pts = [0] * 5
    for p in perms:
        for pos, c in enumerate(p):
            pts[c] += 5 - pos
    assert a == sorted(range(5), key=lambda c: (-pts[c], -c))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.permutations([0, 1, 2, 3, 4])), min_size=0, max_size=20))
def test_map_bounds_and_brute_force(spark, cases):
    rows = [(i, y, list(p)) for i, (y, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, "item_id long, y_true long, ranks array<int>")
    m = metrics.map_at_k(df, 3).first()["map"]
    assert 0.0 <= m <= 1.0
    want = [1.0 / (list(p)[:3].index(y) + 1) if y in list(p)[:3] else 0.0 for y, p in cases]
    assert abs(m - (sum(want) / len(want) if want else 0.0)) < 1e-12


def test_results_unchanged_under_repartition(spark):
    rows = [(i, i % 7, f"t{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, n_words long, category string")
    a = sorted(profile.rank_first(df, "n_words").select("row_id", "rnk").collect())
    b = sorted(profile.rank_first(df.repartition(5), "n_words").select("row_id", "rnk").collect())
    assert a == b
    d = profile.length_deciles(df).groupBy("decile").count().collect()
    assert sorted(r["count"] for r in d) == [20] * 10


def test_ap_scaled_is_exact(spark):
    assert A.lcm_upto(3) == 6 and A.lcm_upto(5) == 60


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["q1", "q2"]), st.sampled_from(["A", "B", None]),
                          st.sampled_from(["x", "y", None])), min_size=1, max_size=40))
def test_dedup_with_hot_group_keeps_first(spark, rows):
    from rankspark.operators.prepare import dedup_responses

    # a third of all rows are copies of one key (the hot group)
    hot = [("q1", "A", "same text")] * (len(rows) // 2 + 1)
    data = [(i, *r) for i, r in enumerate(hot + rows)]
    df = spark.createDataFrame(data, "row_id long, question_id string, mc_answer string, explanation string")
    got = sorted(r["row_id"] for r in dedup_responses(df.repartition(4)).collect())
    first = {}
    for rid, q, a, e in data:
        first.setdefault((q, a, e), rid)
    assert got == sorted(first.values())

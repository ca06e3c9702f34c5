"""ML-4, ML-5: the shared head over ragged candidate lists, as a function and as pyspark.ml stages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import conditional, metrics, ranking, score
from rankspark.session import stored

SCHEMA = "item_id long, y_true long, fold int, candidates array<array<double>>"


def _items(n=120, seed=1):
    rng = np.random.default_rng(seed)
    true = np.array([1.5, -2.0, 0.5])
    rows = []
    for i in range(n):
        x = rng.normal(size=(rng.integers(1, 6), 3))
        y = int(np.argmax(x @ true + rng.gumbel(size=len(x))))
        rows.append((i, y, i % 3, x.tolist()))
    return rows


def _objective(rows, w, l2):
    losses = [np.log(np.exp(np.array(x) @ w).sum()) - np.array(x)[y] @ w for _, y, _, x in rows]
    return np.mean(losses) + l2 / 2 * w @ w


def test_newton_finds_the_minimum_over_ragged_lists(spark):
    rows = _items()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fitted = conditional.fit_shared_head(df, l2=0.01)
    assert fitted.history[-1]["gradient"] <= 1e-8 and fitted.b == 0.0
    best = _objective(rows, fitted.w, 0.01)
    assert best == pytest.approx(fitted.history[-1]["objective"], abs=1e-10)
    for move in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert _objective(rows, fitted.w + move, 0.01) > best
    steps = [x["objective"] for x in fitted.history]
    assert steps == sorted(steps, reverse=True)
    again = conditional.fit_shared_head(df, l2=0.01, seed=7)  # convex: another start, the same head
    assert np.allclose(again.w, fitted.w, atol=1e-7)
    assert [r["step"] for r in conditional.history_frame(spark, fitted).collect()] == list(range(len(steps)))


def test_rows_that_cannot_train(spark):
    rows = _items(40)
    odd = [(900, None, 0, [[9.0, 9.0, 9.0]]), (901, 5, 0, [[9.0, 9.0, 9.0]]), (902, -1, 0, [[9.0, 9.0, 9.0]]), (903, 0, 0, None), (904, 0, 0, [])]
    a = conditional.fit_shared_head(spark.createDataFrame(rows, SCHEMA))
    b = conditional.fit_shared_head(spark.createDataFrame(rows + odd, SCHEMA))
    assert np.allclose(a.w, b.w, atol=1e-9)
    with pytest.raises(ValueError, match="no item has a true candidate"):
        conditional.fit_shared_head(spark.createDataFrame(odd, SCHEMA))
    with pytest.raises(ValueError, match="one width"):
        conditional.fit_shared_head(spark.createDataFrame(rows + [(905, 0, 0, [[1.0]])], SCHEMA))


def test_large_scores_do_not_overflow(spark):
    rows = [(i, i % 2, 0, [[1000.0 * (i % 2 == 0) + i, 1.0], [1000.0 * (i % 2), 1.0]]) for i in range(20)]
    fitted = conditional.fit_shared_head(spark.createDataFrame(rows, SCHEMA), l2=1e-3, steps=30)
    assert np.isfinite(fitted.w).all() and fitted.history[-1]["loss"] < 0.1


def test_a_step_that_overshoots_is_halved(spark, monkeypatch):
    rows = _items(60)
    df = spark.createDataFrame(rows, SCHEMA)
    real = np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: (real(*a, **k)[0] * 50, None, None, None))
    fitted = conditional.fit_shared_head(df, l2=0.01, steps=3)
    steps = [x["objective"] for x in fitted.history]
    assert steps == sorted(steps, reverse=True) and steps[-1] < steps[0]


def test_cross_validator_uses_the_fold_column(spark):
    rows = _items(90)
    df = spark.createDataFrame(rows, SCHEMA)
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    model = conditional.cross_validate_grid(df, [0.01, 50.0], 3)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before
    assert len(model.avgMetrics) == 2 and len(model.subModels) == 3
    for f in range(3):
        alone = conditional.fit_shared_head(df.where(F.col("fold") != f), l2=0.01)
        assert np.allclose(model.subModels[f][0].fitted.w, alone.w, atol=1e-7)
    oof = conditional.out_of_fold(df, model, 0)
    assert oof.count() == 90
    per_fold = [r["map"] for r in metrics.map_at_k(oof, 3, by=["fold"]).collect()]
    assert model.avgMetrics[0] == pytest.approx(np.mean(per_fold), abs=1e-12)
    best = model.bestModel.transform(df).where("item_id < 5").collect()
    for r in best:
        z = np.array(r["candidates"]) @ model.bestModel.fitted.w
        assert r["ranks"] == list(np.argsort(-z, kind="stable")) and np.allclose(r["logits"], z)
    assert ranking.rank_candidates(oof.select("item_id", "y_true", "logits")).count() == 90


@pytest.mark.parametrize("numbers", [conditional.MAX_WIDTH, 1])
def test_folds_and_values_share_their_passes(spark, monkeypatch, numbers):
    """The heads of all folds and values step together: passes and stored copies don't grow with folds x values."""
    monkeypatch.setattr(conditional, "PASS_NUMBERS", numbers, raising=False)
    df = spark.createDataFrame(_items(100), SCHEMA).withColumn("fold", (F.col("item_id") % 4).cast("int")).repartition(3)
    grid = [0.01, 2.0, 50.0]
    passes, copies = [], []
    real, keep = conditional._collect_statistics, conditional.stored
    monkeypatch.setattr(conditional, "_collect_statistics", lambda *a: (passes.append(1), real(*a))[1])
    monkeypatch.setattr(conditional, "stored", lambda *a: (copies.append(1), keep(*a))[1])
    model = conditional.cross_validate_grid(df, grid, 4, steps=3, tol=0.0, parallelism=2)
    assert len(copies) == 1
    heads = (4 + 1) * 3 if numbers == 1 else 1  # no room for two heads in a pass: one pass each
    assert len(passes) == (3 + 1) * heads
    monkeypatch.undo()
    for f in range(4):
        for j, l2 in enumerate(grid):
            alone = conditional.fit_shared_head(df.where(F.col("fold") != f), l2=l2, steps=3, tol=0.0)
            got = model.subModels[f][j]
            assert np.allclose(got.fitted.w, alone.w, atol=1e-9) and len(got.fitted.history) == 4
            assert got.getOrDefault("l2") == l2
    best = int(np.argmax(model.avgMetrics))
    assert model.bestModel.getOrDefault("l2") == grid[best]
    assert np.allclose(model.bestModel.fitted.w, conditional.fit_shared_head(df, l2=grid[best], steps=3, tol=0.0).w, atol=1e-9)
    for j in range(3):
        maps = [r["map"] for r in metrics.map_at_k(conditional.out_of_fold(df, model, j), 3, by=["fold"]).collect()]
        assert model.avgMetrics[j] == pytest.approx(np.mean(maps), abs=1e-12) and model.stdMetrics[j] == pytest.approx(np.std(maps), abs=1e-12)


def test_heads_that_stop_or_halve_alone(spark, monkeypatch):
    """Heads in one pass keep their own pace: one is done at once, one overshoots and is halved."""
    rows = _items(60)
    data = conditional.stored(conditional._training(spark.createDataFrame(rows, SCHEMA), "candidates", "y_true", "fold"))
    real = np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: (real(*a, **k)[0] * 50, None, None, None))
    cases = [{"l2": 0.01, "steps": 3, "tol": 1e9}, {"l2": 0.01, "steps": 3, "tol": 0.0, "left_out": 1}]
    stops, halves = conditional._fit_heads(data, cases)
    assert len(stops.history) == 1 and not stops.w.any()
    steps = [x["objective"] for x in halves.history]
    assert len(steps) == 4 and steps == sorted(steps, reverse=True) and steps[-1] < steps[0]
    assert steps[-1] == pytest.approx(_objective([r for r in rows if r[2] != 1], halves.w, 0.01), abs=1e-10)


@pytest.mark.parametrize("fold", [3, -1, None])
def test_folds_out_of_range_raise(spark, fold):
    df = spark.createDataFrame([*_items(12), (900, 0, fold, [[1.0, 0.0, 0.0]])], SCHEMA)
    with pytest.raises(Exception, match="Fold number must be in range"):
        conditional.cross_validate_grid(df, [0.01], 3)


def test_empty_folds_raise(spark):
    df = spark.createDataFrame(_items(12), SCHEMA)
    with pytest.raises(ValueError, match="validation data at fold 3 is empty"):
        conditional.cross_validate_grid(df, [0.01], 4)
    with pytest.raises(ValueError, match="training data at fold 0 is empty"):
        conditional.cross_validate_grid(df.where("fold = 0"), [0.01], 2)


def test_shared_scores_of_odd_lists(spark):
    big = 2**53 + 1
    rows = [(big, None, [[1, 2], [3, 4]]), (None, "a", None), (3, "b", []), (4, "c", [[None, 1]]), (5, "d", [[5, 6], [7, 8], [9, 10]])]
    df = spark.createDataFrame(rows, "item_id long, name string, candidates array<array<bigint>>").coalesce(1)
    got = {r["name"]: r for r in score.shared_head(df, [1.0, 10.0], 0.5).collect()}
    assert got[None]["item_id"] == big and got["a"]["item_id"] is None and got["d"]["candidates"] == [[5, 6], [7, 8], [9, 10]]
    assert [got[x]["logits"] for x in (None, "a", "b", "d")] == [[21.5, 43.5], None, [], [65.5, 87.5, 109.5]]
    assert len(got["c"]["logits"]) == 1 and np.isnan(got["c"]["logits"][0])
    for wrong in ([[1]], [[1, 2], None], [[1, 2, 3, 4]]):
        with pytest.raises(Exception, match="width"):
            score.shared_head(spark.createDataFrame([(1, "a", wrong)], df.schema), [1.0, 10.0], 0.5).collect()


def test_stored_by_a_column_reads_its_folders_only(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "fold int, name string")
    kept = stored(df, "by-fold", "fold")
    assert kept.schema == df.schema and sorted(kept.collect(), key=str) == sorted(df.collect(), key=str)
    assert len(kept.inputFiles()) > 1 and "PartitionFilters: [isnotnull(fold" in kept.where("fold = 2")._jdf.queryExecution().toString()

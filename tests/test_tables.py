"""Sketches that merge, tables bucketed alike, streams that write once and wait for all runs."""

from __future__ import annotations

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from rankspark.operators import ensemble, folds, profile, sketches
from rankspark.sources import fixtures as fx
from rankspark.sources import io
from rankspark.streaming import exactly_once, runs


def test_merged_sketches_keep_their_rank_error(spark, scratch):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, int(rng.lognormvariate(5, 1))])) for i in range(30_000)]
    df = spark.createDataFrame(rows, "i long, k string, v long")
    path = os.path.join(scratch, "sk")
    for batch in range(6):
        sketches.write_sketches(sketches.sketch_by(df.where(F.col("i") % 6 == batch), "k", "v"), path, str(batch))
    sketches.write_sketches(sketches.sketch_by(df.where("i % 6 = 2"), "k", "v"), path, "2")  # again: replaced
    merged = sketches.read_sketches(spark, path, "k")
    got = {r["k"]: r for r in sketches.describe(merged, "k").collect()}
    exact = {r["k"]: r for r in profile.describe_by(df, "k", "v").collect()}
    assert set(got) == set(exact) == {"a", "b"}
    for k, e in exact.items():
        assert (got[k]["count"], got[k]["min"], got[k]["max"]) == (e["count"], e["min"], e["max"])
        assert got[k]["mean"] == pytest.approx(e["mean"], rel=1e-12) and got[k]["std"] == pytest.approx(e["std"], rel=1e-9)
    errors = sketches.measured_rank_error(df, sketches.describe(merged, "k"), "k", "v").collect()
    assert len(errors) == 2 and all(r["rank_error"] <= 2 * sketches.rank_error() for r in errors)
    box, want = ({r["k"]: r for r in t.collect()} for t in (sketches.boxplot(merged, "k"), profile.boxplot_by(df, "k", "v")))
    for k in want:
        assert box[k]["med"] == pytest.approx(want[k]["med"], rel=0.1) and box[k]["whishi"] == pytest.approx(want[k]["whishi"], rel=0.2)
        assert box[k]["whislo"] <= box[k]["q1"] <= box[k]["med"] <= box[k]["q3"] <= box[k]["whishi"]


def test_sketches_of_little_data(spark):
    df = spark.createDataFrame([("one", 5.0), ("none", None), (None, 1.0), ("two", 1.0), ("two", 3.0)], "k string, v double")
    got = {r["k"]: r for r in sketches.describe(sketches.sketch_by(df, "k", "v"), "k").collect()}
    assert (got["one"]["q50"], got["one"]["std"], got["one"]["count"]) == (5.0, None, 1)
    assert (got["none"]["count"], got["none"]["q50"], got["none"]["mean"]) == (0, None, None)
    assert got["two"]["mean"] == 2.0 and set(got) == {"one", "none", "two"}
    assert sketches.sketch_by(df.where("false"), "k", "v").collect() == []


def test_bucketed_tables_join_without_an_exchange(spark, scratch, sf_dir):
    rows = fx.responses(spark, sf_dir).select("row_id", "category", "question_id")
    names = [f"t_{uuid.uuid4().hex}" for _ in range(4)]
    clean = io.write_bucketed(rows, names[0], os.path.join(scratch, "clean"), buckets=8)
    assigned = folds.stratified_folds(rows.select("row_id", "category"), "row_id", "category", 3)
    kept = io.write_bucketed(assigned.select("row_id", "fold"), names[1], os.path.join(scratch, "folds"), buckets=8)
    truth = io.write_bucketed(rows.select("row_id", (F.col("row_id") % 4).alias("label_idx")), names[2], os.path.join(scratch, "truth"), buckets=8)
    preds = io.write_bucketed(rows.where("row_id % 5 > 0").select("row_id", F.array(F.col("row_id") % 4).alias("ranks")), names[3], os.path.join(scratch, "preds"), buckets=8)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (folds.attach_folds(clean, kept, "row_id"), truth.join(preds, "row_id", "left_anti"), truth.join(preds, "row_id")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "hashpartitioning(row_id" not in plan
        with_fold = folds.attach_folds(clean, kept, "row_id")
        assert with_fold.count() == rows.count() and set(with_fold.columns) == {"row_id", "category", "question_id", "fold"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for n in names:
            spark.sql(f"DROP TABLE {n}")


def _by_length(items):
    return items.withColumn("logits", F.transform("suffixes", lambda s: F.length(s).cast("double")))


def test_a_failed_batch_doubles_nothing_and_loses_no_bad_line(spark, scratch, monkeypatch):
    folder = {n: os.path.join(scratch, n) for n in ("in", "out", "bad", "ck")}
    os.makedirs(folder["in"])
    for f in range(3):
        with open(os.path.join(folder["in"], f"{f}.json"), "w", encoding="utf-8") as out:
            for i in range(4):
                out.write(json.dumps({"row_id": 10 * f + i, "bundle": {"QuestionText": "q"}, "suffixes": ["a", "bb"[: 1 + i % 2] * 2]}) + "\n")
            out.write('{"row_id": %d, "suffixes": "broken\n' % f)
            out.write(json.dumps({"row_id": None, "suffixes": ["x"]}) + "\n" + json.dumps({"row_id": 99, "suffixes": []}) + "\n")
    real, calls = exactly_once.write_batch, []

    def fails_once(rows, path, batch_id):
        calls.append((path, batch_id))
        if path == folder["bad"] and batch_id == 1 and calls.count((path, 1)) == 1:
            raise RuntimeError("disk is gone")  # the rankings of batch 1 are written already
        real(rows, path, batch_id)

    monkeypatch.setattr(exactly_once, "write_batch", fails_once)

    def run():
        q = exactly_once.stream_items_once(spark, folder["in"], folder["out"], folder["bad"], folder["ck"], _by_length, max_files_per_trigger=1)
        q.awaitTermination(120)

    with pytest.raises(Exception, match="disk is gone"):
        run()
    run()
    run()  # nothing new: nothing written
    got = sorted((r["row_id"], r["ranks"]) for r in spark.read.json(folder["out"]).collect())
    assert [r for r, _ in got] == [10 * f + i for f in range(3) for i in range(4)] and got[0][1] == [1, 0]
    bad = spark.read.json(folder["bad"]).collect()
    assert sorted(r["reason"] for r in bad) == ["no candidates"] * 3 + ["no row_id"] * 3 + ["not an item"] * 3
    assert len({r["file"] for r in bad}) == 3 and any('"broken' in r["line"] for r in bad)


@pytest.fixture()
def no_empty_batches(spark):
    """Expiry makes every moment worth a batch; a run over what is there must end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, was)


SCHEMA = "run_id long, item_id long, ranks array<int>"


def _put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.writelines(json.dumps(dict(zip(("run_id", "item_id", "ranks"), r, strict=True))) + "\n" for r in rows)


def _drain(spark, scratch, expire_ms, n_runs=3):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(os.path.join(scratch, "in"))
    q = runs.ensemble_stream(stream, n_runs, expire_ms).writeStream.format("json").option("checkpointLocation", os.path.join(scratch, "ck"))
    q.trigger(availableNow=True).start(os.path.join(scratch, "out")).awaitTermination(60)
    return spark.read.schema(runs.OUT).json(os.path.join(scratch, "out")).collect()


def test_streamed_ensemble_equals_batch_with_late_and_repeated_runs(spark, scratch, no_empty_batches):
    rng = random.Random(2)
    rows = [(run, item, rng.sample(range(4), 4)) for run in range(3) for item in range(6)]
    late = [r for r in rows if r[:2] == (2, 5)]
    early = [r for r in rows if r not in late]
    rng.shuffle(early)
    _put(os.path.join(scratch, "in"), "0.json", early[:8] + early[:2])
    _put(os.path.join(scratch, "in"), "1.json", early[8:] + early[:3] + [(0, None, [0]), (None, 1, [0])])
    first = _drain(spark, scratch, 3_600_000)
    assert sorted(r["item_id"] for r in first) == [0, 1, 2, 3, 4] and all(r["complete"] for r in first)
    _put(os.path.join(scratch, "in"), "2.json", late + early[:5])
    got = _drain(spark, scratch, 3_600_000)
    batch = ensemble.borda(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["item_id"], r["ranks"]) for r in got) == sorted((r["item_id"], r["ranks"]) for r in batch.collect())


def test_incomplete_items_expire(spark, scratch, no_empty_batches):
    _put(os.path.join(scratch, "in"), "0.json", [(0, 1, [0, 1]), (2, 1, [1, 0]), (0, 2, [0, 1])])
    _drain(spark, scratch, 1)
    for i in range(2):
        _put(os.path.join(scratch, "in"), f"{i + 1}.json", [(0, 100 + i, [0, 1])])
        got = _drain(spark, scratch, 1)
    said = {r["item_id"]: (r["complete"], r["n_runs"], r["runs"], r["ranks"]) for r in got}
    assert said[1] == (False, 2, "0 2", None) and said[2] == (False, 1, "0", None)

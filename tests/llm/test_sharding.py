"""The hash tree: laws of movement, weights, gapless slots, awkward rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankspark.llm import sharding
from rankspark.llm.sharding import Leaf, place, shard_rows, tree_of

from . import helpers as h


def _placed(spark, tree, n=4000):
    return {r["id"]: r["shard"] for r in place(spark.range(n), F.col("id"), tree).collect()}


@pytest.mark.parametrize("shards", [8, 9, 12])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    was, now = _placed(spark, tree_of(shards)), _placed(spark, tree_of(shards + 1))
    moved = [k for k in was if was[k] != now[k]]
    assert moved and {now[k] for k in moved} == {shards}
    assert len(moved) == pytest.approx(4000 / (shards + 1), rel=0.25)


def test_rows_follow_the_weights(spark):
    tree = [Leaf("a", "x", 0, 1.0), Leaf("a", "x", 1, 3.0), Leaf("a", "y", 2, 2.0), Leaf("b", "x", 3, 4.0), Leaf("b", "z", 4, 0.0)]
    got = Counter(_placed(spark, tree, 20_000).values())
    assert 4 not in got
    for s, w in ((0, 1), (1, 3), (2, 2), (3, 4)):
        assert got[s] == pytest.approx(20_000 * w / 10, rel=0.08)


def test_movement_stays_in_the_subtrees_whose_weight_changed(spark):
    def tree(w):
        return [Leaf(r, k, i * 4 + j * 2 + n, w if (r, k, n) == ("b", "x", 0) else 1.0) for i, r in enumerate("abc") for j, k in enumerate("xy") for n in range(2)]

    was, now = _placed(spark, tree(1.0)), _placed(spark, tree(2.0))
    for k in was:
        old, new = (was[k] // 4, was[k] // 2, was[k]), (now[k] // 4, now[k] // 2, now[k])
        if old[0] != new[0]:
            assert new[0] == 1  # only into the region that grew
        elif old[1] != new[1]:
            assert new[1] == 2  # inside it only into the rack that grew
        elif old != new:
            assert new[2] == 4  # inside that only into the shard that grew
    assert any(was[k] != now[k] for k in was)


def test_shards_cannot_all_be_empty(spark):
    with pytest.raises(ValueError, match="weight above 0"):
        place(spark.range(1), F.col("id"), [Leaf("a", "x", 0, 0.0)])
    with pytest.raises(ValueError, match="negative"):
        place(spark.range(1), F.col("id"), [Leaf("a", "x", 0, -1.0)])


@pytest.mark.parametrize("bucket,chunk", [(200_000, 100_000), (3, 2)])
def test_contract_on_awkward_rows(spark, monkeypatch, bucket, chunk):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(sharding, "COPIES_PER_CHUNK", chunk)
    rows = h.corpus(21) + [(7, "same", "en")] * 25 + [(None, None, None)] * 9
    out = shard_rows(h.table(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in out) == want
    slots = defaultdict(list)
    by_id = defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in by_id.values())  # doc_id and the number of shards decide
    again = shard_rows(h.table(spark, rows, parts=7)).collect()
    assert sorted(again, key=repr) == sorted(out, key=repr)


def test_buckets_do_not_change_slots(spark, monkeypatch):
    docs = h.table(spark, h.corpus(22))
    one = sorted(shard_rows(docs).collect(), key=repr)
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    assert sorted(shard_rows(docs).collect(), key=repr) == one


def test_empty_table_and_columns(spark):
    out = shard_rows(h.table(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_no_python_and_one_read_of_the_text(spark):
    placed = place(h.table(spark, h.corpus(3)).select("doc_id"), F.col("doc_id"), tree_of(8))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_equal_texts_together_by_a_key_of_the_text(spark, scratch):
    docs = h.table(spark, h.corpus(23))
    sharding.write_shards(docs, f"{scratch}/shards", tree_of(8), F.sha2("text", 256))
    back = spark.read.parquet(f"{scratch}/shards")
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, docs.collect()))

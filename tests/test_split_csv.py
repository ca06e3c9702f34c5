"""IO-1, PF-10: many tasks per CSV file, equal to Spark's single-task reader; stable keys."""

from __future__ import annotations

import os
import random

import pytest

from rankspark.operators import joins
from rankspark.sources import io, split_csv


@pytest.fixture()
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def _single(spark, path):
    return spark.read.options(header="true", multiLine="true", escape='"', quote='"').csv(path)


def _closed(body):
    rule, inside = split_csv._Quoting(","), False
    for line in body.split("\n"):
        inside = rule.after(line, inside)
    return body + ('"\n' if inside else "\n")


AWKWARD = ["a", "b b", ",", "\n", "\n\n", '"p ""q"" r"', '"x,\n\ny"', ',"z\n"', "\nnew", ' "', 'c"d', '"",', '"\n\n\n"', ' "e" ', "é　"]


@pytest.mark.parametrize("seed,local", [(0, True), (1, True), (2, True), (3, False)])
def test_many_blocks_equal_the_single_task_reader(spark, scratch, small_blocks, monkeypatch, seed, local):
    if not local:
        monkeypatch.setattr(split_csv, "small_copy", lambda df: None)
    rng = random.Random(seed)
    path = os.path.join(scratch, "a.csv")
    body = _closed("".join(rng.choice(AWKWARD) for _ in range(250)))
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("c1,c2,c3\n" + body)
    got = split_csv.read_csv(spark, path, key="k")
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    rows = sorted(got.collect(), key=lambda r: r["k"])
    assert [r["k"] for r in rows] == list(range(len(rows)))
    assert [tuple(r)[1:] for r in rows] == [tuple(r) for r in _single(spark, path).collect()]


def test_a_record_over_many_blocks(spark, scratch, small_blocks):
    path = os.path.join(scratch, "long.csv")
    text = "\n".join(f"line {i}, with ""quotes""" for i in range(200))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'k,t\n1,"{text}"\n2,"{text}"\n3,x\n')
    rows = {r["k"]: r["t"] for r in split_csv.read_csv(spark, path).collect()}
    assert rows == {"1": text, "2": text, "3": "x"}


def test_keys_do_not_depend_on_blocks_and_follow_the_files(spark, scratch, small_blocks):
    rng = random.Random(3)
    os.makedirs(os.path.join(scratch, "in"))
    for name, n in (("b.csv", 7), ("a.csv", 12), ("c.csv", 0), ("d.csv", 3)):
        with open(os.path.join(scratch, "in", name), "w", encoding="utf-8") as f:
            f.write("who,t\r\n" if name == "b.csv" else "who,t\n")
            for i in range(n):
                f.write(f'{name}{i},"{"l" * rng.randint(0, 30)}\n,""x"""' + ("\r\n" if name == "b.csv" else "\n"))
    reads = []
    for size in ("25", "60", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        reads.append({r["row_id"]: (r["who"], r["t"]) for r in io.read_responses(spark, os.path.join(scratch, "in")).collect()})
    assert reads[0] == reads[1] == reads[2]
    assert [reads[0][i][0] for i in range(22)] == [f"a.csv{i}" for i in range(12)] + [f"b.csv{i}" for i in range(7)] + [f"d.csv{i}" for i in range(3)]


def test_types_header_only_and_own_key(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("row_id,n\n5,1\n7,\n")
    got = io.read_responses(spark, path, schema="row_id string, n int")
    assert sorted(map(tuple, got.collect())) == [(5, 1), (7, None)] and dict(got.dtypes) == {"row_id": "bigint", "n": "int"}
    with open(path, "w", encoding="utf-8") as f:
        f.write("a,b\n")
    empty = io.read_responses(spark, path)
    assert empty.columns == ["row_id", "a", "b"] and empty.collect() == []


def test_written_responses_come_back(spark, scratch):
    rows = [(3, "q", None, 'a "quote", and\nbreak', ""), (1, None, " lead", "x", "trail "), (2, "NA", "", "\n", '"')]
    df = spark.createDataFrame(rows, "row_id long, question_id string, mc_answer string, explanation string, category string")
    io.write_responses(df, os.path.join(scratch, "out"))
    back = io.read_responses(spark, os.path.join(scratch, "out"), missing_tokens=False)
    want = [tuple(None if x == "" else x for x in r) for r in rows]  # an empty field is null
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(want)
    assert joins.small_copy(back) is not None

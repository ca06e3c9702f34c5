"""The registered queries against their DuckDB SQL, and the pipeline against its parts."""

from __future__ import annotations

import pytest

import corpus_pipeline
from rankspark.llm import decontaminate, language
from rankspark.llm.queries import QUERIES, SQL
from rankspark.plans.compare import compare, duckdb_connection

from . import helpers as h


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    result = compare(spark, duckdb_connection(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert result["ok"], result


def test_a_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    known = {r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and r.background <= 0.5}
    assert len(known) >= 0.98 * len(rows)
    rows = [r for r in rows if r[0] in known]
    rows = [r for r, g in zip(rows, h.exact_groups(rows), strict=True) if g[3]]
    rows = [r for r, g in zip(rows, h.near_groups(rows), strict=True) if g[3]]
    items = [decontaminate.normal_text(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(decontaminate.Myers(x).best(decontaminate.normal_text(r[1]))[0] <= len(x) // 20 for x in items)]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r[0] for r in rows)
    assert all(r.round_trip for r in got.select("round_trip").collect())


def test_stages_keep_the_columns(spark):
    rows = h.corpus(15)
    docs = h.table(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == h.table(spark, []).columns
    empty = h.table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").collect() == []

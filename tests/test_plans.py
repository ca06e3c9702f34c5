"""Plan audit: no single-partition exchange over fact-size input.

Every ``Exchange SinglePartition`` in a registered query must sit on an aggregate (vocabulary,
stratum sizes, coarse-bucket sums) or a projection of one. Nothing is cached, so a cached fact
table cannot hide behind one.
"""

from __future__ import annotations

import pytest

from rankspark.plans.catalog import load_all

REG = load_all()
SMALL_INPUTS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate")


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.bench))
def test_single_partition_only_over_small_tables(spark, sf_dir, name):
    df = REG[name].build(spark, sf_dir)
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = [x for x in lines[i + 1: i + 4] if "Project" not in x and "WholeStageCodegen" not in x]
            child = below[0] if below else ""
            assert any(s in child for s in SMALL_INPUTS), f"{name}: {line.strip()} over {child.strip()}"
    assert "InMemoryTableScan" not in "\n".join(lines)


def test_scans_prune_columns(spark, sf_dir):
    # a 2-column projection over documents must not read the text column
    df = REG["responses_per_question"].build(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "documents.parquet" in line]
    assert scan and all("text" not in s.split("ReadSchema:")[-1] for s in scan)

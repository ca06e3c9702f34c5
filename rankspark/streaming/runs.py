"""JN-6, AG-20 on streams: rankings of several runs arrive in any order; an item's ensemble goes out
once all its runs have come.

Keyed state per item holds the ranking of every run seen so far. The last missing run triggers the
Borda count and empties the state but for a mark, so repeated rankings change nothing. State that
stays incomplete expires, with a row that says which runs had come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rankings out: complete with ``ranks``, or expired with the runs that had come.
OUT = "item_id long, complete boolean, n_runs int, runs string, ranks array<int>"
#: State of an item: its rankings by run as JSON, and whether its ensemble has gone out.
STATE = "seen string, done boolean"


def borda_of(rankings: list[list[int]]) -> list[int]:
    """AG-20 for one item: points by place summed over runs, ties to the higher candidate (D-5)."""
    k = len(rankings[0])
    if any(sorted(r) != list(range(k)) for r in rankings):
        raise ValueError("a ranking is no permutation, or runs differ in their candidates")
    points = [0] * k
    for ranks in rankings:
        for place, candidate in enumerate(ranks):
            points[candidate] += k - place
    return sorted(range(k), key=lambda c: (-points[c], -c))


def collector(n_runs: int, expire_ms: int):
    """The state function of one item; see ``ensemble_stream``."""

    def row(item: int, runs: dict, complete: bool) -> pd.DataFrame:
        ranks = borda_of([runs[r] for r in sorted(runs)]) if complete else None
        return pd.DataFrame({"item_id": [item], "complete": [complete], "n_runs": [len(runs)], "runs": [" ".join(sorted(runs))], "ranks": [ranks]})

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else ("{}", False)
        runs = json.loads(seen)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(key[0], runs, False)
            return
        for pdf in batches:
            for run, ranks in zip(pdf["run_id"], pdf["ranks"], strict=True):
                if not done:
                    runs.setdefault(str(run), [int(x) for x in ranks])  # a run's first ranking counts
        if done:
            return
        complete = len(runs) >= n_runs
        state.update(("{}" if complete else json.dumps(runs), complete))
        state.setTimeoutDuration(expire_ms)
        if complete:
            yield row(key[0], runs, True)

    return collect


def ensemble_stream(runs: DataFrame, n_runs: int, expire_ms: int = 3_600_000) -> DataFrame:
    """item_id, complete, n_runs, runs, ranks of a stream of (run_id, item_id, ranks).

    An item waits ``expire_ms`` after its last new run; then it goes out incomplete, without ranks.
    The mark of a complete item is kept as long, and repeated rankings within that time change
    nothing. Rows without an item, run or ranking are left out. Expiry is checked by every batch, so run
    it with a processing-time trigger; a run over what is there (``availableNow``) ends only without
    empty batches (``spark.sql.streaming.noDataMicroBatches.enabled``)."""
    rows = runs.where("item_id IS NOT NULL AND run_id IS NOT NULL AND ranks IS NOT NULL").selectExpr("CAST(item_id AS LONG) AS item_id", "CAST(run_id AS STRING) AS run_id", "CAST(ranks AS ARRAY<INT>) AS ranks")
    return rows.groupBy("item_id").applyInPandasWithState(collector(n_runs, expire_ms), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

"""SC-8, ML-6, AG-18: trial draws, hyper-parameter search, best trial.

Trials are drawn up front from seeded hashes of the trial number (no sampler state). Where the
objective is a Spark expression, all trials are scored in one job. A user's Python objective runs on
the executors: as a mergeable state over a table that is read once for all trials (``search_over``),
or as a plain function of the parameters (``search``). The best trial is an aggregate.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators.joins import collect_small
from rankspark.session import stored


@dataclass(frozen=True)
class Param:
    name: str
    kind: str  # "log", "uniform" or "int"
    lo: float
    hi: float


def _unit(seed: int, name: str, trial: Column) -> Column:
    """Seeded uniform number in [0, 1) from md5 of ``seed:name:trial`` (13 hex digits)."""
    h = F.md5(F.concat(F.lit(f"{seed}:{name}:"), trial.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def draw(p: Param, u: Column) -> Column:
    """SC-8: log-uniform, uniform or integer draw from a unit number."""
    if p.kind == "log":
        lo, hi = math.log(p.lo), math.log(p.hi)
        return F.exp(F.lit(lo) + u * (hi - lo))
    if p.kind == "uniform":
        return F.lit(p.lo) + u * (p.hi - p.lo)
    if p.kind == "int":
        return (F.lit(int(p.lo)) + F.floor(u * (int(p.hi) - int(p.lo) + 1))).cast("long")
    raise ValueError(p.kind)


def trial_grid(spark: SparkSession, space: list[Param], n: int, seed: int = 0) -> DataFrame:
    """SC-8: ``n`` trials with one column per parameter."""
    t = spark.range(n).select(F.col("id").alias("trial"))
    return t.select("trial", *[draw(p, _unit(seed, p.name, F.col("trial"))).alias(p.name) for p in space])


def score_trials(cases: DataFrame, trials: DataFrame, metric: Callable[[DataFrame, Sequence[str]], DataFrame],
                 score_col: str, trial_col: str = "trial") -> DataFrame:
    """ML-6 as one Spark job: ``cases`` hold every evaluated case under every trial (a ``trial``
    column), ``metric(cases, [trial])`` scores them per trial, and the scores join the draws."""
    scored = metric(cases, [trial_col]).select(trial_col, F.col(score_col).alias("score"))
    return trials.join(scored, trial_col, "left")


def search(spark: SparkSession, trials: DataFrame, objective: Callable[[dict], float | None],
           max_parallel: int | None = None) -> DataFrame:
    """UF-3 for objectives that read no table: ``objective(params) -> score`` runs on the executors, one
    trial at a time in up to ``max_parallel`` tasks.

    A trial that raises has a null score and its error text; if all raise, so does the search."""

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            results = [_tried(lambda p=p: objective(p)) for p in pdf.to_dict("records")]
            out["score"] = pd.array([r for r, _ in results], "Float64")
            out["error"] = [e for _, e in results]
            yield out

    dealt = trials.repartition(max_parallel or max(1, trials.count()), "trial")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.schema.fields)
    return _checked(dealt.mapInPandas(run, f"{schema}, score double, error string"))


class MergeObjective:
    """UF-3 over a table: a trial's score from a state that grows row by row and merges.

    ``add`` gets a batch of rows as a pandas frame. States must not depend on the order in which
    rows come or states merge; they travel pickled, one per trial and task."""

    def zero(self, params: dict):
        raise NotImplementedError

    def add(self, state, rows: pd.DataFrame, params: dict):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def score(self, state, params: dict) -> float | None:
        raise NotImplementedError


#: Trials whose states one pass may hold per task.
MAX_TRIALS = 10_000
_STATE = "trial long, part int, state binary, error string"


def search_over(items: DataFrame, trials: DataFrame, objective: MergeObjective, trial_col: str = "trial") -> DataFrame:
    """UF-3: score every trial over all rows of ``items`` in one pass.

    Each task keeps a state per trial and hands it on once; states merge in two levels, so no task
    gets those of all tasks. The driver runs no trial: it only reads the trial table (``MAX_TRIALS``).
    A trial that raises anywhere has a null score and the first error's text and costs the others
    nothing; if all raise, so does the search. Without rows a trial is scored on its zero state."""
    spark = items.sparkSession
    params = {r[trial_col]: r.asDict() for r in collect_small(trials, MAX_TRIALS, "trial table")}
    parts = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions", "200")) ** 0.5))
    dump, load = cloudpickle.dumps, cloudpickle.loads

    def frame(rows):
        return pd.DataFrame(rows, columns=["trial", "part", "state", "error"])

    def zeros(batches):
        for pdf in batches:
            made = [(t, *_tried(lambda t=t: dump(objective.zero(params[t])), bytes)) for t in pdf["trial"].tolist()]
            yield frame([(t, 0, s, e) for t, s, e in made])

    def grow(batches):
        states = {t: _tried(lambda p=p: objective.zero(p), None) for t, p in params.items()}
        for pdf in batches:
            for t, (state, error) in states.items():
                if error is None:
                    states[t] = _tried(lambda s=state, t=t: objective.add(s, pdf, params[t]), None)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % parts
        yield frame([(t, part, None if e else dump(s), e) for t, (s, e) in states.items()])

    def merged(pdf):
        errors = sorted(e for e in pdf["error"] if e is not None)
        if errors:
            return None, errors[0]
        return _tried(lambda: functools.reduce(objective.merge, [load(s) for s in pdf["state"]]), None)

    def combine(pdf):
        state, error = merged(pdf)
        return frame([(pdf["trial"].iloc[0], pdf["part"].iloc[0], None if error else dump(state), error)])

    def finish(pdf):
        state, error = merged(pdf)
        trial, value = pdf["trial"].iloc[0], None
        if error is None:
            value, error = _tried(lambda: objective.score(state, params[trial]))
        return pd.DataFrame({"trial": [trial], "score": pd.array([value], "Float64"), "error": [error]})

    states = items.mapInPandas(grow, _STATE).unionByName(trials.select(F.col(trial_col).cast("long").alias("trial")).mapInPandas(zeros, _STATE))
    states = states.groupBy("trial", "part").applyInPandas(combine, _STATE)
    scored = states.groupBy("trial").applyInPandas(finish, "trial long, score double, error string")
    return _checked(trials.join(scored.withColumnRenamed("trial", trial_col), trial_col, "left"))


def _tried(call: Callable, kind: Callable | None = float):
    """(result, None), or (None, the error's text): a failed trial is reported, not fatal."""
    try:
        result = call()
        return (result if kind is None or result is None else kind(result)), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"[:1000]


def _checked(results: DataFrame) -> DataFrame:
    """The results, stored; raises if there are trials and all have failed."""
    results = stored(results, "trials")
    n, failed, error = results.agg(F.count(F.lit(1)), F.count("error"), F.min("error")).first()
    if n and n == failed:
        raise RuntimeError(f"every trial failed; one of the errors: {error}")
    return results


def best_trial(results: DataFrame, params: list[str], trial_col: str = "trial", score_col: str = "score") -> DataFrame:
    """AG-18: argmax of the score (missing = 0); ties go to the earlier trial."""
    key = F.struct(F.coalesce(F.col(score_col), F.lit(0.0)).alias("s"), (-F.col(trial_col)).alias("t"))
    best = results.agg(
        F.max_by(F.struct(trial_col, *params), key).alias("best"),
        F.max(F.coalesce(F.col(score_col), F.lit(0.0))).alias("best_value"),
    )
    return best.select(*[F.col(f"best.{c}").alias(c) for c in [trial_col, *params]], "best_value")

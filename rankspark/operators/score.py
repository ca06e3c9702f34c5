"""ML-1..3: centroid heads, float and INT8 scoring, user-supplied scorers.

Scoring an item needs every head of every run. Heads are a small model (runs x classes x
dim numbers); they are computed by Spark, their size is checked, and shipped once to the
tasks (a broadcast variable). Items are never joined against a head table (that would be
a cross product).

Dense dot products are the one place where Spark's built-in expressions are the slow
path: ``aggregate(zip_with(...))`` is a higher-order function and runs interpreted. A
``mapInPandas`` scorer does one batched matrix product per Arrow batch instead; on 200k
vectors x 30 heads x 64 dims it is about 12x faster with identical integer results, so it
is the default (``engine="arrow"``). ``engine="expr"`` keeps the pure-expression form
(heads inlined as a literal), e.g. for streams without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.arrays import dot, max_abs, quantize
from rankspark.operators.joins import TooLarge, share
from rankspark.session import stored

# The expression engine inlines heads as a literal; above this many numbers it is refused.
LITERAL_MAX_WEIGHTS = 50_000
# Hard bound on a head matrix brought to the driver at all.
HEAD_MAX_WEIGHTS = 50_000_000


def fold_of(id_col: str, n_folds: int) -> Column:
    """Fold of an item by its id (leave-one-fold-out runs)."""
    return (F.col(id_col) % n_folds).cast("long")


def with_quantized(items: DataFrame, vec_col: str = "embedding", levels: int = 127, out: str = "q") -> DataFrame:
    """ML-2: per-vector absmax quantisation to integers in [-levels, levels]."""
    with_scale = items.withColumn("__scale", max_abs(vec_col))
    return with_scale.withColumn(out, quantize(vec_col, levels, "__scale")).drop("__scale")


def centroid_heads(items: DataFrame, vec_col: str, label_col: str = "label", id_col: str = "vec_id",
                   n_runs: int = 3, integer: bool = True) -> DataFrame:
    """Per-run class centroids over the run's training items (``id % n_runs != run``).

    Sums and counts are taken once per (fold, class, dimension); a run's head is the total less
    its own fold. Integer heads: ``floor(sum(q) / count)`` (exact); float heads: the average.
    Returns ``run_id, label, w`` (array). The exploded (item, dimension) rows are combined
    map-side; only folds x classes x dimensions partial sums are shuffled.
    """
    dims = items.select(fold_of(id_col, n_runs).alias("fold"), label_col, F.posexplode(vec_col).alias("d", "v"))
    value = F.col("v").cast("long" if integer else "double")
    sums = dims.groupBy("fold", label_col, "d").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    folds = F.collect_list(F.struct("fold", "s", "n"))  # one entry per fold
    per = sums.groupBy(label_col, "d").agg(folds.alias("folds"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_runs - 1).cast("long")))
    per = per.select(label_col, "d", "folds", run.alias("run_id"))
    others = F.filter("folds", lambda f: ~f["fold"].eqNullSafe(F.col("run_id")))
    zero = F.lit(0).cast("long" if integer else "double")
    total = F.aggregate(others, zero, lambda a, f: a + f["s"])
    count = F.aggregate(others, F.lit(0).cast("long"), lambda a, f: a + f["n"])
    w = per.where(F.size(others) > 0).select("run_id", label_col, "d", (total.cast("double") / count).alias("w"))
    if integer:
        w = w.withColumn("w", F.floor("w").cast("long"))
    return w.groupBy("run_id", label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda s: s["w"]).alias("w")
    )


def head_matrix(heads: DataFrame, label_col: str = "label") -> tuple[list[int], list, np.ndarray]:
    """Collect heads (size checked) as (run ids, class labels, array [runs, classes, dim]).

    The heads are computed once and stored; rows and width are measured before anything is fetched."""
    heads = stored(heads, "heads")
    n, width = heads.agg(F.count(F.lit(1)), F.max(F.size("w"))).first()
    if n * (width or 0) > HEAD_MAX_WEIGHTS:
        raise TooLarge(f"a head matrix of {n} x {width} exceeds the driver bound")
    rows = heads.collect()
    runs = sorted({r["run_id"] for r in rows})
    classes = sorted({r[label_col] for r in rows})
    dim = len(rows[0]["w"]) if rows else 0
    m = np.zeros((len(runs), len(classes), dim), dtype=object)
    ri = {r: i for i, r in enumerate(runs)}
    ci = {c: i for i, c in enumerate(classes)}
    for r in rows:
        m[ri[r["run_id"]], ci[r[label_col]]] = list(r["w"])
    return runs, classes, m


def _sql_number(x, integer: bool) -> str:
    if integer:
        return f"{int(x)}L"
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return f"CAST('{x}' AS DOUBLE)"
    return f"{x!r}D"


def _literal_heads(runs, m: np.ndarray, integer: bool) -> Column:
    """One SQL literal for all heads: array(struct(run_id, heads array<array<num>>)).

    Built as a single expression string so plan construction is one call, whatever the
    number of weights (within ``LITERAL_MAX_WEIGHTS``).
    """
    per_run = []
    for i, run in enumerate(runs):
        classes = ", ".join(
            "array(" + ", ".join(_sql_number(x, integer) for x in m[i, c]) + ")" for c in range(m.shape[1])
        )
        per_run.append(f"named_struct('run_id', {int(run)}L, 'heads', array({classes}))")
    return F.expr("array(" + ", ".join(per_run) + ")")


def score_items(items: DataFrame, heads: DataFrame, vec_col: str, id_col: str = "vec_id",
                label_col: str = "label", integer: bool = True, held_out_only: bool = False,
                n_runs: int | None = None, engine: str = "arrow") -> DataFrame:
    """Logits of every item under every run's heads (see ``score_items_k``)."""
    return score_items_k(items, heads, vec_col, id_col, label_col, integer, held_out_only, n_runs, engine)[0]


def score_items_k(items: DataFrame, heads: DataFrame, vec_col: str, id_col: str = "vec_id",
                  label_col: str = "label", integer: bool = True, held_out_only: bool = False,
                  n_runs: int | None = None, engine: str = "arrow") -> tuple[DataFrame, int]:
    """Logits of every item under every run's heads: ``run_id, item_id, y_true, logits``.

    ``logits[c]`` belongs to the c-th class in sorted order; ``y_true`` is the item's
    class position. ``held_out_only`` keeps, per item, only the run whose fold it is
    (out-of-fold scoring for cross-validation).
    """
    runs, classes, m = head_matrix(heads, label_col)
    if engine == "arrow":
        return _score_items_arrow(items, runs, classes, m, vec_col, id_col, label_col, integer,
                                  held_out_only, n_runs or len(runs)), len(classes)
    if m.size > LITERAL_MAX_WEIGHTS:
        raise TooLarge(f"{m.size} head weights are too many to inline; use engine='arrow'")
    class_arr = F.array(*[F.lit(c) for c in classes])
    y = (F.array_position(class_arr, F.col(label_col)) - 1).cast("long")
    zero = F.lit(0).cast("long") if integer else F.lit(0.0)
    src = items.select(F.col(id_col).alias("item_id"), y.alias("y_true"), vec_col,
                       F.explode(_literal_heads(runs, m, integer)).alias("__h"))
    if held_out_only:
        src = src.where(F.col("__h.run_id") == fold_of("item_id", n_runs or len(runs)))
    vec = F.col(vec_col) if integer else F.transform(vec_col, lambda v: v.cast("double"))
    return src.select(
        F.col("__h.run_id").alias("run_id"), "item_id", "y_true",
        F.transform("__h.heads", lambda w: dot(vec, w, zero)).alias("logits"),
    ), len(classes)


def _score_items_arrow(items, runs, classes, m, vec_col, id_col, label_col, integer, held_out_only, n_runs):
    """One broadcast numpy tensor, one batched matrix product per run and Arrow batch."""
    spark = items.sparkSession
    dtype = np.int64 if integer else np.float64
    bc = share(spark, np.array(m.tolist(), dtype=dtype))
    class_pos = {c: i for i, c in enumerate(classes)}
    logit_type = "bigint" if integer else "double"

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = bc.value
        for pdf in batches:
            x = np.stack(pdf[vec_col].to_numpy()).astype(dtype)
            ys = pdf[label_col].map(class_pos).fillna(-1).astype("int64")
            for i, run in enumerate(runs):
                keep = (pdf[id_col] % n_runs == run).to_numpy() if held_out_only else slice(None)
                logits = x[keep] @ heads[i].T
                yield pd.DataFrame({
                    "run_id": run, "item_id": pdf[id_col].to_numpy()[keep], "y_true": ys.to_numpy()[keep],
                    "logits": list(logits),
                })

    schema = f"run_id long, item_id long, y_true long, logits array<{logit_type}>"
    return items.select(id_col, label_col, vec_col).mapInPandas(fn, schema)


def score_pair(items: DataFrame, heads: DataFrame, heads_int: DataFrame, vec_col: str = "embedding", int_col: str = "q",
               id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Float and INT8 logits of every item under every run's heads, in one pass over the items:
    ``run_id, item_id, y_true, logits, logits_int``."""
    runs, classes, m = head_matrix(heads, label_col)
    _, _, mi = head_matrix(heads_int, label_col)
    bc = share(items.sparkSession, (np.array(m.tolist(), dtype=np.float64), np.array(mi.tolist(), dtype=np.int64)))
    class_pos = {c: i for i, c in enumerate(classes)}

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, wi = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            xi = np.stack(pdf[int_col].to_numpy()).astype(np.int64)
            ys = pdf[label_col].map(class_pos).fillna(-1).astype("int64").to_numpy()
            for i, run in enumerate(runs):
                yield pd.DataFrame({"run_id": run, "item_id": pdf[id_col].to_numpy(), "y_true": ys, "logits": list(x @ w[i].T), "logits_int": list(xi @ wi[i].T)})

    return items.select(id_col, label_col, vec_col, int_col).mapInPandas(fn, "run_id long, item_id long, y_true long, logits array<double>, logits_int array<bigint>")


def shared_head(items: DataFrame, weights: list[float], bias: float, vecs_col: str = "candidates", out: str = "logits") -> DataFrame:
    """ML-1, the shared head: ``w . h_c + b`` for each of an item's candidate vectors (an array of
    K arrays of the head's length; K may differ from item to item). One weight vector and bias
    serve all candidates. Row-local: one batched product per Arrow batch, ragged lists and all.
    Null lists give null."""
    bc = share(items.sparkSession, (np.asarray(weights, dtype=np.float64), float(bias)))
    at = items.columns.index(vecs_col)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = bc.value
        for batch in batches:
            lists = batch.column(at)
            vectors = lists.flatten()  # null lists have none
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != len(w)).any():
                raise ValueError(f"candidate vectors must have the head's width of {len(w)}")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(w))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
            starts = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
            scores = pa.ListArray.from_arrays(starts, pa.array(flat @ w + b), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInArrow(fn, f"{schema}, `{out}` array<double>")


def linear_score(items: DataFrame, heads: DataFrame, vec_col: str = "embedding", **kw) -> DataFrame:
    """ML-1: float logits ``w . h`` of every item under every run's heads."""
    return score_items(items, heads, vec_col, integer=False, **kw)


def int8_score(items: DataFrame, heads: DataFrame, vec_col: str = "q", **kw) -> DataFrame:
    """ML-2: exact integer logits of quantised items under integer heads."""
    return score_items(items, heads, vec_col, integer=True, **kw)


def to_long(scores: DataFrame, logits_col: str = "logits") -> DataFrame:
    """Array-form scores to ``run_id, item_id, y_true, cand_idx, logit``."""
    return scores.select("run_id", "item_id", "y_true", F.posexplode(logits_col).alias("cand_idx", "logit")) \
        .withColumn("cand_idx", F.col("cand_idx").cast("long"))


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_with(items: DataFrame, make_scorer: Callable[[], Scorer], schema: str) -> DataFrame:
    """ML-3 / UF-2: score item batches with a user-supplied model.

    ``make_scorer`` is called once per Python worker task (load the model there, lazily);
    the scorer maps a pandas batch of items to a pandas frame matching ``schema``. Batch
    size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            yield scorer(pdf)

    return items.mapInPandas(fn, schema)

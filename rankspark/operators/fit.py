"""ML-4, ML-5: fit a shared linear head by softmax cross-entropy; cross-validate it.

Each item carries its candidate embeddings, so the softmax over an item's candidates is
row-local. A gradient step is one Spark job: ``mapInPandas`` turns each Arrow batch into
partial gradient sums (numpy), ``groupBy(idx).sum`` combines them (map-side partial
aggregation), and only the K x H + K numbers of the update come back to the driver. The
input is stored once in the shared folder; the weights travel as one broadcast per step, so the
lineage does not grow with the number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators.folds import fold_split
from rankspark.operators.joins import collect_small, share
from rankspark.session import stored

MAX_HEAD_WEIGHTS = 10_000_000


@dataclass
class Head:
    classes: list
    w: np.ndarray  # [K, H]
    b: np.ndarray  # [K]
    history: list[tuple[int, float]]


def _grad_fn(bc, vec_col: str, label_col: str, class_pos: dict):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = bc.value
        k, h = w.shape
        g_w = np.zeros_like(w)
        g_b = np.zeros_like(b)
        loss = 0.0
        n = 0
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            y = pdf[label_col].map(class_pos).to_numpy().astype(np.int64)
            z = x @ w.T + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            loss += float(-np.log(np.clip(p[np.arange(len(y)), y], 1e-300, None)).sum())
            p[np.arange(len(y)), y] -= 1.0
            g_w += p.T @ x
            g_b += p.sum(axis=0)
            n += len(y)
        if n == 0:
            return
        idx = np.arange(k * h + k + 2, dtype=np.int64) - 2
        val = np.concatenate([[float(n), loss], g_w.reshape(-1), g_b])
        # idx -2 = count, -1 = loss sum, 0.. = gradient entries (W row-major, then b)
        yield pd.DataFrame({"idx": idx, "g": val})

    return fn


def fit_head(items: DataFrame, vec_col: str = "embedding", label_col: str = "label",
             l2: float = 0.01, lr: float = 0.5, steps: int = 20, seed: int = 42) -> Head:
    """Full-batch gradient descent on the mean softmax cross-entropy plus L2 decay. Rows without
    a label don't train; the head (classes x dimensions) must fit MAX_HEAD_WEIGHTS."""
    spark = items.sparkSession
    data = stored(items.where(F.col(label_col).isNotNull()).select(vec_col, label_col), "train")
    dim_row = data.select(F.size(vec_col).alias("h")).first()
    h = int(dim_row["h"]) if dim_row else 0
    most = MAX_HEAD_WEIGHTS // max(1, h)
    classes = [r[0] for r in collect_small(data.select(label_col).distinct().orderBy(label_col), most, "class list")]
    k = len(classes)
    if k * h > MAX_HEAD_WEIGHTS:
        raise ValueError("head too large for driver-side updates")
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 0.01, size=(k, h))
    b = np.zeros(k)
    class_pos = {c: i for i, c in enumerate(classes)}
    history = []
    for step in range(steps):
        bc = share(spark, (w, b))
        parts = data.mapInPandas(_grad_fn(bc, vec_col, label_col, class_pos), "idx long, g double")
        sums = parts.groupBy("idx").agg(F.sum("g").alias("g"))
        expected_rows = k * h + k + 2
        got = sorted((r["idx"], r["g"]) for r in sums.collect())
        bc.unpersist()
        if len(got) != expected_rows:
            raise RuntimeError("gradient reduction returned an unexpected shape")
        vals = np.array([g for _, g in got])
        n, loss = vals[0], vals[1]
        g_w = vals[2:2 + k * h].reshape(k, h) / n + l2 * w
        g_b = vals[2 + k * h:] / n
        history.append((step, float(loss / n)))
        w = w - lr * g_w
        b = b - lr * g_b
    return Head(classes, w, b, history)


def history_frame(spark, head: Head) -> DataFrame:
    return spark.createDataFrame([(int(s), float(v)) for s, v in head.history], "step long, loss double")


def score_head(items: DataFrame, head: Head, vec_col: str = "embedding", label_col: str = "label",
               id_col: str = "vec_id") -> DataFrame:
    """Logits of the fitted head: ``item_id, y_true, logits`` (one batched matrix product
    per Arrow batch; the head travels once as a broadcast value)."""
    bc = share(items.sparkSession, (head.w, head.b))
    class_pos = {c: i for i, c in enumerate(head.classes)}

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = bc.value
        for pdf in batches:
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, w.shape[1]))
            yield pd.DataFrame({
                "item_id": pdf[id_col].to_numpy(),
                "y_true": pdf[label_col].map(class_pos).fillna(-1).astype("int64").to_numpy(),
                "logits": list(x @ w.T + b),
            })

    return items.select(id_col, label_col, vec_col).mapInPandas(
        fn, "item_id long, y_true long, logits array<double>"
    )


def cross_validate(items: DataFrame, n_folds: int, fit_fn, score_fn, fold_col: str = "fold") -> DataFrame:
    """ML-5: for each fold fit on the other folds, score the held-out fold, union the
    out-of-fold scores (SO-1). ``fit_fn(train) -> model``; ``score_fn(valid, model) -> DF``.

    Each fold is a Spark job on the same input; the driver only loops over folds. Rows without a
    fold train in every round and are never scored.
    """
    parts = []
    for f in range(n_folds):
        train, valid = fold_split(items, f, fold_col)
        parts.append(score_fn(valid, fit_fn(train)).withColumn(fold_col, F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""ML-4, ML-5: one head shared by all candidates, fitted over each item's own candidate set.

The softmax of a shared head over an item's candidates is a conditional logit: the loss depends on
differences between candidates only, so a bias common to all cannot be told from none and stays 0.
The loss with weight decay is convex; each Newton step is one Spark job that adds up, per task, the
loss, the gradient and the curvature (the covariance of the candidate vectors under the softmax), and
brings (H + 1)(H + 2) / 2 + 1 numbers a head to the driver. Lists may differ in length. Heads that
differ in the fold they leave out or in their weight decay take their steps in the same jobs.

``SharedHead`` and ``MapEvaluator`` are ``pyspark.ml`` stages, so ``CrossValidator`` with a fold column
fits, scores the held-out folds and picks the parameters; ``FoldCrossValidator`` does it with the heads of
all folds and values fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators import metrics, ranking, score
from rankspark.operators.joins import share
from rankspark.session import stored

#: Width of a candidate vector up to which the curvature is summed (H squared / 2 numbers a task).
MAX_WIDTH = 1024
#: Numbers that a pass may sum for all its heads; further heads take a pass of their own.
PASS_NUMBERS = 1 << 20


@dataclass
class Fitted:
    w: np.ndarray
    b: float = 0.0
    history: list[dict] = field(default_factory=list)  # per step: step, loss, gradient, w


def _statistics(bc):
    """Per task and head: items, loss, gradient and the upper half of the curvature, as (head, idx, value).
    Items of the fold that a head leaves out don't count for it."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = bc.value
        h = len(heads[0][1])
        upper = np.triu_indices(h)
        sums: dict[int, list] = {}  # per head: items, loss, gradient, curvature
        for batch in batches:
            lists = batch.column(0)
            all_sizes = np.diff(lists.offsets.to_numpy())
            if not len(all_sizes):
                continue
            all_x = lists.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, h)
            all_y, folds = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for left_out in {f for f, _ in heads}:
                x, sizes, y = all_x, all_sizes, all_y
                keep = None if left_out is None else folds != left_out
                if keep is not None and not keep.all():
                    if not keep.any():
                        continue
                    x, sizes, y = all_x[np.repeat(keep, all_sizes)], all_sizes[keep], all_y[keep]
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                true = x[first + y]
                for i, w in ((i, w) for i, (f, w) in enumerate(heads) if f == left_out):
                    z = x @ w
                    top = np.maximum.reduceat(z, first)
                    e = np.exp(z - np.repeat(top, sizes))
                    total = np.add.reduceat(e, first)
                    px = (e / np.repeat(total, sizes))[:, None] * x
                    mean = np.add.reduceat(px, first, axis=0)
                    s = sums.setdefault(i, [0, 0.0, np.zeros(h), np.zeros((h, h))])
                    s[0] += len(sizes)
                    s[1] += float((top + np.log(total) - true @ w).sum())
                    s[2] += (mean - true).sum(0)
                    s[3] += px.T @ x - mean.T @ mean
        for i, (n, loss, grad, curve) in sums.items():
            value = np.concatenate([[n, loss], grad, curve[upper]])
            yield pa.record_batch([pa.array(np.full(len(value), i)), pa.array(np.arange(len(value))), pa.array(value)], names=["head", "idx", "v"])

    return fn


def _collect_statistics(data: DataFrame, heads: list[tuple[int | None, np.ndarray]]) -> list[tuple]:
    """One pass over the items: loss, gradient and curvature of every head (the fold it leaves out, w)."""
    bc = share(data.sparkSession, heads)
    sums = data.mapInArrow(_statistics(bc), "head long, idx long, v double").groupBy("head", "idx").agg(F.sum("v").alias("v")).toArrow()
    bc.unpersist()
    h = len(heads[0][1])
    value = np.zeros((len(heads), _numbers(h)))
    value[sums.column("head").to_numpy(), sums.column("idx").to_numpy()] = sums.column("v").to_numpy()
    if not value[:, 0].all():
        raise ValueError("no item has a true candidate")
    out = []
    for v in value:
        curve = np.zeros((h, h))
        curve[np.triu_indices(h)] = v[2 + h:]
        out.append((v[1] / v[0], v[2: 2 + h] / v[0], (curve + np.triu(curve, 1).T) / v[0]))
    return out


def _numbers(h: int) -> int:
    return (h + 1) * (h + 2) // 2 + 1


class _Newton:
    """The Newton steps of one head. ``w`` is the point whose sums are wanted next, or the result once ``done``."""

    def __init__(self, w: np.ndarray, l2: float, steps: int, tol: float, left_out: int | None = None):
        self.w, self.l2, self.steps, self.tol, self.left_out = w, l2, steps, tol, left_out
        self.history: list[dict] = []
        self.move = np.zeros(len(w))
        self.done = False

    def take(self, loss, grad, curve) -> None:
        """The sums at ``w``: a step that would not lower the loss is halved, else the next one is set."""
        full = loss + self.l2 / 2 * float(self.w @ self.w)
        if self.history and not full <= self.history[-1]["objective"] + 1e-12 and np.abs(self.move).max() > 1e-12:
            self.move = self.move / 2
            self.w = self.history[-1]["w"] + self.move
            return
        grad = grad + self.l2 * self.w
        step = len(self.history)
        self.history.append({"step": step, "loss": float(loss), "objective": float(full), "gradient": float(np.abs(grad).max()), "w": self.w})
        self.done = step == self.steps or bool(np.abs(grad).max() <= self.tol)
        if not self.done:
            self.move = -np.linalg.lstsq(curve + self.l2 * np.eye(len(self.w)), grad, rcond=None)[0]
            self.w = self.w + self.move


def _training(items: DataFrame, candidates: str, label: str, fold=None) -> DataFrame:
    """The items that train: vectors ``x``, place of the true one ``y``, ``fold`` (null if there is none)."""
    place = F.col(label).cast("long")
    fits = (place >= 0) & (place < F.size(candidates))
    fold = F.lit(None) if fold is None else F.col(fold)
    return items.where(fits).select(F.col(candidates).cast("array<array<double>>").alias("x"), place.alias("y"), fold.cast("int").alias("fold"))


def _fit_heads(data: DataFrame, cases: list[dict], seed: int | None = None) -> list[Fitted]:
    """The heads of all ``cases`` (l2, steps, tol, left_out) over the same stored items. Each pass takes all
    heads that are not done one step on, as far as ``PASS_NUMBERS`` allows."""
    width = data.agg(F.min(F.size(F.col("x")[0])).alias("lo"), F.max(F.array_max(F.transform("x", F.size))).alias("hi")).first()
    if width["hi"] is None:
        raise ValueError("no item has a true candidate")
    if width["lo"] != width["hi"] or width["hi"] > MAX_WIDTH:
        raise ValueError(f"candidate vectors must have one width of {MAX_WIDTH} at most, found {width['lo']} to {width['hi']}")
    h = width["hi"]
    w = np.zeros(h) if seed is None else np.random.default_rng(seed).normal(0.0, 0.01, h)
    runs = [_Newton(w, **case) for case in cases]
    together = max(1, PASS_NUMBERS // _numbers(h))
    while going := [r for r in runs if not r.done]:
        for i in range(0, len(going), together):
            some = going[i: i + together]
            for run, sums in zip(some, _collect_statistics(data, [(r.left_out, r.w) for r in some]), strict=True):
                run.take(*sums)
    return [Fitted(r.w, 0.0, r.history) for r in runs]


def fit_shared_head(items: DataFrame, candidates: str = "candidates", label: str = "y_true", l2: float = 0.01,
                    steps: int = 8, tol: float = 1e-8, seed: int | None = None) -> Fitted:
    """ML-4: minimise the mean softmax cross-entropy over each item's candidates plus l2 / 2 |w|^2.

    ``candidates``: K vectors of one width H per item, K free; ``label``: the place of the true one.
    Items without a true candidate in their list, or without a list, don't train. Newton steps from 0
    (from a seeded draw if ``seed`` is given) until the gradient is below ``tol`` or ``steps`` are done; a
    step that would not lower the loss is halved. The input is stored once, projected to what the steps read."""
    data = stored(_training(items, candidates, label), "fit-items")
    return _fit_heads(data, [{"l2": l2, "steps": steps, "tol": tol}], seed)[0]


def history_frame(spark, fitted: Fitted) -> DataFrame:
    """step, loss, gradient (largest entry), w of every step."""
    rows = [(x["step"], x["loss"], x["gradient"], [float(v) for v in x["w"]]) for x in fitted.history]
    return spark.createDataFrame(rows, "step long, loss double, gradient double, w array<double>")


class _HeadParams(Params):
    candidatesCol = Param(Params._dummy(), "candidatesCol", "candidate vectors of an item", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "place of the true candidate", TypeConverters.toString)
    l2 = Param(Params._dummy(), "l2", "weight decay", TypeConverters.toFloat)
    steps = Param(Params._dummy(), "steps", "Newton steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "gradient at which to stop", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(candidatesCol="candidates", labelCol="y_true", l2=0.01, steps=8, tol=1e-8)


class SharedHead(Estimator, _HeadParams):
    """ML-4 as an estimator: ``fit(items) -> SharedHeadModel``."""

    @keyword_only
    def __init__(self, *, candidatesCol="candidates", labelCol="y_true", l2=0.01, steps=8, tol=1e-8):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SharedHeadModel:
        get = self.getOrDefault
        fitted = fit_shared_head(dataset, get("candidatesCol"), get("labelCol"), get("l2"), get("steps"), get("tol"))
        return self._copyValues(SharedHeadModel(fitted))


class SharedHeadModel(Model, _HeadParams):
    """Adds ``logits`` and ``ranks`` to items."""

    def __init__(self, fitted: Fitted):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = score.shared_head(dataset, list(self.fitted.w), self.fitted.b, self.getOrDefault("candidatesCol"))
        return scored.withColumn("ranks", ranking.rank_array("logits"))


class MapEvaluator(Evaluator):
    """MAP@k of a ranked table; larger is better."""

    def __init__(self, k: int = 3, ranks_col: str = "ranks", label_col: str = "y_true"):
        super().__init__()
        self.k, self.ranks_col, self.label_col = k, ranks_col, label_col

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(metrics.map_at_k(dataset, self.k, self.ranks_col, self.label_col).first()["map"])

    def isLargerBetter(self) -> bool:
        return True


class FoldCrossValidator(CrossValidator):
    """``CrossValidator`` for a ``SharedHead`` and a fold column, over a grid of ``l2``, ``steps`` and ``tol``.

    The same models and metrics, but the heads of all folds and values, and those on all items, take their
    Newton steps in the same passes: their number does not grow with folds x values. The items are written
    once to the shared folder, a folder per fold, so an evaluation reads its own fold only; nothing is cached."""

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        folds, fold_col, evaluator = self.getNumFolds(), self.getFoldCol(), self.getEvaluator()
        heads = [self.getEstimator().copy(params) for params in self.getEstimatorParamMaps()]
        held = self._held(dataset)
        get = heads[0].getOrDefault
        cases = [{"l2": x.getOrDefault("l2"), "steps": x.getOrDefault("steps"), "tol": x.getOrDefault("tol"), "left_out": f}
                 for f in [*range(folds), None] for x in heads]
        fitted = _fit_heads(_training(held, get("candidatesCol"), get("labelCol"), fold_col), cases)
        models = [x._copyValues(SharedHeadModel(one)) for x, one in zip(heads * (folds + 1), fitted, strict=True)]
        by_fold = [models[f * len(heads): (f + 1) * len(heads)] for f in range(folds + 1)]  # the last: on all items

        def evaluate(at: tuple[int, int]) -> float:
            fold, choice = at
            return evaluator.evaluate(by_fold[fold][choice].transform(held.where(F.col(fold_col) == fold)))

        places = [(f, j) for f in range(folds) for j in range(len(heads))]
        with ThreadPool(min(self.getParallelism(), len(places))) as pool:
            measured = pool.map(inheritable_thread_target(dataset.sparkSession)(evaluate), places, chunksize=1)
        metrics_all = np.array(measured).reshape(folds, len(heads))
        means, deviations = CrossValidator._gen_avg_and_std_metrics(metrics_all)
        best = int(np.argmax(means) if evaluator.isLargerBetter() else np.argmin(means))
        return self._copyValues(CrossValidatorModel(by_fold[-1][best], means, by_fold[:-1] if self.getCollectSubModels() else None, deviations))

    def _held(self, dataset: DataFrame) -> DataFrame:
        """The items stored by fold, every fold checked as ``CrossValidator`` does."""
        folds, fold_col = self.getNumFolds(), self.getFoldCol()
        known = (F.col(fold_col) >= 0) & (F.col(fold_col) < folds)
        wrong = F.raise_error(F.printf(F.lit(f"Fold number must be in range [0, {folds}), but got %s"), F.col(fold_col)))
        held = stored(dataset.withColumn(fold_col, F.when(known, F.col(fold_col)).otherwise(wrong)), "cv-folds", fold_col)
        found = {r[fold_col] for r in held.groupBy(fold_col).count().collect()}  # a row per fold
        for f in range(folds):
            if not found - {f}:
                raise ValueError(f"The training data at fold {f} is empty.")
            if f not in found:
                raise ValueError(f"The validation data at fold {f} is empty.")
        return held


def cross_validate_grid(items: DataFrame, l2_grid: list[float], folds: int, fold_col: str = "fold", k: int = 3,
                        steps: int = 8, tol: float = 1e-8, parallelism: int = 1):
    """ML-5: ``CrossValidator`` over the weight decay, with the folds of column ``fold_col`` (0 to
    ``folds`` - 1). Returns the fitted ``CrossValidatorModel``: ``avgMetrics`` per value, ``subModels`` per fold
    and value, ``bestModel`` refitted on all items. ``parallelism``: held-out folds evaluated at a time."""
    head = SharedHead(steps=steps, tol=tol)
    grid = ParamGridBuilder().addGrid(head.l2, l2_grid).build()
    known = items.select("candidates", "y_true", F.col(fold_col).cast("int").alias(fold_col))
    cv = FoldCrossValidator(estimator=head, estimatorParamMaps=grid, evaluator=MapEvaluator(k), numFolds=folds, foldCol=fold_col,
                            collectSubModels=True, parallelism=parallelism)
    return cv.fit(known)


def out_of_fold(items: DataFrame, model, choice: int, fold_col: str = "fold") -> DataFrame:
    """The items of every fold scored and ranked by the head that did not see it."""
    parts = [heads[choice].transform(items.where(F.col(fold_col) == f)) for f, heads in enumerate(model.subModels)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

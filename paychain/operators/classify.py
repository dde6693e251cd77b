"""L1 multinomial and one-vs-rest logistic regression, and linear scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """Raw score of each class: weights of the columns and an intercept."""

    columns: tuple[str, ...]
    classes: tuple[int, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def margins(self) -> list[Column]:
        return [sum((F.lit(float(w)) * F.col(c) for w, c in zip(row, self.columns)), F.lit(float(b))) for row, b in zip(self.weights, self.intercepts)]


def _train(df: DataFrame, columns: list[str], label: str, classes: list[int]) -> DataFrame:
    # classes become 0 .. K-1: a gap would count as a class of its own
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    rows = df.where(F.col(label).isNotNull()).select(*columns, number.cast("double").alias("label"))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).select("features", "label")


def fit_softmax_l1(
    df: DataFrame, columns: list[str], label: str, C: float = 3.0, classes: list[int] | None = None, max_iter: int = 100, tol: float = 1e-4, steps: int = 0
) -> tuple[LinearModel, float, int]:
    """(model, regularisation, rows): the minimum of C x the sum of losses + the L1 norm of the weights; intercepts are free.

    With ``steps``, up to so many proximal Newton steps follow where Spark's optimiser stopped, a pass or two each, until the
    optimality conditions hold to a millionth of the regularisation or no step lowers the cost: from near the optimum they
    lead closer in fewer passes than a smaller tolerance does. A pass sends (columns x classes) squared numbers to the driver.
    """
    classes = classes or sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    data = _train(df, columns, label, classes).persist()
    try:
        n = data.count()
        reg = 1.0 / (C * n)
        fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=reg, standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol).fit(data)
        weights, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        if steps:
            weights, b = _newton(data, weights, b, reg, steps)
            b = b - b.mean()
    finally:
        data.unpersist()
    return LinearModel(tuple(columns), tuple(classes), tuple(tuple(map(float, w)) for w in weights), tuple(map(float, b))), reg, n


def _moments(data: DataFrame, at: np.ndarray, apart: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of the softmax, its gradient and Hessian at ``at``, classes x (columns and intercept), in one pass.

    With ``apart``, the sum of the losses of each class against the rest, whose Hessian has a block for each class.
    """
    k, d = at.shape
    size = k * d

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 + size + size * size)
        slope, bend = found[2 : 2 + size].reshape(k, d), found[2 + size :].reshape(k, d, k, d)
        for batch in batches:
            n = batch.num_rows
            x = np.column_stack([batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, d - 1), np.ones(n)])
            own = np.arange(n), batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            m = x @ at.T
            if apart:
                p = np.exp(-np.logaddexp(0, -m))
                found[:2] += n, np.logaddexp(0, m).sum() - m[own].sum()
            else:
                m -= m.max(1, keepdims=True, initial=-np.inf)
                p = np.exp(m)
                total = p.sum(1)
                p /= total[:, None]
                found[:2] += n, (np.log(total) - m[own]).sum()
            for a in range(k):
                for b in [a] if apart else range(k):
                    bend[a, :, b] += x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])
            p[own] -= 1
            slope += p.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["line"])

    sums = data.select(vector_to_array("features").alias("x"), "label").mapInArrow(add, "line array<double>").select(F.posexplode("line")).groupBy("pos").agg(F.sum("col").alias("v"))
    found = np.zeros(2 + size + size * size)
    for r in sums.collect():
        found[r["pos"]] = r["v"]
    found[1:] /= max(found[0], 1)
    return found[1], found[2 : 2 + size], found[2 + size :].reshape(size, size)


def _newton(data: DataFrame, weights: np.ndarray, intercepts: np.ndarray, reg: float, steps: int, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients after proximal Newton steps with backtracking: the quadratic model is minimised by coordinates, weights with their L1 norm."""
    here = np.column_stack([weights, intercepts])
    cost = np.full(here.shape, reg)
    cost[:, -1] = 0
    shape, cost = here.shape, cost.ravel()
    loss, slope, bend = _moments(data, here, apart)
    here = here.ravel()
    for _ in range(steps):
        off = np.where(here != 0, np.abs(slope + cost * np.sign(here)), np.maximum(np.abs(slope) - cost, 0))
        if off.max() <= 1e-6 * reg:
            break
        goal, curve = here.copy(), np.diag(bend) + 1e-12
        pull = slope.copy()  # the slope of the quadratic model at goal
        for _ in range(5000):
            most = 0.0
            for j in range(len(goal)):
                z = goal[j] - pull[j] / curve[j]
                move = np.sign(z) * max(abs(z) - cost[j] / curve[j], 0.0) - goal[j]
                if move:
                    goal[j] += move
                    pull += move * bend[j]
                    most = max(most, abs(move) * curve[j])
            if most <= 1e-9 * reg:
                break
        step, before = goal - here, loss + cost @ np.abs(here)
        gain, share = slope @ step + cost @ (np.abs(goal) - np.abs(here)), 1.0
        while share > 1e-6:
            there = here + share * step
            found = _moments(data, there.reshape(shape), apart)
            if found[0] + cost @ np.abs(there) <= before + 1e-4 * share * gain + 1e-15 * before:
                break
            share /= 2
        else:
            break  # no step is better, to the last digit
        here, (loss, slope, bend) = there, found
    here = here.reshape(shape)
    return here[:, :-1], here[:, -1]


def fit_ovr(df: DataFrame, columns: list[str], label: str, C: float = 3.0, classes: list[int] | None = None, tol: float = 1e-6, steps: int = 20) -> LinearModel:
    """One binary L1 fit for each class against the rest; a class's raw score is its decision value.

    Spark's optimiser stops by the cost, which tells ever less of the optimality conditions the more rows there are; up to ``steps``
    proximal Newton steps follow, of all classes in one pass.
    """
    classes = classes or sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    data = _train(df, columns, label, classes).persist()
    try:
        reg = 1.0 / (C * data.count())
        one = LogisticRegression(elasticNetParam=1.0, regParam=reg, standardization=False, maxIter=100, tol=tol)
        models = OneVsRest(classifier=one, parallelism=3).fit(data).models
        weights, b = np.array([m.coefficients.toArray() for m in models]), np.array([m.intercept for m in models])
        if steps:
            weights, b = _newton(data, weights, b, reg, steps, apart=True)
    finally:
        data.unpersist()
    return LinearModel(tuple(columns), tuple(classes), tuple(tuple(map(float, w)) for w in weights), tuple(map(float, b)))


def predict_linear(df: DataFrame, model: LinearModel, out: str = "predict_index", margins: bool = False) -> DataFrame:
    """The class of the largest raw score, the first of equal ones; with ``margins`` also m1 .. mK."""
    scores = model.margins()
    m = F.array(*scores)
    df = df.withColumns({f"m{i + 1}": s for i, s in enumerate(scores)}) if margins else df
    return df.withColumn(out, F.get(F.array(*map(F.lit, model.classes)), (F.array_position(m, F.array_max(m)) - 1).cast("int")).cast("int"))


def kkt_residual(df: DataFrame, model: LinearModel, label: str, reg: float) -> float:
    """The largest violation of the optimality conditions of the L1 fit, relative to the regularisation."""
    m = model.margins()
    top = F.greatest(*m) if len(m) > 1 else m[0]
    e = [F.exp(x - top) for x in m]
    total = sum(e[1:], e[0])
    sums = []
    for k, c in enumerate(model.classes):
        gap = e[k] / total - (F.col(label) == c).cast("int")
        sums += [F.avg(gap * F.col(x)).alias(f"g{k}_{j}") for j, x in enumerate(model.columns)] + [F.avg(gap).alias(f"b{k}")]
    row = df.where(F.col(label).isNotNull()).agg(*sums).first()
    worst = 0.0
    for k in range(len(model.classes)):
        worst = max(worst, abs(row[f"b{k}"]))
        for j, w in enumerate(model.weights[k]):
            g = row[f"g{k}_{j}"]
            worst = max(worst, abs(g + reg * (1 if w > 0 else -1)) if w else max(0.0, abs(g) - reg))
    return worst / reg


def ovr_residuals(df: DataFrame, model: LinearModel, label: str, C: float = 3.0) -> DataFrame:
    """(class, rows, residual): the largest violation of each binary fit's optimality conditions, relative to its regularisation 1 / (C x rows)."""
    m, sums = model.margins(), []
    for k, c in enumerate(model.classes):
        gap = 1 / (1 + F.exp(-m[k])) - (F.col(label) == c).cast("int")
        sums += [F.avg(gap * F.col(x)).alias(f"g{k}_{j}") for j, x in enumerate(model.columns)] + [F.avg(gap).alias(f"b{k}")]
    row = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), *sums)

    def off(k: int) -> Column:
        reg = 1 / (C * F.col("n"))
        parts = [F.abs(F.col(f"b{k}"))]
        for j, w in enumerate(model.weights[k]):
            g = F.col(f"g{k}_{j}")
            parts.append(F.abs(g + reg * (1 if w > 0 else -1)) if w else F.greatest(F.lit(0.0), F.abs(g) - reg))
        return F.greatest(*parts) / reg

    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col("n").alias("rows"), off(k).alias("residual")) for k, c in enumerate(model.classes)))).alias("r")).select("r.*")

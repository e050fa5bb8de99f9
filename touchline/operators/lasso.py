"""Generalised linear models with an L1 penalty, from distributed Gram sums.

Around given coefficients the loss looks like a weighted least-squares problem, which
is known by X'WX and X'(y - mean). One pass over the rows sums both; the small
penalised problem is then solved by coordinate descent where the sums are. The number of
passes is that of Newton steps, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOGISTIC, POISSON = "logistic", "poisson"


def linear(columns: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted sum of the columns; the last weight stands alone."""
    terms = [F.col(name) * float(weight) for name, weight in zip(columns, weights)]
    return sum(terms, F.lit(float(weights[-1])))


def mean_of(family: str, eta: Column) -> Column:
    return F.exp(eta) if family == POISSON else 1 / (1 + F.exp(-eta))


def _loss(family: str, label: Column, eta: Column, mean: Column) -> Column:
    """Loss of a row, never negative: half the deviance, or the log loss."""
    if family == POISSON:
        entropy = F.when(label > 0, label * F.log(label)).otherwise(0.0)
        return F.greatest(entropy - label * eta - label + mean, F.lit(0.0))
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - label * eta


def coordinate_descent(
    a: np.ndarray, b: np.ndarray, penalty: float, start: np.ndarray, tol: float = 1e-12, sweeps: int = 20_000
) -> np.ndarray:
    """Minimise w'aw / 2 - b'w + penalty * |w|_1; a coordinate without curvature stays 0."""
    w = start.copy()
    product = a @ w
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            if a[j, j] <= 0:
                moved = 0.0
            else:
                u = b[j] - product[j] + a[j, j] * w[j]
                moved = np.sign(u) * max(abs(u) - penalty, 0.0) / a[j, j]
            if moved != w[j]:
                product += a[:, j] * (moved - w[j])
                largest = max(largest, abs(moved - w[j]))
                w[j] = moved
        if largest < tol:
            break
    return w


@dataclass(frozen=True)
class Descent:
    """Where a fit stands: the best coefficients so far and those to be looked at next."""

    accepted: np.ndarray
    candidate: np.ndarray
    objective: float = float("inf")
    done: bool = False

    @classmethod
    def at(cls, start: Sequence[float]) -> Descent:
        return cls(np.array(start, float), np.array(start, float))

    def advance(
        self, curvature: np.ndarray, gradient: np.ndarray, loss: float, alpha: float, tol: float
    ) -> Descent:
        """The next step, from the sums at the candidate (``gradient`` is X'(y - mean)).

        A candidate that made things worse is moved half the way back.
        """
        objective = loss + alpha * np.abs(self.candidate).sum()
        if not np.isfinite(objective) or objective > self.objective + 1e-9 * (1 + abs(self.objective)):
            return replace(self, candidate=(self.accepted + self.candidate) / 2)
        target = curvature @ self.candidate + gradient
        found = coordinate_descent(curvature, target, alpha, self.candidate)
        done = bool(np.abs(found - self.candidate).max(initial=0.0) < tol)
        return Descent(self.candidate if not done else found, found, objective, done)


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of a fitted model, the intercept last."""

    family: str
    columns: list[str]
    coefficients: list[float]

    def mean(self) -> Column:
        """Expected label of a row: a probability or a rate."""
        return mean_of(self.family, linear(self.columns, self.coefficients))

    def transform(self, data: DataFrame) -> DataFrame:
        return data.withColumn("prediction", self.mean())


class NotConverged(RuntimeError):
    """The iteration limit cut a fit off."""


def gram(rows: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Sums over all rows of the products of every two columns. Runs a job."""
    named = [column.cast("double").alias(f"_g{i}") for i, column in enumerate(columns)]
    vectors = VectorAssembler(inputCols=[f"_g{i}" for i in range(len(named))], outputCol="_v").transform(
        rows.select(*named)
    ).select("_v")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "_v"), 0, len(named))
    return matrix.computeGramianMatrix().toArray()


def fit_l1(
    rows: DataFrame, columns: Sequence[str], label: str, family: str, alpha: float, tol: float, steps: int
) -> LinearModel:
    """Minimise the summed loss plus ``alpha`` times the L1 norm, intercept included.

    ``rows`` should be stored: each step reads it once. The driver holds sums whose
    number is the square of that of the columns. Raises ``NotConverged`` after
    ``steps`` steps, ``ValueError`` without rows.
    """
    size = len(columns) + 1
    y = F.col(label)
    average = rows.agg(F.avg(y)).first()[0]
    if average is None:
        raise ValueError("a model needs rows")
    start = np.zeros(size)
    if family == POISSON:
        start[-1] = np.log(max(average, 1e-6))
    descent = Descent.at(start)
    for _ in range(steps):
        eta = linear(columns, descent.candidate)
        mean = mean_of(family, eta)
        weight = F.greatest(mean if family == POISSON else mean * (1 - mean), F.lit(1e-12))
        root = F.sqrt(weight)
        products = [*[F.col(c) * root for c in columns], root, (y - mean) / root]
        sums = gram(rows, [*products, F.sqrt(_loss(family, y, eta, mean))])
        descent = descent.advance(sums[:size, :size], sums[:size, size], sums[-1, -1], alpha, tol)
        if descent.done:
            return LinearModel(family, list(columns), [float(w) for w in descent.accepted])
    raise NotConverged(f"the fit did not converge in {steps} steps")

"""L2 logistic regression by Newton steps, each of which is one aggregate over the rows.

The gradient and the Hessian are sums over the training rows, added up by each task
a batch at a time; the driver sees k x k numbers a step. Every term is rounded to a
whole number of a unit that is chosen so that no sum can overflow, so the sums, and
with them the coefficients, do not depend on the order of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logit:
    """A fitted model; weights are those of standardised features."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    rows: int
    steps: int

    def score(self) -> Column:
        """The probability of a row that has the features as columns."""
        return _chance(_standard(self), [*self.weights, self.intercept])

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(m), float(s), float(w)) for n, m, s, w in zip((*self.names, "intercept"), (*self.means, 0.0), (*self.scales, 1.0), (*self.weights, self.intercept), strict=True)]
        return spark.createDataFrame(rows, "feature string, mean double, scale double, weight double")


def _standard(model) -> list[Column]:
    return [(F.col(n) - m) / s for n, m, s in zip(model.names, model.means, model.scales, strict=True)]


def _chance(x: list[Column], b) -> Column:
    z = F.lit(float(b[-1]))
    for c, w in zip(x, b, strict=False):
        z = z + c * float(w)
    return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, names: list[str], label: str = "label", lam: float = 1.0, most: int = 40, tight: float = 1e-9) -> Logit:
    """The minimum of the mean log loss plus lam / 2n times the squared weights (the intercept is free).

    Features are standardised on ``rows`` (population deviation; a constant one
    counts as of deviation 1). Rows with a null feature or label are left out. With
    one class alone, or no rows, the weights are 0.
    """
    names = tuple(names)
    rows = rows.na.drop(subset=[*names, label])
    parts = [f(F.col(n).cast("double")).alias(f"{f.__name__}_{i}") for i, n in enumerate(names) for f in (F.avg, F.stddev_pop, F.min, F.max)]
    s = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positive"), *parts).first()
    n, positive = s["n"], s["positive"] or 0
    mean = tuple(round(s[f"avg_{i}"] or 0.0, 9) for i in range(len(names)))
    scale = tuple(x if (x := round(s[f"stddev_pop_{i}"] or 0.0, 9)) >= 1e-9 else 1.0 for i in range(len(names)))
    if positive in (0, n):
        return Logit(names, mean, scale, (0.0,) * len(names), 30.0 if positive else -30.0, n, 0)
    widest = max([1.0, *(max(abs(s[f"min_{i}"] - mean[i]), abs(s[f"max_{i}"] - mean[i])) / scale[i] for i in range(len(names)))])
    unit = 2.0 ** (62 - math.ceil(math.log2(n * widest**2 + 1)))  # n terms of at most widest^2 fit a long

    k = len(names) + 1
    values = rows.select(F.col(label).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(_standard(Logit(names, mean, scale, (), 0.0, 0, 0)))])

    def sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def partial(batches):
            import pyarrow as pa

            total = np.zeros((k + 1, k), np.int64)
            for batch in batches:
                y, *features = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = np.column_stack([*features, np.ones(len(y))])
                p = 1 / (1 + np.exp(-(x @ b)))
                for i in range(k):
                    total[i] += np.rint(x * (x[:, i] * p * (1 - p) * unit)[:, None]).astype(np.int64).sum(axis=0)
                total[k] += np.rint(x * ((p - y) * unit)[:, None]).astype(np.int64).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["sums"])

        r = values.mapInArrow(partial, "sums array<long>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect()  # a row a cell
        total = np.zeros(k * (k + 1))
        for pos, v in r:
            total[pos] = v / unit
        total = total.reshape(k + 1, k)
        return total[:k], total[k]

    penalty = np.array([lam] * (k - 1) + [0.0])
    at, step, before = np.zeros(k), np.zeros(k), math.inf
    for steps in range(1, most + 1):
        h, g = sums(at - step)
        g = g + penalty * (at - step)
        if np.linalg.norm(g) > before:  # too far: half the step
            if np.abs(step).max() < tight:
                break
            step = step / 2
            continue
        at, before = at - step, np.linalg.norm(g)
        if steps > 1 and np.abs(step).max() < tight:
            break
        step = np.linalg.solve(h + np.diag(penalty), g)
    return Logit(names, mean, scale, tuple(at[:-1]), float(at[-1]), n, steps)

"""Encodings and linear models, by sufficient statistics.

A linear model needs sums of products only: one aggregate over the data gives a matrix as wide as the
features, whatever the number of rows; what follows is small algebra on the driver. So a grid of
penalties costs one pass, and results equal the closed forms.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.stats import with_scalars
from weftline.operators.ordering import numbered


def one_hot(df: DataFrame, c: str, most: int = 20) -> DataFrame:
    """0/1 columns ``<c>_<value>`` for all values but the first in order; ``c`` goes. Fewer than ``most`` values are expected."""
    values = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{c} has more than {most} values")
    return df.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int") for v in values[1:]}).drop(c)


def label_encoded(df: DataFrame, c: str) -> DataFrame:
    """``<c>_code``: the place of the value among the sorted distinct ones, from 0."""
    values = df.select(F.col(c).alias("__v")).filter("__v is not null").distinct()
    codes = numbered(values, [F.col("__v")], "__place").select("__v", (F.col("__place") - 1).cast("int").alias(f"{c}_code"))
    return df.join(codes, F.col(c) == F.col("__v"), "left").drop("__v")


def scaled(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns less their mean, over their population deviation, both of ``fit_on``; constant columns become 0."""
    numbers = (df if fit_on is None else fit_on).agg(*[f for c in columns for f in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    return with_scalars(df, numbers).select(*[F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Moments:
    """n, means, and centred sums of products of features and target (last)."""

    names: tuple[str, ...]
    n: int
    means: np.ndarray
    products: np.ndarray

    @property
    def xx(self) -> np.ndarray:
        return self.products[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.products[:-1, -1]


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """One aggregate. Covariances are computed centred, so large means lose no digits."""
    names = [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    r = rows.agg(F.count("*").alias("n"), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    n = r[0]
    products = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, r[1 + len(names) :], strict=True):
        products[i, j] = products[j, i] = (v or 0.0) * n
    return Moments(tuple(features), n, np.array([x or 0.0 for x in r[1 : 1 + len(names)]], float), products)


@dataclass(frozen=True)
class Linear:
    names: tuple[str, ...]
    intercept: float
    weights: np.ndarray

    def predicted(self) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in zip(self.names, self.weights, strict=True)], F.lit(float(self.intercept)))


def _model(m: Moments, w: np.ndarray) -> Linear:
    return Linear(m.names, float(m.means[-1] - m.means[:-1] @ w), w)


def ols(m: Moments) -> Linear:
    return _model(m, np.linalg.lstsq(m.xx, m.xy, rcond=None)[0])


def ridge(m: Moments, alpha: float) -> Linear:
    """Least squares plus alpha times the sum of squared weights."""
    return _model(m, np.linalg.solve(m.xx + alpha * np.eye(len(m.names)), m.xy))


def lasso(m: Moments, alpha: float, sweeps: int = 2000, tolerance: float = 1e-10) -> Linear:
    """Half the mean squared error plus alpha times the sum of absolute weights, by coordinate descent."""
    xx, xy, w = m.xx / m.n, m.xy / m.n, np.zeros(len(m.names))
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(w)):
            if xx[j, j] > 0:
                rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / xx[j, j]
        if np.abs(w - before).max(initial=0) < tolerance:
            break
    return _model(m, w)


#: Unexplained shares below this are rounding: moments in doubles, of features that may be nearly collinear, hold no more.
RESIDUAL = 1e-7


def inflation(m: Moments) -> dict[str, float]:
    """Variance inflation factors, 1 / (1 - R2) of each feature on the others; infinite where they determine it."""
    out = {}
    for j, name in enumerate(m.names):
        rest = [i for i in range(len(m.names)) if i != j]
        total = m.xx[j, j]
        explained = m.xx[j, rest] @ np.linalg.lstsq(m.xx[np.ix_(rest, rest)], m.xx[rest, j], rcond=1e-10)[0] if rest else 0.0
        left = 1 - explained / total if total > 0 else 1.0
        out[name] = 1 / left if left > RESIDUAL else float("inf")
    return out


def without_collinear(df: DataFrame, features: Sequence[str], target: str, limit: float = 10.0) -> list[str]:
    """Features less those with a factor above ``limit``, the worst first, until none is."""
    m, kept = moments(df, features, target), list(features)
    while len(kept) > 1:
        at = [m.names.index(c) for c in kept]
        index = [*at, len(m.names)]
        factors = inflation(Moments(tuple(kept), m.n, m.means[index], m.products[np.ix_(index, index)]))
        worst = max(factors, key=factors.get)
        if factors[worst] <= limit:
            break
        kept.remove(worst)
    return kept


def metrics(df: DataFrame, truth: str, predicted: Column) -> DataFrame:
    """One row: n, r2, mse, rmse, mae."""
    e = F.col(truth) - predicted
    mse = F.avg(e * e)
    return df.agg(F.count("*").alias("n"), F.round(1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(truth)), 6).alias("r2"), F.round(mse, 4).alias("mse"), F.round(F.sqrt(mse), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


def grid(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, kind: str, alphas: Sequence[float]) -> tuple[float, Linear, list[tuple[float, float]]]:
    """The alpha with the least mean absolute error on ``test``, its model, and (alpha, error) of all: one pass over each frame."""
    m = moments(train, features, target)
    fits = [(ridge if kind == "ridge" else lasso)(m, a) for a in alphas]
    errors = test.agg(*[F.avg(F.abs(F.col(target) - f.predicted())) for f in fits]).first()
    scored = [(a, float(e)) for a, e in zip(alphas, errors, strict=True) if e is not None]
    best = min(scored, key=lambda x: (x[1], x[0])) if scored else (alphas[0], float("nan"))
    return best[0], fits[list(alphas).index(best[0])], scored


def refined(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, kind: str) -> tuple[float, Linear]:
    """A coarse grid of penalties, then a fine one around its best."""
    coarse = np.logspace(-3, 3, 10) if kind == "ridge" else np.logspace(-4, 1, 10)
    best, _, _ = grid(train, test, features, target, kind, [float(a) for a in coarse])
    fine = np.linspace(best * 0.9, best * 1.1, 20) if kind == "ridge" else np.linspace(best * 0.5, best * 1.5, 10)
    alpha, model, _ = grid(train, test, features, target, kind, [float(a) for a in fine])
    return alpha, model


def coefficients(models: dict[str, Linear]) -> list[tuple]:
    """(feature, weight in each model, whether any model drops it), by falling absolute weight in the first."""
    first = next(iter(models.values()))
    rows = [(c, *[float(m.weights[m.names.index(c)]) for m in models.values()]) for c in first.names]
    return sorted(((*r, any(abs(w) < 1e-9 for w in r[1:])) for r in rows), key=lambda r: -abs(r[1]))


def saved(spark: SparkSession, path: str, parts: dict) -> None:
    """The parts of a model (numbers, strings, lists, arrays) as JSON at a path that Spark writes; replaces what is there."""
    plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in parts.items()}
    spark.createDataFrame([(json.dumps(plain),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def loaded(spark: SparkSession, path: str) -> dict:
    """What :func:`saved` wrote; arrays come as lists."""
    return json.loads(spark.read.text(path).first()[0])


def save_linear(spark: SparkSession, path: str, model: Linear) -> None:
    saved(spark, path, {"names": list(model.names), "intercept": model.intercept, "weights": model.weights})


def load_linear(spark: SparkSession, path: str) -> Linear:
    parts = loaded(spark, path)
    return Linear(tuple(parts["names"]), parts["intercept"], np.array(parts["weights"], float))

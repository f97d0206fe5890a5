"""A support vector machine with the RBF kernel (M5), by random Fourier features.

cos(w . x + b) with w drawn from the kernel's spectrum approximates the kernel,
so a linear machine on those columns is one with the kernel, and training is a
few passes over any number of rows.  All classes are trained together (one
against the rest, squared hinge loss, class weights): a pass gives loss and
gradient of all of them, the driver takes L-BFGS steps on the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.passes import total
from vigil.session import ensure_checkpoint_dir


@dataclass
class KernelMachine:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray            # (feature, column)
    b: np.ndarray            # (column)
    weights: np.ndarray      # (column + 1, class): the last row is the offset

    def columns(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.columns(x) @ self.weights


def _minimise(fn, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving steps; ``fn`` gives (loss, gradient), one pass each."""
    loss, grad = fn(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = -grad, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d = d - a * y
            used.append(a)
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if past else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12))
        while True:
            new_loss, new_grad = fn(x + step * d)
            if new_loss <= loss + 1e-4 * step * (grad @ d) or step < 1e-6:
                break
            step /= 2
        if new_loss >= loss:
            return x
        s, y = step * d, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, small = x + s, loss - new_loss < 1e-7 * max(loss, 1e-12)
        loss, grad = new_loss, new_grad
        if small:
            break
    return x


def fit(df: DataFrame, features: list[str], label: str, classes: int, columns: int = 256, c: float = 10.0,
        gamma: float | None = None, balanced: bool = True, steps: int = 30, seed: int = 42) -> KernelMachine:
    """Fit on rows with a ``label`` in 0 .. classes - 1.  ``gamma`` None is
    1 / (features * variance) of the standardised features, that is 1 / features.
    ``balanced`` weighs a row by rows / (classes * rows of its class)."""
    rows = df.where(F.col(label).isNotNull()).select(*(F.col(f).cast("double").alias(f) for f in features),
                                                     F.col(label).cast("int").alias("_y"))
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.checkpoint()                               # read by every step
    stats = rows.agg(*(F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)),
                     *(F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)),
                     *(F.count(F.when(F.col("_y") == k, 1)).alias(f"n_{k}") for k in range(classes))).first()
    counts = np.array([stats[f"n_{k}"] for k in range(classes)], float)
    n = counts.sum()
    if not n:
        raise ValueError("no labelled rows to fit on")
    mean = np.array([stats[f"m_{i}"] for i in range(len(features))], float)
    scale = np.array([stats[f"s_{i}"] or 1.0 for i in range(len(features))], float)
    rng = np.random.default_rng(seed)
    gamma = 1 / len(features) if gamma is None else gamma
    m = KernelMachine(list(features), mean, scale, rng.normal(0, np.sqrt(2 * gamma), (len(features), columns)),
                      rng.uniform(0, 2 * np.pi, columns), np.zeros((columns + 1, classes)))
    weight = np.where(counts > 0, n / (classes * np.maximum(counts, 1)), 0.0) if balanced else np.ones(classes)
    shape = m.weights.shape

    def objective(flat: np.ndarray):
        now = flat.reshape(shape)

        def part(pdf: pd.DataFrame) -> np.ndarray:
            z = m.columns(pdf[features].to_numpy(float))
            y = pdf["_y"].to_numpy()
            sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
            w = weight[y][:, None]
            lack = np.maximum(0, 1 - sign * (z @ now))
            return np.append((z.T @ (-2 * w * sign * lack)).ravel(), (w * lack * lack).sum())

        s = total(rows, part, flat.size + 1)
        free = now.copy()
        free[-1] = 0                                       # the offset is not held down
        return (c * s[-1] + 0.5 * (free ** 2).sum()) / n, (c * s[:-1] + free.ravel()) / n

    m.weights = _minimise(objective, m.weights.ravel(), steps).reshape(shape)
    return m


def predict(df: DataFrame, model: KernelMachine, out: str = "scores") -> DataFrame:
    """``df`` with the score of each class (array<double>); the class is the place of the largest."""
    @F.pandas_udf("array<double>")
    def scores(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(model.scores(np.stack([c.to_numpy(float) for c in cols], 1))))

    return df.withColumn(out, scores(*(F.col(c).cast("double") for c in model.features)))

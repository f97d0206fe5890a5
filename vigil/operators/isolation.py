"""Isolation forest (M9): anomalies are the rows that random splits set apart early.

Each tree is grown on a small hashed subsample of the rows, so its table is
bounded whatever the input: the rows with the least draws are found by a
threshold on the draw, then ranked.  Trees are grown side by side, one a group.
Scoring walks all trees for a batch of rows at once; the forest (``trees`` times
at most 2 * ``rows`` nodes) goes with the task.

All random draws are arithmetic on whole numbers (:func:`draw`), so any engine
can repeat them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIME = 2_147_483_647
EULER = 0.5772156649015329

NODES = "tree int, node long, feature int, threshold double, size long"


def draw(i, t, salt: int):
    """A number below PRIME from two whole numbers; columns, arrays or integers."""
    wrap = F.pmod if isinstance(i, Column) or isinstance(t, Column) else np.mod
    p = F.lit(PRIME) if wrap is F.pmod else PRIME
    i = wrap(i, p)
    x = wrap(i * 1103 + t * 7919 + salt, p)
    x = wrap(x * x + i, p)
    return wrap(x * 48_271, p)


def expected_path(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


def subsamples(df: DataFrame, key: str, trees: int, rows: int, seed: int) -> DataFrame:
    """For each tree the ``rows`` rows of least (draw, key), with column ``tree``."""
    n = df.count()
    want, share = min(rows, n), 4 * rows / max(n, 1)
    while True:
        limit = min(PRIME, math.ceil(share * PRIME))
        taken = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                         lambda t: draw(F.col(key).cast("long"), t.cast("long"), seed) < limit)
        found = df.withColumn("tree", F.explode(taken))
        found = found.withColumn("_draw", draw(F.col(key).cast("long"), F.col("tree").cast("long"), seed))
        least = found.groupBy("tree").count().agg(F.count("*").alias("trees"), F.min("count").alias("rows")).first()
        if limit == PRIME or (least["trees"] == trees and least["rows"] >= want):
            break
        share *= 4
    w = Window.partitionBy("tree").orderBy("_draw", key)
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= rows).drop("_draw", "_rank")


def grow(df: DataFrame, features: list[str], key: str, trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """The forest as a table (tree, node, feature, threshold, size): node 1 is the
    root, 2n and 2n + 1 the children of n (below, and from, the threshold on), a
    leaf has feature null.  ``key`` is a whole number that tells rows apart."""
    depth = math.ceil(math.log2(max(rows, 2)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x, out = int(pdf["tree"].iloc[0]), pdf[features].to_numpy(float), []
        todo = [(1, np.arange(len(x)))]
        for node, at in todo:
            low, high = (x[at].min(0), x[at].max(0)) if len(at) else (np.zeros(0), np.zeros(0))
            free = np.flatnonzero(high > low)
            if len(at) <= 1 or not len(free) or node >= 1 << depth:
                out.append((t, node, None, None, len(at)))
                continue
            f = free[int(draw(node, t, seed + 1)) % len(free)]
            cut = low[f] + (high[f] - low[f]) * (int(draw(node, t, seed + 2)) / PRIME)
            out.append((t, node, int(f), float(cut), len(at)))
            right = x[at, f] >= cut
            todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "size"]).astype({"feature": "Int32"})

    picked = subsamples(df.select(key, *features), key, trees, rows, seed)
    return picked.groupBy("tree").applyInPandas(one, NODES)


def score(df: DataFrame, forest: DataFrame, features: list[str], rows: int = 256, out: str = "anomaly") -> DataFrame:
    """``df`` with the anomaly score 2 ** (-mean path / expected path): near 1
    where few splits suffice, under 0.5 for ordinary rows."""
    nodes = forest.toPandas()                                   # trees x 2 rows nodes at most
    if nodes.empty:
        return df.withColumn(out, F.lit(None).cast("double"))
    at = (nodes["tree"].rank(method="dense").astype(int) - 1).to_numpy(), nodes["node"].to_numpy()
    shape = at[0].max() + 1, 2 * int(at[1].max()) + 2
    feature, cut, size = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
    feature[at], cut[at] = nodes["feature"].fillna(-1).to_numpy(int), nodes["threshold"].fillna(0).to_numpy(float)
    size[at] = nodes["size"].to_numpy(float)
    tail, whole, tree = expected_path(size), float(expected_path(rows)), np.arange(shape[0])

    def paths(x: np.ndarray) -> np.ndarray:
        node = np.ones((len(x), shape[0]), np.int64)
        depth = np.zeros(node.shape)
        row = np.arange(len(x))[:, None]
        while True:
            f = feature[tree, node]
            inner = f >= 0
            if not inner.any():
                return (depth + tail[tree, node]).mean(1)
            right = x[row, np.maximum(f, 0)] >= cut[tree, node]
            node = np.where(inner, 2 * node + right, node)
            depth += inner

    @F.pandas_udf("double")
    def scores(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], 1)
        parts = [paths(x[i:i + 2000]) for i in range(0, len(x), 2000)]
        return pd.Series(2.0 ** (-np.concatenate(parts) / whole) if parts else np.zeros(0))

    return df.withColumn(out, scores(*(F.col(c).cast("double") for c in features)))

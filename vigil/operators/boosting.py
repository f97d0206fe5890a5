"""Gradient boosted trees for several classes at once (M2).

Softmax loss, second-order gains.  Features are binned once by quantiles and
the rows kept in blocks (:func:`vigil.operators.passes.blocks`).  A round grows
one tree for each class, level by level: one pass over the blocks sums gradients
and curvatures of all classes, open nodes, features and bins inside the tasks
(:func:`vigil.operators.passes.total`), the driver picks the splits from those
sums, whose size depends on the model only; the sums beside a split are those of
its two children, so the leaves of the last level need no pass.  The margins of
the rows are written every few rounds; in between a pass adds the trees since.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.passes import blocks, total
from vigil.session import ensure_checkpoint_dir

TREES = "round int, class int, node int, feature string, threshold double, value double"


@dataclass
class Booster:
    """Trees as arrays by (round, class, node): node 0 is the root, 2n + 1 and
    2n + 2 are the children of n; a row goes right where its feature is above the
    threshold.  ``bin`` is the threshold's place among the feature's cuts."""
    features: list[str]
    cuts: list[np.ndarray]
    classes: int
    depth: int
    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)      # (class, node), -1: leaf
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)        # (class, node)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bins of the rows ``x``, by feature."""
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)])

    def places(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node every row has come to after ``levels`` levels, by class."""
        node, row = np.zeros((self.classes, bins.shape[1]), np.int64), np.arange(bins.shape[1])
        for k in range(self.classes):
            for _ in range(self.depth if levels is None else levels):
                f = feature[k][node[k]]
                right = bins[np.maximum(f, 0), row] > cut[k][node[k]]
                node[k] = np.where(f >= 0, 2 * node[k] + 1 + right, node[k])
        return node

    def margins(self, bins: np.ndarray, start: int = 0, margin: np.ndarray | None = None) -> np.ndarray:
        """The margins of the rows, by class."""
        out = np.repeat(self.base[:, None], bins.shape[1], 1) if margin is None else margin.copy()
        for f, b, v in zip(self.feature[start:], self.bin[start:], self.value[start:], strict=True):
            out += np.take_along_axis(v, self.places(bins, f, b), 1)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, feature, threshold, value): round -1 has the base margins; inner nodes have a feature."""
        rows = [(-1, k, 0, None, None, float(v)) for k, v in enumerate(self.base)]
        for r, (f, b, v) in enumerate(zip(self.feature, self.bin, self.value, strict=True)):
            for k in range(self.classes):
                todo = [0]
                for n in todo:
                    j = int(f[k, n])
                    rows.append((r, k, n, self.features[j], float(self.cuts[j][b[k, n]]), None) if j >= 0
                                else (r, k, n, None, None, float(v[k, n])))
                    todo += [2 * n + 1, 2 * n + 2] if j >= 0 else []
        return spark.createDataFrame(rows, TREES)


def softmax(m: np.ndarray) -> np.ndarray:
    """Class probabilities of margins by class."""
    e = np.exp(m - m.max(0))
    return e / e.sum(0)


def fit(df: DataFrame, features: list[str], label: str, classes: int, rounds: int = 50, depth: int = 6, rate: float = 0.1,
        bins: int = 32, smooth: float = 1.0, least: float = 1.0, weight: str | None = None, keep_every: int = 10) -> Booster:
    """Fit on rows with finite ``features`` and a ``label`` in 0 .. classes - 1;
    rows without a label take no part.  ``least`` is the curvature a child must
    have, ``smooth`` is added to every curvature."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in features),
                                                     F.col(label).cast("int").alias("_y"),
                                                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = rows.checkpoint()
    q = rows.approxQuantile(features, [i / bins for i in range(1, bins)], 1e-3)
    share = np.zeros(classes)
    for r in rows.groupBy("_y").agg(F.sum("_w").alias("w")).collect():
        share[r["_y"]] = r["w"]
    if not share.sum():
        raise ValueError("no labelled rows to fit on")
    base = np.log(np.maximum(share, 1e-9) / share.sum())
    b = Booster(list(features), [np.unique(c) for c in q], classes, depth, base)
    wide, n_features, done = bins, len(features), 0
    small = np.min_scalar_type(bins)

    def pack(pdf: pd.DataFrame) -> dict:
        x = b.binned(pdf[features].to_numpy(float)).astype(small)
        return {"x": x, "y": pdf["_y"].to_numpy(np.int32), "w": pdf["_w"].to_numpy(float), "m": b.margins(x)}
    rows = blocks(rows, pack, ["x", "y", "w", "m"]).checkpoint()

    def read(block, start: int):
        x = np.frombuffer(block.x, small).reshape(n_features, -1)
        return x, b.margins(x, start, np.frombuffer(block.m).reshape(classes, -1))

    for r in range(rounds):
        if r and r % keep_every == 0:
            start, done_now = done, r

            def moved(batches, start=start):
                for pdf in batches:
                    yield pdf.assign(m=[read(block, start)[1].tobytes() for block in pdf.itertuples()])
            rows = rows.mapInPandas(moved, rows.schema).checkpoint()
            done = done_now
        feature = np.full((classes, (1 << depth + 1) - 1), -1, np.int64)
        cut, value = np.zeros_like(feature), np.zeros(feature.shape)
        for level in range(max(depth, 1)):
            first, open_nodes = (1 << level) - 1, 1 << level

            def sums(pdf: pd.DataFrame, first=first, open_nodes=open_nodes, level=level, feature=feature, cut=cut, start=done) -> np.ndarray:
                out = np.zeros((2, n_features, classes, open_nodes * wide))
                for block in pdf.itertuples():
                    x, m = read(block, start)
                    p, y, w = softmax(m), np.frombuffer(block.y, np.int32), np.frombuffer(block.w)
                    g = (p - (y == np.arange(classes)[:, None])) * w
                    h = p * (1 - p) * w
                    node = b.places(x, feature, cut, level) - first
                    for k in range(classes):
                        here = np.flatnonzero(node[k] >= 0) if level else slice(None)
                        cell, gk, hk = node[k][here] * wide, g[k][here], h[k][here]
                        for j in range(n_features):
                            at = cell + x[j][here]
                            out[0, j, k] += np.bincount(at, gk, open_nodes * wide)
                            out[1, j, k] += np.bincount(at, hk, open_nodes * wide)
                return out.ravel()

            g, h = total(rows, sums, 2 * n_features * classes * open_nodes * wide).reshape(2, n_features, classes, open_nodes, wide)
            whole_g, whole_h = g[0].sum(-1), h[0].sum(-1)                     # (class, node)
            value[:, first:first + open_nodes] = -rate * whole_g / (whole_h + smooth)
            if level == depth:
                break
            left_g, left_h = g.cumsum(-1), h.cumsum(-1)
            right_g, right_h = whole_g[..., None] - left_g, whole_h[..., None] - left_h
            gain = (left_g ** 2 / (left_h + smooth) + right_g ** 2 / (right_h + smooth)
                    - (whole_g ** 2 / (whole_h + smooth))[..., None])
            gain[(left_h < least) | (right_h < least)] = -np.inf
            for j, c in enumerate(b.cuts):
                gain[j, ..., len(c):] = -np.inf                              # no cut there
            flat = np.moveaxis(gain, 0, 2).reshape(classes, open_nodes, -1)
            best = flat.argmax(-1)
            good = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-9
            reached = whole_h > 0
            feature[:, first:first + open_nodes] = np.where(good & reached, best // wide, -1)
            cut[:, first:first + open_nodes] = best % wide
            # what lies beside the cut is what the children hold
            at, k, node = (best // wide, *np.ogrid[:classes, :open_nodes])
            for s, (sg, sh) in enumerate(((left_g, left_h), (right_g, right_h))):
                value[:, 2 * first + 1 + s:2 * (first + open_nodes) + s:2] = (
                    -rate * sg[at, k, node, best % wide] / (sh[at, k, node, best % wide] + smooth))
            if not (good & reached).any():
                break
        b.feature.append(feature)
        b.bin.append(cut)
        b.value.append(value)
    return b


def predict(df: DataFrame, model: Booster, out: str = "probabilities") -> DataFrame:
    """``df`` with the class probabilities (they add up to 1) as array<double>."""
    @F.pandas_udf("array<double>")
    def probabilities(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], 1)
        return pd.Series(list(softmax(model.margins(model.binned(x))).T))

    return df.withColumn(out, probabilities(*(F.col(c).cast("double") for c in model.features)))

"""Classifiers whose parameters are plain aggregates: fitted in one grouped
aggregation each, applied as Column expressions (so also to a stream), kept as
a small JSON bundle (K6, K7).  Classes weigh alike, as balanced class weights do."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.sinks import read_text, write_text

FLOOR = 1e-6                 # added to every variance


def _shares(scores: list[Column]) -> Column:
    """Scores (logarithms) to probabilities."""
    top = F.greatest(*scores)
    e = F.array(*(F.exp(s - top) for s in scores))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


@dataclass
class GaussianBayes:
    """Independent normal features in each class."""
    features: list[str]
    mean: list[list[float]]
    variance: list[list[float]]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, classes: int) -> GaussianBayes:
        stats = df.groupBy(label).agg(*(F.struct(F.avg(f).alias("m"), F.var_pop(f).alias("v")).alias(f) for f in features))
        found = {r[label]: r for r in stats.where(F.col(label).isNotNull()).collect()}
        pick = lambda c, f, p, other: found[c][f][p] if c in found and found[c][f][p] is not None else other
        return cls(list(features), [[pick(c, f, "m", math.inf) for f in features] for c in range(classes)],
                   [[pick(c, f, "v", 0.0) + FLOOR for f in features] for c in range(classes)])

    def probabilities(self) -> Column:
        return _shares([sum((F.lit(-0.5) * (math.log(2 * math.pi * v) + (F.col(f) - m) * (F.col(f) - m) / v)
                             for f, m, v in zip(self.features, ms, vs, strict=True)), F.lit(0.0))
                        for ms, vs in zip(self.mean, self.variance, strict=True)])


@dataclass
class Centroids:
    """Distance to the class means, in standard deviations of each feature."""
    features: list[str]
    centre: list[list[float]]
    scale: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str, classes: int) -> Centroids:
        known = df.where(F.col(label).isNotNull())
        spread = known.agg(*(F.stddev_pop(f).alias(f) for f in features)).first()
        means = {r[label]: r for r in known.groupBy(label).agg(*(F.avg(f).alias(f) for f in features)).collect()}
        return cls(list(features), [[means[c][f] if c in means else math.inf for f in features] for c in range(classes)],
                   [spread[f] or 1.0 for f in features])

    def probabilities(self) -> Column:
        far = [sum(((F.col(f) - m) / s * ((F.col(f) - m) / s) for f, m, s in zip(self.features, c, self.scale, strict=True)), F.lit(0.0))
               for c in self.centre]
        return _shares([-d for d in far])


@dataclass
class BinnedBayes:
    """How often a class has each range of one feature, one count added to all."""
    feature: str
    edges: list[float]
    share: list[list[float]]

    @classmethod
    def fit(cls, df: DataFrame, feature: str, edges: list[float], label: str, classes: int) -> BinnedBayes:
        where = cls(feature, edges, []).place()
        n = {(r[label], r["bin"]): r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label, where.alias("bin"))
             .agg(F.count("*").alias("n")).collect()}
        bins = len(edges) + 1
        whole = [sum(n.get((c, b), 0) for b in range(bins)) + bins for c in range(classes)]
        return cls(feature, list(edges), [[(n.get((c, b), 0) + 1) / whole[c] for b in range(bins)] for c in range(classes)])

    def place(self) -> Column:
        return sum(((F.col(self.feature) >= e).cast("int") for e in self.edges), F.lit(0))

    def probabilities(self) -> Column:
        return _shares([F.log(F.element_at(F.array(*map(F.lit, s)), self.place() + 1)) for s in self.share])


KINDS = {k.__name__: k for k in (GaussianBayes, Centroids, BinnedBayes)}


def save(spark: SparkSession, path: str, models: list) -> None:
    write_text(spark, path, json.dumps([{"kind": type(m).__name__, **asdict(m)} for m in models]))


def load(spark: SparkSession, path: str) -> list:
    return [KINDS[m.pop("kind")](**m) for m in json.loads(read_text(spark, path))]

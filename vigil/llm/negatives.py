"""Hard negatives by inner product, with coordinate pruning.

Rows are dealt to buckets of similar length (a range partition by length, ties
dealt by a hash, so copies of one vector fill several buckets).  A bucket keeps
for every coordinate the list of its rows sorted by that coordinate of their
unit vector.  A row scores at least ``theta`` with an anchor ``a`` only if its
cosine is at least t = theta / (|a| * longest length of the bucket), and then its
coordinate f lies within  a_f t -+ sqrt((1 - a_f^2) (1 - t^2))  (a the unit
anchor; up to 1 where a_f >= t, down to -1 where -a_f >= t).  For the anchor's
largest coordinates, the focus, these ranges are looked up in the sorted lists
and intersected; what is left is scored exactly.  Buckets whose longest row is
too short are never sent the anchor.

Three passes: the anchor's own bucket gives a first ``theta`` (its k-th same-label
score there), all buckets give the positives, and 80 % of the least positive
score is the ``theta`` of the negatives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import materialize

BLOCK_ROWS = (256, 32_768)      # rows of a bucket: as many buckets as keep four for each shuffle partition within this
MAX_BLOCKS = 65_536             # buckets at most: their lengths (a row of 24 bytes each) are broadcast
ANCHORS = 8_192                 # anchors of one group of a bucket
FOCUS = 4                       # coordinates whose ranges are intersected
SLACK = 1e-9                    # of every bound: pruning is in floating point, scores are not

_KEY = ["vec_id", "label", "same"]


# ------------------------------------------------------------- one bucket

def quantised(vectors: list, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of equally long vectors: doubles, exact integers below
    2**44, else Python integers."""
    x = np.asarray(vectors, np.float64).reshape(len(vectors), -1)
    if x.size and np.abs(x).max() >= 2.0 ** 36:
        # beyond 2**60 a double is an integer, and scale * x may not be one any more
        return np.array([[math.floor(v * scale) if abs(v) < 2.0 ** 60 else int(v) * scale for v in r] for r in x.tolist()],
                        object).reshape(x.shape)
    return np.floor(x * scale)


class Bucket:
    """Rows of one length bucket with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.x = quantised([vectors[i] for i in order])
        self.exact = self.x.dtype != object
        if self.exact:
            self.top = np.abs(self.x).max(initial=0)
            self.norms = np.sqrt((self.x ** 2).sum(1))
            self.longest = self.norms.max(initial=0)
            self.unit = self.x / np.where(self.norms > 0, self.norms, 1)[:, None]
            self.order = np.argsort(self.unit, axis=0, kind="stable")
            self.lists = np.take_along_axis(self.unit, self.order, 0)

    def scores(self, a: np.ndarray, rows) -> np.ndarray:
        """Exact integer inner products: long where they fit, else Python integers."""
        if self.exact and a.dtype != object and self.top * np.abs(a).max(initial=0) * max(len(a), 1) < 2.0 ** 53:
            x = self.x if isinstance(rows, slice) or 2 * len(rows) > len(self.x) else self.x[rows]
            s = (x @ a).astype(np.int64)
            return s if x is not self.x else s[rows]
        big = [int(v) for v in a]
        return np.array([sum(int(p) * q for p, q in zip(r, big, strict=True)) for r in self.x[rows]] or [0], object)[:len(self.x[rows])]

    def candidates(self, a: np.ndarray, theta: float):
        """Rows (a slice or their places) that may score ``theta`` or more."""
        everything = slice(0, len(self.ids))
        if not self.exact or a.dtype == object or not theta > 0:
            return everything                                   # a score of 0 or less bounds no coordinate
        length = math.sqrt(float((a ** 2).sum()))
        t = theta * (1 - SLACK) / max(length * self.longest, 1e-300)
        if t > 1:
            return np.zeros(0, np.int64)
        u = a / length
        focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        mid, half = u[focus] * t, np.sqrt(np.maximum((1 - u[focus] ** 2) * (1 - t * t), 0))
        low = np.where(-u[focus] >= t, -1, mid - half) - SLACK
        high = np.where(u[focus] >= t, 1, mid + half) + SLACK
        spans = [(np.searchsorted(self.lists[:, f], lo), np.searchsorted(self.lists[:, f], hi, "right"))
                 for f, lo, hi in zip(focus, low, high, strict=True)]
        best = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        rows = self.order[slice(*spans[best]), focus[best]]
        for i, f in enumerate(focus):
            if i != best:
                c = self.unit[rows, f]
                rows = rows[(c >= low[i]) & (c <= high[i])]
        return rows[self.norms[rows] * length >= theta * (1 - SLACK)]

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``rows`` of the k highest scores, ties by smaller id."""
        at = np.arange(len(rows))
        if len(at) > k and scores.dtype != object:
            at = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
        s = scores[at]
        order = sorted(range(len(at)), key=lambda i: (-s[i], self.ids[rows[at[i]]])) if s.dtype == object else np.lexsort(
            (self.ids[rows[at]], -s))
        return at[order[:k]]

    def positives(self, vec_id: int, label: int, a: np.ndarray, theta: float, k: int):
        """(ids, scores) of the k best other rows of the anchor's label with at least ``theta``."""
        rows = np.arange(len(self.ids))[self.candidates(a, theta)]
        rows = rows[(self.labels[rows] == label) & (self.ids[rows] != vec_id)]
        s = self.scores(a, rows)
        at = self.best(rows, s, k)
        return self.ids[rows[at]], s[at]

    def negatives(self, label: int, a: np.ndarray, scores: list[int], k: int):
        """(place of the positive, id, score): the k best rows of other labels within 80 to 100 % of each positive score."""
        useful = [s for s in scores if s >= 0]
        if not useful:
            return
        rows = np.arange(len(self.ids))[self.candidates(a, 0.8 * min(useful))]
        rows = rows[self.labels[rows] != label]
        s = self.scores(a, rows)
        found: dict[int, list] = {}
        for i, p in enumerate(scores):
            if p not in found:
                inside = np.flatnonzero((100 * s >= 80 * p) & (s <= p)) if p >= 0 else np.zeros(0, np.int64)
                at = inside[self.best(rows[inside], s[inside], k)]
                found[p] = list(zip(self.ids[rows[at]].tolist(), s[at].tolist(), strict=True))
            for v, x in found[p]:
                yield i, v, x


def _long(scores) -> list[int]:
    """Scores as 64-bit integers; beyond them the nearest one (only an output's limit)."""
    return [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores]


# --------------------------------------------------------------- the passes

def buckets(vectors: DataFrame, shift: Column) -> DataFrame:
    """The rows that take part, in length buckets: vec_id, label (after
    ``shift``), same (hash of the vector), embedding, dim, norm, block."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), shift.cast("long").alias("label"),
                    F.xxhash64(e).alias("same"), e, F.size(e).alias("dim"), norm.alias("norm")))
    n = rows.count()
    wanted = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(MAX_BLOCKS, max(math.ceil(n / BLOCK_ROWS[1]), min(wanted, math.ceil(n / BLOCK_ROWS[0])), 1))
    rows = rows.repartitionByRange(k, "dim", "norm", F.xxhash64("vec_id")).withColumn("block", F.spark_partition_id())
    return materialize(rows, "length-buckets")


def first_bounds(rows: DataFrame, anchor, k: int) -> DataFrame:
    """The anchors (one of each repeated row) with ``theta``: the k-th score of
    their label in their own bucket, null with fewer."""
    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[anchor(pdf["vec_id"].to_numpy())].drop_duplicates(_KEY)
        theta = []
        if len(mine):
            b = Bucket(pdf["vec_id"].to_numpy(), pdf["label"].to_numpy(), list(pdf["embedding"]))
            for r in mine.itertuples():
                s = b.positives(r.vec_id, r.label, quantised([r.embedding])[0], -math.inf, k)[1]
                theta.append(float(s[-1]) if len(s) == k else None)
        return mine.assign(theta=theta)[[*_KEY, "embedding", "dim", "norm", "theta"]]

    kind = rows.schema["embedding"].dataType.simpleString()
    # a repeated row has one length and one hash, so its copies share a bucket
    return materialize(rows.groupBy("block", "dim").applyInPandas(
        bound, f"vec_id long, label long, same long, embedding {kind}, dim int, norm double, theta double"), "anchors")


def visit(rows: DataFrame, anchors: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(bucket, anchor)`` -> result rows, for every anchor and every bucket
    long enough for its ``theta``; the rows of a bucket meet the anchors in
    groups of about ANCHORS."""
    chunks = max(1, math.ceil(anchors.count() / ANCHORS))
    lengths = rows.groupBy("block", "dim").agg(F.max("norm").alias("longest"))
    # lengths before and after floor(256 x) differ by at most sqrt(dim) / 256 each
    wide = lambda c: F.col(c) * 256 + F.sqrt("dim")
    enough = F.col("theta").isNull() | (wide("norm") * wide("longest") >= F.col("theta") * (1 - SLACK))
    sent = (anchors.join(F.broadcast(lengths), "dim").where(enough)
            .withColumn("chunk", F.pmod(F.xxhash64(*_KEY), F.lit(chunks)).cast("int")))
    held = rows.select("vec_id", "label", "embedding", F.col("dim").alias("held_dim"), F.col("block").alias("held_block"),
                       F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("held_chunk"))

    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            bucket = Bucket(b["vec_id"].to_numpy(), b["label"].to_numpy(), list(b["embedding"]))
            for r in a.itertuples():
                out.extend((r.vec_id, r.label, r.same, *x) for x in fn(bucket, r))
        return pd.DataFrame(out, columns=[p.split()[0] for p in schema.split(", ")])

    return (sent.drop("norm", "longest").groupBy("block", "dim", "chunk")
            .cogroup(held.groupBy("held_block", "held_dim", "held_chunk")).applyInPandas(run, schema))


def mine(vectors: DataFrame, anchor=lambda i: i % 100 == 0, label: Column | None = None, positives: int = 5,
         negatives: int = 5) -> DataFrame:
    """For every anchor and each of its ``positives`` best rows of its label, the
    ``negatives`` best rows of other labels that score 80 to 100 % of the positive:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchor`` tells anchors from an array of ids, ``label`` gives the label to use
    (default: the column's).  Components are floor(256 x); scores are exact
    integers, ties go to the smaller vec_id.  Rows without vec_id, label or vector, or with a null or non-finite
    component, take no part; vectors of another length have no score with the
    anchor.  A zero vector scores 0; an empty vector scores 0 with empty ones.
    Rows that repeat a vec_id are rows of their own, but never "other" rows of an
    anchor of that id; an anchor row that is repeated whole is one anchor.
    Positives of negative score have no negatives.  Scores beyond 64 bits are compared
    exactly within a bucket and returned as the nearest long.
    """
    rows = buckets(vectors, F.col("label") if label is None else label)
    anchors = first_bounds(rows, anchor, positives)
    found = visit(rows, anchors, lambda b, r: zip(*(lambda ids, s: (ids.tolist(), _long(s)))(*b.positives(
        r.vec_id, r.label, quantised([r.embedding])[0], -math.inf if r.theta is None or math.isnan(r.theta) else r.theta,
        positives)), strict=True), "vec_id long, label long, same long, positive_id long, positive_score long")
    by_score = Window.partitionBy(*_KEY).orderBy(F.desc("positive_score"), "positive_id")
    chosen = (found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
              .groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen")))
    least = F.array_min(F.filter(F.col("chosen.positive_score"), lambda s: s >= 0))
    second = materialize(anchors.drop("theta").join(chosen, _KEY).where(least.isNotNull())
                         .withColumn("theta", least * 0.8).withColumn("scores", F.col("chosen.positive_score"))
                         .drop("chosen"), "anchors-positives")
    near = visit(rows, second, lambda b, r: ((i + 1, v, x) for i, v, x in b.negatives(
        r.label, quantised([r.embedding])[0], [int(s) for s in r.scores], negatives)),
        "vec_id long, label long, same long, place int, negative_id long, negative_score long")
    by_score = Window.partitionBy(*_KEY, "place").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    pairs = chosen.select(*_KEY, F.inline("chosen"))
    return near.join(pairs, [*_KEY, "place"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")

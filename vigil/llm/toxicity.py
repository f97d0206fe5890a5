"""Toxicity by weak supervision (operator 4).

1. A bounded sample of labelled rows (``FIT_ROWS``, the smallest hashes of
   the ids that may teach) is read with its texts; of copies and near copies
   (an equal minimal shingle under any of three orders) one teaches.
2. Word and word-prefix features that stand with toxic labels are mined from
   the sample (signed likelihood ratio) and dealt to lexicon voters; pattern
   voters look at repetition, density and a short list of insults; one voter
   speaks for "clean" where no lexicon has a hit, one is the annotator's label.
3. A generative label model (expectation maximisation over the vote
   patterns) estimates how every voter votes given the hidden class, then the
   correlations of voters within a class, and discounts correlated voters.
4. A linear classifier (logistic regression) is trained on the posterior
   labels with features of the text alone; it scores every whole text.

Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts are scored by the intercept of a text
without words; rows without a label are scored like all others; repeated
labels of an id count once (the larger); with no labelled rows, or labels of
one class only, every score is that class's share (0.0 without any); repeated
documents return one row each; an empty table an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import BYTE, MULT, _powers, give_back, map_texts, materialize, mix, shingle_sets, slices, words_of

FIT_ROWS = 24_000     # labelled rows the model is fitted on, at most
SLICE = 250_000       # characters whose features are held at once
TASK = 4_000_000      # characters of a partition of the sample
LEAST_G2 = 20.0       # likelihood ratio an entry needs
LEAST_ODDS = 4.0      # log odds an entry needs
VOTERS = 12           # lexicon voters
BUCKETS = 32          # lexicon inputs of the classifier
REJECT = 0.7          # score from which a document counts as toxic
PREFIXES = (4, 5, 6)  # bytes

# Common insults, a voter of their own.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown",
           "fool", "dumb", "jerk", "creep", "freak", "garbage", "filth", "vermin", "bastard", "imbecile", "cretin",
           "hate", "despise", "shut", "ugly", "coward", "liar", "pig", "rat", "maggot", "parasite")

_LETTERS = np.ones(256, bool)          # separators: everything in ASCII but letters
_LETTERS[65:91] = _LETTERS[97:123] = False
_LETTERS[128:] = False


def may_teach(doc_id: Column) -> Column:
    """Rows whose label may be learned from (the others are held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def features_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, text index, word index) of every word and word prefix."""
    h, doc, start, end, buf = words_of(texts, _LETTERS)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    p, inv = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * p[:len(buf)], out=acc[1:])
    out, where, word = [h], [doc], [np.arange(len(h))]
    for k in PREFIXES:
        i = np.flatnonzero(end - start >= k)
        s = start[i]
        out.append(mix((acc[s + k] - acc[s]) * inv[s] + MULT[k % 7]))
        where.append(doc[i])
        word.append(i)
    return np.concatenate(out), np.concatenate(where), np.concatenate(word)


@dataclass
class Model:
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))   # sorted feature hashes
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))                 # their log odds
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    base: float | None = 0.0              # the constant score where nothing could be fitted
    accuracy: dict = field(default_factory=dict)

    def inputs(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(classifier inputs, lexicon voters' hits) of every text."""
        n = len(texts)
        x, hits = np.zeros((n, BUCKETS + 4)), np.zeros((n, VOTERS), np.int32)
        for part in slices(texts, SLICE):
            h, doc, word = features_of(texts[part])
            if not len(h):
                continue
            at = np.searchsorted(self.lexicon, h)
            at[at == len(self.lexicon)] = 0
            ok = np.flatnonzero(self.lexicon[at] == h) if len(self.lexicon) else np.zeros(0, np.int64)
            f, d, w = at[ok], doc[ok] + part.start, word[ok]
            np.add.at(hits, (d, f % VOTERS), 1)
            # the strongest entry of each word counts
            best = np.zeros(int(word.max()) + 1)
            np.maximum.at(best, w, self.odds[f])
            of = np.zeros(len(best), np.int64)
            of[w] = d
            bucket = np.zeros(len(best), np.int64)
            top = self.odds[f] >= best[w]
            bucket[w[top]] = f[top] % BUCKETS
            hit = np.flatnonzero(best > 0)
            np.add.at(x, (of[hit], bucket[hit]), best[hit])
            np.add.at(x, (of[hit], BUCKETS), 1.0)
            words = np.bincount(doc[:int(word.max()) + 1], minlength=part.stop - part.start)
            x[part, BUCKETS + 1] = words
        total = x[:, :BUCKETS].sum(1)
        size = x[:, BUCKETS + 1].copy()
        x[:, BUCKETS + 1] = np.where(size > 0, 100 * x[:, BUCKETS] / np.maximum(size, 1), 0)
        x[:, BUCKETS + 2] = total > 0
        x[:, BUCKETS + 3] = np.minimum(total, 20) / 5
        x[:, :BUCKETS] = np.log1p(x[:, :BUCKETS])
        x[:, BUCKETS] = np.log1p(x[:, BUCKETS])
        return x, hits

    def scores(self, texts: list) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), float(self.base))
        x, _ = self.inputs(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def _teachers(sample: DataFrame) -> DataFrame:
    """Ids of the sample, one of each group of copies and near copies of one label:
    texts whose minimal shingles agree in three orders (at most FIT_ROWS rows of
    five numbers reach the driver).  Texts that only share a passage seldom do."""
    def run(texts):
        low = [[0] * len(texts) for _ in range(3)]
        for part in slices(texts, SLICE):
            doc, h = shingle_sets(texts[part])
            if len(doc):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                for j in range(3):
                    for d, v in zip(doc[first], np.minimum.reduceat(mix(h + MULT[j]), first), strict=True):
                        low[j][part.start + int(d)] = int(v.view(np.int64))
        return low

    kind = sample.schema["_id"].dataType
    rows = map_texts(sample, ["_id", "toxic"], "text", run, {"m0": "long", "m1": "long", "m2": "long"}).toPandas()
    rows = rows.sort_values(["_id", "m0"]).drop_duplicates("_id")
    rows = rows[(rows["m0"] == 0) | ~rows.duplicated(["m0", "m1", "m2", "toxic"])]
    return sample.sparkSession.createDataFrame([(v,) for v in rows["_id"].tolist()], T.StructType([T.StructField("_id", kind)]))


def _once_a_text(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, text index) of every different feature of every text."""
    h, doc, _ = features_of(texts)
    _, first = np.unique(mix(h + mix(doc.astype(np.uint64))), return_index=True)
    return h[first], doc[first]


def _ratios(p: Column, n: Column, n_pos: int, n_neg: int) -> tuple[Column, Column]:
    """(likelihood ratio, log odds) of a feature in p of n_pos toxic and n of n_neg other texts."""
    def part(o, e):
        return F.when(o > 0, 2 * o * F.log(o / e)).otherwise(F.lit(0.0))

    whole, both = n_pos + n_neg, p + n
    cells = [(p, both * n_pos / whole), (n, both * n_neg / whole),
             (n_pos - p, (whole - both) * n_pos / whole), (n_neg - n, (whole - both) * n_neg / whole)]
    g2 = part(*cells[0])
    for o, e in cells[1:]:
        g2 = g2 + part(o, e)
    return g2, F.log((p + 0.5) / (n_pos + 1.0)) - F.log((n + 0.5) / (n_neg + 1.0))


def _lexicon(sample: DataFrame, n_pos: int, n_neg: int) -> pd.DataFrame:
    """Every entry that passes both tests: feature, log odds.

    Toxic texts are counted first.  Only what would pass if no other text had it
    is then counted in the others, so every count is over the whole sample,
    however it is cut, and what moves is small."""
    def in_toxic(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in slices(texts, SLICE):
                ids, n = np.unique(_once_a_text(texts[part])[0], return_counts=True)
                yield pd.DataFrame({"f": ids.view(np.int64), "p": n})
        give_back()

    p, none = F.col("p"), F.lit(0)
    toxic = sample.where("toxic = 1").mapInPandas(in_toxic, "f long, p long").groupBy("f").agg(F.sum("p").alias("p"))
    g2, odds = _ratios(p, none, n_pos, n_neg)
    found = toxic.where((p >= 3) & (g2 > LEAST_G2) & (odds > LEAST_ODDS)).toPandas()   # of at most fit_rows texts
    known = np.sort(found["f"].to_numpy(np.int64).view(np.uint64))

    def in_others(batches):
        for pdf in batches:
            texts, n = pdf["text"].tolist(), np.zeros(len(known), np.int64)
            for part in slices(texts, SLICE):
                h = _once_a_text(texts[part])[0]
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                n += np.bincount(at[known[at] == h], minlength=len(known)) if len(known) else 0
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"f": known[seen].view(np.int64), "n": n[seen]})
        give_back()

    spark = sample.sparkSession
    others = sample.where("toxic IS NULL OR toxic <> 1").mapInPandas(in_others, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    both = spark.createDataFrame(found, "f long, p long").join(others, "f", "left").withColumn("n", F.coalesce("n", none))
    g2, odds = _ratios(p, F.col("n"), n_pos, n_neg)
    return both.where((odds > LEAST_ODDS) & (g2 > LEAST_G2)).select("f", odds.alias("odds")).toPandas()


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns (-1 clean, 0 silent, 1
    toxic): (posterior of each pattern, P(vote | class) as [voter, class, vote],
    weight of each voter).  Voters that agree beyond what the class explains
    are correlated, and share one say; to begin with, voters that agree nearly
    always do."""
    v = votes.astype(np.int64) + 1
    n_p, n_v = v.shape

    def agreement(w: np.ndarray) -> np.ndarray:
        z = votes - (w[:, None] * votes).sum(0) / w.sum()
        cov = (z * w[:, None]).T @ z / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(rho, 0)
        return rho

    weight = 1 / (1 + (agreement(counts) ** 8).sum(1))
    post = np.clip((votes @ weight + 1e-3) / (2 * np.abs(votes) @ weight + 1e-3) + 0.5, 0.02, 0.98)
    theta = np.zeros((n_v, 2, 3))
    for outer in range(2):
        for _ in range(rounds):
            for c, w in ((0, counts * (1 - post)), (1, counts * post)):
                for k in range(3):
                    theta[:, c, k] = (w[:, None] * (v == k)).sum(0) + 0.5
            theta /= theta.sum(2, keepdims=True)
            prior = np.clip((counts * post).sum() / counts.sum(), 1e-3, 1 - 1e-3)
            ll = np.log(theta)
            rows = np.arange(n_v)
            diff = np.stack([ll[rows, 1, v[i]] - ll[rows, 0, v[i]] for i in range(n_p)])
            new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + diff @ weight, -40, 40)))
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break
        if outer == 0:
            share = np.ones(n_v)
            for w in (counts * (1 - post), counts * post):
                if w.sum() > 0:
                    share = np.maximum(share, 1 + agreement(w).sum(1))
            weight = 1 / share
    return post, theta, weight


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows that may teach."""
    spark = docs.sparkSession
    gold = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & may_teach(F.col(id_col)))
            .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    # at most fit_rows ids of 8 bytes: a bounded broadcast, so texts are not shuffled
    sample = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
              .join(F.broadcast(gold), "_id").where("text IS NOT NULL"))
    size = sample.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    sample = materialize(sample.repartition(max(8, -(-size // TASK))), "toxicity-sample")
    sample = sample.join(F.broadcast(_teachers(sample)), "_id").select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(True, 0), n.get(False, 0)
    if not n_pos or not n_neg:
        return Model(base=1.0 if n_pos else 0.0)
    found = _lexicon(sample, n_pos, n_neg)
    h = found["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    model = Model(lexicon=h[order], odds=found["odds"].to_numpy()[order], base=None)

    insult = sorted(INSULTS)

    def voted(batches):
        import re
        pattern = re.compile(r"\b(?:" + "|".join(insult) + r")s?\b", re.I)
        for pdf in batches:
            texts = pdf["text"].tolist()
            x, hits = model.inputs(texts)
            votes = (hits > 0).astype(np.int8)
            extra = np.zeros((len(texts), 5), np.int8)
            listed = np.array([len(pattern.findall(t)) for t in texts])
            extra[:, 0] = (listed > 1).astype(np.int8)                        # listed insults
            extra[:, 1] = np.where(np.expm1(x[:, BUCKETS]) >= 2, 1, 0)        # repeated hits
            extra[:, 2] = np.where(x[:, BUCKETS + 1] >= 0.5, 1, 0)            # dense hits
            extra[:, 3] = np.where(x[:, BUCKETS + 2] == 0, -1, 0)             # no lexicon has a hit
            extra[:, 4] = np.where(pdf["toxic"].to_numpy() == 1, 1, -1)       # the annotator
            both = np.concatenate([votes, extra], 1)
            yield pd.DataFrame({"votes": ["".join("-01"[v + 1] for v in r) for r in both], "x": list(x)})
        give_back()

    rows = materialize(sample.mapInPandas(voted, "votes string, x array<double>"), "toxicity-votes", 8)
    patterns = rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()   # at most fit_rows
    votes = np.array([[{"-": -1, "0": 0, "1": 1}[c] for c in r["votes"]] for r in patterns])
    post, theta, weight = label_model(votes, np.array([r["n"] for r in patterns], float))
    model.accuracy = {"theta": theta, "weight": weight}
    soft = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(patterns, post, strict=True)],
                                 "votes string, p double")
    train = rows.join(F.broadcast(soft), "votes").select(
        array_to_vector("x").alias("features"),
        F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")),
                          F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("y"))
    train = materialize(train.select("features", "y.label", "y.w").where("w > 1e-6").coalesce(8), "toxicity-train")
    lr = LogisticRegression(weightCol="w", regParam=1e-4, elasticNetParam=0.0, maxIter=60).fit(train)
    model.weights, model.bias = np.array(lr.coefficients.toArray()), float(lr.intercept)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text",
          keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keep`` columns (default: the id) of every row with its score as ``out``."""
    return map_texts(docs, keep or [id_col], text, lambda texts: [model.scores(texts)], {out: "double"})


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels, id_col, text), id_col, text)
    return out.select(id_col, F.coalesce(~may_teach(F.col(id_col)), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= REJECT).cast("int").alias("predicted"))

"""How five document filters interact in every order they may be applied in.

Every document has a mask of the filters it fails.  What becomes of a document
in all 120 orders of the filters at all 5 steps depends on its mask alone, so
each of the 32 masks is mapped once to one wide integer of 600 fields, the field
of (order, step) being 1 where that step removes the document.  The integers of
a part's documents are summed and the sum is unpacked into 600 counts.  A field
has 64 bits and no count reaches 2**63, so no field runs over into the next.

All figures of the report are read off that sum: what is kept is the rest after
the steps so far, a filter's failures are what it removes as first step, the
documents that fail it alone are what it removes as last step.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
FIELD = 64                          # bits of a field

LEAST_WORDS = 200                   # A: fewer words than this
LEAST_DISTINCT = 50                 # B: less than this percentage of the words distinct
MOST_CAPITALS = 3                   # C: more than this percentage of the code points A-Z
SYMBOLS = r"[#$%&*|]"               # D: holds any of these

SPACES = "\t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

REPORT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
                       T.StructField("step", T.IntegerType()),
                       *(T.StructField(c, T.LongType()) for c in ("kept", "removed", "redundant", "unique_fails",
                                                                  "good_lost", "toxic_lost", "shapley"))])


# ------------------------------------------------------------ packed counters

def pack(mask: int) -> int:
    """The wide integer of a mask (bit i: fails FILTERS[i])."""
    out = 0
    for i, (order, step) in enumerate(STEPS):
        failed = [mask >> FILTERS.index(f) & 1 for f in order[:step]]
        if failed[-1] and not any(failed[:-1]):
            out |= 1 << FIELD * i
    return out


def unpack(total: int) -> np.ndarray:
    """The 600 counts of a sum of packed masks."""
    return np.frombuffer(total.to_bytes(len(STEPS) * FIELD // 8, "little"), "<u8").astype(np.int64)


def report(masks: np.ndarray, counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, packed: list[int]) -> dict:
    """The report's columns from one part's (mask, documents, good ones, toxic ones)."""
    removed, good_lost, toxic_lost = (
        unpack(sum((packed[m] * int(n) for m, n in zip(masks, c, strict=True)), 0)) for c in (counts, good, toxic))
    step = np.array([s for _, s in STEPS], np.int32)
    here = np.array([FILTERS.index(o[s - 1]) for o, s in STEPS])
    fails, alone = (np.array([removed[next(i for i, (o, t) in enumerate(STEPS) if t == s and o[t - 1] == f)]
                              for f in FILTERS]) for s in (1, len(FILTERS)))
    shapley = np.array([removed[here == f].sum() for f in range(len(FILTERS))])
    return {"filter_order": [o for o, _ in STEPS], "step": step,
            "kept": int(counts.sum()) - removed.reshape(-1, len(FILTERS)).cumsum(1).ravel(), "removed": removed,
            "redundant": fails[here] - removed, "unique_fails": alone[here], "good_lost": good_lost,
            "toxic_lost": toxic_lost, "shapley": shapley[here]}


# ---------------------------------------------------------------- the masks

def own_failures(text: Column) -> tuple[Column, Column]:
    """(words, mask of the filters A to D from ``words`` and the text); words are
    the runs of other characters than ``\\x20\\x09-\\x0D``."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text),
             text.rlike(SYMBOLS)]
    return words, sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part have a mask, at
    most 32 rows a part.

    Filter E asks for the least id of a text over the whole table.  Texts are
    compared by their SHA-256; the documents of a (text, part, label) are summed
    with the count of their least id before any text meets its other parts, so
    a group of copies of any size is a few rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words, mask = own_failures(F.col("_t"))
    rows = (docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), t.alias("_t"))
            .select("*", words.alias("_words"))
            .select("id", "part", F.unhex(F.sha2("_t", 256)).alias("same"), mask.alias("mask")))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    none = F.lit(False)
    rows = rows.join(marks, "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    group = ["same", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", *group).agg(F.count("*").alias("n"))
    has_id = F.col("id").isNotNull()
    texts = by_id.groupBy(*group).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without"),
        F.min(F.when(has_id, F.struct("id", "n"))).alias("least"))
    least = F.min("least.id").over(Window.partitionBy("same"))
    texts = texts.withColumn("first", F.col("without") + F.when(F.col("least.id") == least, F.col("least.n")).otherwise(0))
    repeated = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")),
                             F.struct(F.col("mask").bitwiseOR(repeated).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    cells = texts.select("part", "good", "toxic", both.alias("c")).where("c.n > 0")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("c.n"))), F.lit(0)).alias(c)
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("good"), count("toxic"))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """Per part, order and step: documents kept and removed, failing but removed
    before (redundant), failing this filter only, removed good and toxic ones,
    and the filter's removals summed over all orders (shapley).

    A null text is empty, a null part the part ''; an empty text fails A alone.
    A document without an id repeats nothing and is repeated by nothing; rows
    that repeat an id and its text do not repeat each other (filter E asks for a
    smaller id).  A document is good or toxic if any of its label rows says so; documents without label
    are neither.  An empty table gives no rows.
    """
    packed = [pack(m) for m in range(1 << len(FILTERS))]

    def unpacked(key, pdf):
        import pandas as pd
        cols = report(*(pdf[c].to_numpy() for c in ("mask", "n", "good", "toxic")), packed)
        return pd.DataFrame({"part": [key[0]] * len(STEPS), **cols})

    return mask_counts(docs, labels, text, doc_id, part).groupBy("part").applyInPandas(unpacked, REPORT)

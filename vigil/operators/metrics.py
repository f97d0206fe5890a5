"""Classification metrics computed as aggregations.

Every metric starts from a grouped count (map-side combined), so the data
that reaches a single task is the confusion table or the table of distinct
scores, never the scored rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str, p: str, labels: list[int] | None = None) -> DataFrame:
    """Dense confusion matrix: one row per (true, pred) over the label list
    (labels present in truth or prediction by default), with counts and the
    row-normalised share; the diagonal share is the class recall (A23)."""
    counts = df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        lab = counts.select(F.col("y_true").alias("l")).union(counts.select(F.col("y_pred").alias("l"))).distinct()
    else:
        from vigil.functions.dims import literal_table
        lab = literal_table(df.sparkSession, [(int(v),) for v in labels], "l int")
    grid = F.broadcast(lab.select(F.col("l").alias("y_true"))).crossJoin(
        F.broadcast(lab.select(F.col("l").alias("y_pred"))))
    m = grid.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])
    row_tot = F.sum("n").over(Window.partitionBy("y_true"))
    return m.withColumn("row_share", F.try_divide(F.col("n").cast("double"), row_tot))


def class_report(cm: DataFrame, carry: list[str] | tuple = ()) -> DataFrame:
    """precision / recall / f1 / support per class, then accuracy, macro and
    weighted averages, zero_division = 0 (A24).

    Input: (y_true, y_pred, n) counts, e.g. :func:`confusion` or a plain
    grouped count.  The counts are used once: every (true, pred) cell is
    exploded into a "true" and a "pred" contribution, one grouped aggregate
    gives tp / support / pred_n per class, and the summary rows come from
    windows over that tiny table, so the scored rows are read a single time.
    ``carry`` names columns that are constant over ``cm`` and are passed
    through to every output row (e.g. split sizes computed alongside).
    """
    carry = list(carry)
    cc = [F.col(c) for c in carry]
    c = cm.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("sup"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("pn"), *cc),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("pn"), *cc))).alias("_e")).select("_e.*")
    per = c.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("pn").alias("pred_n"),
                               *[F.first(k).alias(k) for k in carry])
    per = per.filter((F.col("support") > 0) | (F.col("pred_n") > 0))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
        .otherwise(0.0))
    g = Window.partitionBy()
    n = F.sum("support").over(g)
    acc = F.sum("tp").over(g) / n
    tot = per.select(
        "*", n.alias("_n"), acc.alias("_acc"),
        F.avg("precision").over(g).alias("_mp"), F.avg("recall").over(g).alias("_mr"), F.avg("f1").over(g).alias("_mf"),
        (F.sum(F.col("precision") * F.col("support")).over(g) / n).alias("_wp"),
        (F.sum(F.col("recall") * F.col("support")).over(g) / n).alias("_wr"),
        (F.sum(F.col("f1") * F.col("support")).over(g) / n).alias("_wf"),
        F.row_number().over(Window.orderBy("cls")).alias("_first"))

    def row(name, p, r, f, sup):
        return F.struct(name.alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        sup.cast("bigint").alias("support"), *cc)
    own = row(F.col("cls").cast("string"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))
    summary = [row(F.lit("accuracy"), F.col("_acc"), F.col("_acc"), F.col("_acc"), F.col("_n")),
               row(F.lit("macro avg"), F.col("_mp"), F.col("_mr"), F.col("_mf"), F.col("_n")),
               row(F.lit("weighted avg"), F.col("_wp"), F.col("_wr"), F.col("_wf"), F.col("_n"))]
    rows = F.when(F.col("_first") == 1, F.array(own, *summary)).otherwise(F.array(own))
    return tot.select(F.explode(rows).alias("_r")).select("_r.*")


BUCKETS = 256


def score_table(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Positives and negatives per distinct score, with cumulative counts
    walking thresholds from high to low.

    Running sums in two steps: scores fall into BUCKETS ranges cut at quantiles
    of the rows, so a range holds about as many rows whatever the scores are; the
    small table of range totals gives each its offset, and the scores of a range are summed in
    their own window, so no task sees all scores."""
    from pyspark.ml.feature import Bucketizer

    from vigil.operators.chunking import join_on
    cuts = df.select(F.col(score).cast("double").alias("s")).approxQuantile("s", [i / BUCKETS for i in range(1, BUCKETS)], 1 / BUCKETS)
    cuts = sorted({c for c in cuts if math.isfinite(c)})
    g = df.groupBy(F.col(score).alias("thr")).agg(
        F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    if cuts:
        place = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_s", outputCol="_b", handleInvalid="keep")
        g = place.transform(g.withColumn("_s", F.col("thr").cast("double"))).drop("_s")
    else:
        g = g.withColumn("_b", F.lit(0.0))
    g = g.withColumn("_b", F.when(F.col("thr").isNull(), -1.0).otherwise(F.col("_b")))      # last in the walk, as nulls are
    before = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    off = g.groupBy("_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).select(
        "_b", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
        F.sum("_p").over(whole).alias("P"), F.sum("_n").over(whole).alias("N"))
    w = Window.partitionBy("_b").orderBy(F.col("thr").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (join_on(g, off, ["_b"]).withColumn("tp", F.col("_op") + F.sum("pos").over(w))
            .withColumn("fp", F.col("_on") + F.sum("neg").over(w)).drop("_b", "_op", "_on"))


def roc_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """ROC points per threshold."""
    t = score_table(df, score, truth)
    return t.select("thr", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))


def roc_summary(df: DataFrame, score: str, truth: str) -> DataFrame:
    """AUC by the trapezoid rule over the ROC points (from (0,0)) and the
    Youden-best threshold (max tpr - fpr, highest threshold on ties) (A25)."""
    # the point before a threshold is its own count taken off again
    r = score_table(df, score, truth).select(
        "thr", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"),
        ((F.col("tp") - F.col("pos")) / F.col("P")).alias("pt"), ((F.col("fp") - F.col("neg")) / F.col("N")).alias("pf"))
    area = (F.col("fpr") - F.col("pf")) * (F.col("tpr") + F.col("pt")) / 2
    return r.agg(F.sum(area).alias("auc"),
                 F.max_by("thr", F.struct(F.col("tpr") - F.col("fpr"), F.col("thr"))).alias("best_threshold"),
                 F.max(F.col("tpr") - F.col("fpr")).alias("youden_j"))


def pr_summary(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Average precision = sum over thresholds of (R_i - R_{i-1}) * P_i, and
    the positive base rate (A26)."""
    t = score_table(df, score, truth)
    t = t.withColumn("rec", F.col("tp") / F.col("P")).withColumn("prec", F.col("tp") / (F.col("tp") + F.col("fp")))
    t = t.withColumn("prev_rec", (F.col("tp") - F.col("pos")) / F.col("P"))
    return t.agg(F.sum((F.col("rec") - F.col("prev_rec")) * F.col("prec")).alias("average_precision"),
                 (F.first("P") / (F.first("P") + F.first("N"))).alias("base_rate"))


def pr_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    t = score_table(df, score, truth)
    return t.select("thr", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("P")).alias("recall"))


def one_vs_rest(df: DataFrame, prob_col: str, y: str, classes: list[int], fn=roc_summary) -> DataFrame:
    """Apply a binary summary per class on probs[class] vs (y == class)."""
    out = None
    for c in classes:
        d = df.select(F.round(F.col(prob_col)[c], 6).alias("_s"), (F.col(y) == c).alias("_t"))
        r = fn(d, "_s", "_t").withColumn("cls", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out


def counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y_true, y_pred, n): the only pass over the scored rows."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    g = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy()
    return g.withColumn("weight", F.sum("n_c").over(tot) / (F.count(F.lit(1)).over(tot) * F.col("n_c")))


def scale_pos_weight(df: DataFrame, positive) -> DataFrame:
    """negatives / positives for a binary target."""
    return df.agg((F.count_if(~positive) / F.count_if(positive)).alias("scale_pos_weight"))


def add_weight_col(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Attach balanced class weights as a column (``weightCol`` for MLlib).
    The weight table has one row per class, so broadcasting it is safe."""
    return df.join(F.broadcast(class_weights(df, y).select(y, F.col("weight").alias(out))), y, "left")

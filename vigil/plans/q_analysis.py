"""Profile, metric, split and scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions.columns import rnd
from vigil.operators import metrics as M
from vigil.operators import profile as PR
from vigil.operators import scoring as S
from vigil.operators import splits as SP
from vigil.operators.timeline import Timeline
from vigil.plans.registry import EV, register
from vigil.sources.tables import EVENTS_TL as TL, events, lineitem, table


def _round(df, cols, d):
    return df.select(*[rnd(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


def _profile_sql(c):
    return (f"SELECT '{c}' AS column, count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
            f"round(avg({c}), 9) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
            f"round(quantile_cont({c}, 0.25), 9) AS q25, round(quantile_cont({c}, 0.5), 9) AS median, "
            f"round(quantile_cont({c}, 0.75), 9) AS q75, max({c}) AS max, "
            f"round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM ev")


@register("numeric_profile", f"WITH {EV}\n" + "\nUNION ALL\n".join(_profile_sql(c) for c in ("value", "k")))
def q_numeric_profile(spark, sf):
    out = PR.numeric_profile(events(spark, sf).select("value", "k"), ["value", "k"])
    out = _round(out, ["mean", "q25", "median", "q75"], 9)
    return _round(out, ["std", "skew", "kurtosis"], 6)


def _iqr_sql(c):
    q25, q75 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return (f"SELECT '{c}' AS column, q25, q75, q25 - 1.5 * (q75 - q25) AS lower, q75 + 1.5 * (q75 - q25) AS upper, "
            f"(SELECT count(*) FROM ev WHERE {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) AS n_outliers, "
            f"round(CAST((SELECT count(*) FROM ev WHERE {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) AS DOUBLE)"
            f" * 100.0 / (SELECT count(*) FROM ev), 4) AS pct_outliers "
            f"FROM (SELECT {q25} AS q25, {q75} AS q75 FROM ev)")


@register("iqr_outliers", f"WITH {EV}\n" + "\nUNION ALL\n".join(_iqr_sql(c) for c in ("value", "k")))
def q_iqr_outliers(spark, sf):
    return PR.iqr_outliers(events(spark, sf).select("value", "k"), ["value", "k"])


def _cat_sql(c, expr):
    return f"""SELECT '{c}' AS column, CAST(sum(cnt) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS count,
  CAST(coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing, count(v) AS nunique,
  arg_min(v, (-cnt, v)) FILTER (WHERE v IS NOT NULL) AS mode, max(cnt) FILTER (WHERE v IS NOT NULL) AS top_count,
  '{{' || string_agg('"' || v || '":' || CAST(cnt AS VARCHAR), ',' ORDER BY v) || '}}' AS value_counts
FROM (SELECT CAST({expr} AS VARCHAR) AS v, count(*) AS cnt FROM ev GROUP BY 1)"""


@register("categorical_profile", f"WITH {EV}\n" + "\nUNION ALL\n".join(
    [_cat_sql("event_type", "event_type"), _cat_sql("label", "label")]))
def q_categorical_profile(spark, sf):
    out = PR.categorical_profile(events(spark, sf).select("event_type", "label"), ["event_type", "label"])
    return out.select("column", "count", "missing", "nunique", "mode", "top_count", "value_counts")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_pairs", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 9) AS r FROM lineitem"
    for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]))
def q_corr_pairs(spark, sf):
    return _round(PR.corr_pairs(table(spark, sf, "lineitem"), LI_NUM), ["r"], 9)


LI_FEATS = LI_NUM + ["l_linenumber"]


@register("label_corr_topk", "SELECT feature, abs_corr, rank FROM (SELECT *, row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, feature) AS rank FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(abs(covar_samp(CAST({c} AS DOUBLE), y) / nullif(stddev_samp(CAST({c} AS DOUBLE)) * stddev_samp(y), 0)), 9) AS abs_corr "
    f"FROM (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem)" for c in LI_FEATS) + ")) WHERE rank <= 3")
def q_label_corr_topk(spark, sf):
    li = table(spark, sf, "lineitem")
    out = PR.label_corr_topk(li, LI_FEATS, F.col("l_returnflag") == "R", k=3)
    return _round(out, ["abs_corr"], 9).select("feature", "abs_corr", F.col("rank").cast("bigint").alias("rank"))


@register("histogram50", f"""WITH {EV}, d AS (SELECT label <> 0 AS grp, value AS x FROM ev WHERE value IS NOT NULL),
m AS (SELECT grp, min(x) AS lo, max(x) AS hi FROM d GROUP BY grp),
b AS (SELECT d.grp, lo, hi, CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 50), 49) END AS INTEGER) AS bin
      FROM d JOIN m ON d.grp = m.grp)
SELECT grp, bin, round(lo + (hi - lo) * bin / 50, 9) AS bin_lo, count(*) AS n FROM b GROUP BY grp, bin, lo, hi""")
def q_histogram50(spark, sf):
    ev = events(spark, sf).select("label", "value")
    return _round(PR.histogram(ev, "value", F.col("label") != 0, 50), ["bin_lo"], 9)


EXP_TAUS = PR.DEFAULT_TAUS


def _exp_sql():
    taus = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in EXP_TAUS)
    return f"""WITH x AS (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS DOUBLE) AS t, l_quantity AS x FROM lineitem),
e AS (SELECT l_suppkey, tau, x, exp(-t / tau) AS u FROM x, (SELECT unnest([{taus}]) AS tau)),
g AS (SELECT l_suppkey, tau, count(x) AS n, regr_slope(x, u) AS b, regr_intercept(x, u) AS a,
        greatest(regr_syy(x, u) - regr_sxy(x, u) * regr_sxy(x, u) / nullif(regr_sxx(x, u), 0), 0.0) AS sse
      FROM e GROUP BY l_suppkey, tau HAVING count(x) > 30 AND regr_slope(x, u) IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY sse, tau) AS rk FROM g)
SELECT l_suppkey, tau, round(a + b, 6) AS start, round(a, 6) AS target, round(sse, 4) AS sse FROM r WHERE rk = 1"""


@register("exp_fit", _exp_sql())
def q_exp_fit(spark, sf):
    tl = Timeline(run="l_suppkey", order=("l_shipdate", "l_orderkey", "l_linenumber"))
    li = lineitem(spark, sf).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    # sample index per supplier from the two-phase prefix count (no run is
    # gathered into one window task)
    from vigil.operators.chunking import add_sequence
    li = add_sequence(li, tl).withColumn("t", F.col("_seq").cast("double")).drop("_seq")
    out = PR.exp_fit(li, ["l_suppkey"], "t", "l_quantity", EXP_TAUS)
    return _round(_round(out, ["start", "target"], 6), ["sse"], 4)


# --- metrics on a deterministic rule score ------------------------------------------------

PRED_SQL = "CASE WHEN value > 300 THEN 2 WHEN k >= 90 THEN 3 WHEN k < 10 THEN 1 ELSE 0 END"


def rule_pred():
    v, k = F.col("value"), F.col("k")
    return F.when(v > 300, 2).when(k >= 90, 3).when(k < 10, 1).otherwise(0)


def scored(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", "user_id", "ts", "label", "value", "k", F.weekofyear("ts").alias("week"),
                     rule_pred().alias("pred"), F.round(F.col("value") / 500, 6).alias("score"),
                     (F.col("event_type") == "purchase").alias("truth"))


@register("confusion", f"""WITH {EV}, c AS (SELECT label AS y_true, {PRED_SQL} AS y_pred, count(*) AS n FROM ev GROUP BY ALL),
l AS (SELECT unnest([0, 1, 2, 3]) AS l),
g AS (SELECT a.l AS y_true, b.l AS y_pred, coalesce(c.n, 0) AS n FROM l a CROSS JOIN l b
      LEFT JOIN c ON c.y_true = a.l AND c.y_pred = b.l)
SELECT CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred, n,
       round(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 9) AS row_share FROM g""")
def q_confusion(spark, sf):
    cm = M.confusion(scored(spark, sf), "label", "pred", [0, 1, 2, 3])
    return _round(cm, ["row_share"], 9)


CLASS_REPORT_SQL = f"""c AS (SELECT label AS y, {PRED_SQL} AS p FROM ev),
cls AS (SELECT y AS cls FROM c UNION SELECT p FROM c),
s AS (SELECT cls, (SELECT count(*) FROM c WHERE y = cls AND p = cls) AS tp,
             (SELECT count(*) FROM c WHERE y = cls) AS support,
             (SELECT count(*) FROM c WHERE p = cls) AS pred_n FROM cls),
m AS (SELECT *, coalesce(tp / nullif(pred_n, 0), 0.0) AS precision,
             coalesce(tp / nullif(support, 0), 0.0) AS recall FROM s),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""


@register("class_report", f"""WITH {EV}, {CLASS_REPORT_SQL}
SELECT CAST(cls AS VARCHAR) AS row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9),
       round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       CAST(sum(support) AS BIGINT) FROM f""")
def q_class_report(spark, sf):
    rep = M.class_report(M.counts(scored(spark, sf), "label", "pred"))
    return _round(rep, ["precision", "recall", "f1"], 9)


SCORE_SQL = f"""s AS (SELECT round(value / 500, 6) AS thr, event_type = 'purchase' AS truth FROM ev),
g AS (SELECT thr, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM s GROUP BY thr),
c AS (SELECT thr, sum(pos) OVER (ORDER BY thr DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY thr DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)"""


@register("roc_auc", f"""WITH {EV}, {SCORE_SQL},
r AS (SELECT thr, tp / P AS tpr, fp / N AS fpr FROM c),
l AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY thr DESC), 0.0) AS pf,
             coalesce(lag(tpr) OVER (ORDER BY thr DESC), 0.0) AS pt FROM r)
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 9) AS auc,
       arg_max(thr, (tpr - fpr, thr)) AS best_threshold, round(max(tpr - fpr), 9) AS youden_j FROM l""")
def q_roc_auc(spark, sf):
    out = M.roc_summary(scored(spark, sf), "score", "truth")
    return _round(out, ["auc", "youden_j"], 9)


@register("roc_points", f"""WITH {EV}, {SCORE_SQL}
SELECT thr, round(tp / P, 9) AS tpr, round(fp / N, 9) AS fpr FROM c""")
def q_roc_points(spark, sf):
    return _round(M.roc_curve(scored(spark, sf), "score", "truth"), ["tpr", "fpr"], 9)


@register("pr_ap", f"""WITH {EV}, {SCORE_SQL},
r AS (SELECT thr, tp / P AS rec, tp / (tp + fp) AS prec, P, N FROM c),
l AS (SELECT *, coalesce(lag(rec) OVER (ORDER BY thr DESC), 0.0) AS prev_rec FROM r)
SELECT round(sum((rec - prev_rec) * prec), 9) AS average_precision, round(max(P) / (max(P) + max(N)), 9) AS base_rate FROM l""")
def q_pr_ap(spark, sf):
    return _round(M.pr_summary(scored(spark, sf), "score", "truth"), ["average_precision", "base_rate"], 9)


@register("class_weights", f"""WITH {EV}, g AS (SELECT label, count(*) AS n_c FROM ev GROUP BY label)
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 9) AS weight FROM g""")
def q_class_weights(spark, sf):
    return _round(M.class_weights(events(spark, sf).select("label"), "label"), ["weight"], 9)


@register("pos_weight", f"""WITH {EV}
SELECT round(count(*) FILTER (WHERE event_type <> 'purchase') / count(*) FILTER (WHERE event_type = 'purchase'), 9)
  AS scale_pos_weight FROM ev""")
def q_pos_weight(spark, sf):
    out = M.scale_pos_weight(events(spark, sf), F.col("event_type") == "purchase")
    return _round(out, ["scale_pos_weight"], 9)


# --- splits -------------------------------------------------------------------------------

@register("chrono_split", f"""WITH {EV}
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
       <= floor(count(*) OVER (PARTITION BY user_id) * 0.7) AS is_train FROM ev""")
def q_chrono_split(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "ts")
    return SP.chrono_split(ev, TL).select("event_id", "user_id", "is_train")


@register("stratified_split", f"""WITH {EV}, g AS (SELECT label, count(*) AS n FROM ev GROUP BY label)
SELECT label, CAST(round(n * 0.2) AS BIGINT) AS n_test, n - CAST(round(n * 0.2) AS BIGINT) AS n_train FROM g""")
def q_stratified_split(spark, sf):
    x = SP.stratified_split(events(spark, sf).select("event_id", "label"), "label", ["event_id"])
    return x.groupBy("label").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@register("stratified_sample", f"""WITH {EV}, g AS (SELECT label, count(*) AS n FROM ev GROUP BY label)
SELECT label, CAST(least(n, round(n * 1500 / sum(n) OVER ())) AS BIGINT) AS n_sampled FROM g""")
def q_stratified_sample(spark, sf):
    x = SP.stratified_sample(events(spark, sf).select("event_id", "label"), "label", ["event_id"], 1500)
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n_sampled"))


@register("uniform_sample", f"""WITH {EV} SELECT event_id, user_id, label FROM ev
ORDER BY md5('42|' || event_id), event_id LIMIT 300""")
def q_uniform_sample(spark, sf):
    return SP.uniform_sample(events(spark, sf).select("event_id", "user_id", "label"), ["event_id"], 300)


@register("first_per_class", f"""WITH {EV}
SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ts, event_id) AS rn FROM ev)
WHERE rn <= 3""")
def q_first_per_class(spark, sf):
    ev = events(spark, sf).select("event_id", "ts", "label")
    return SP.first_n_per_class(ev, "label", ["ts", "event_id"], 3).select("event_id", "label")


@register("holdout_verdict", f"""WITH {EV}, t AS (SELECT * FROM ev WHERE weekofyear(ts) NOT IN (1, 2, 3)),
c AS (SELECT label AS y, {PRED_SQL} AS p FROM t),
cls AS (SELECT y AS cls FROM c UNION SELECT p FROM c),
s AS (SELECT cls, (SELECT count(*) FROM c WHERE y = cls AND p = cls) AS tp,
             (SELECT count(*) FROM c WHERE y = cls) AS support, (SELECT count(*) FROM c WHERE p = cls) AS pred_n FROM cls),
m AS (SELECT *, coalesce(tp / nullif(pred_n, 0), 0.0) AS pr, coalesce(tp / nullif(support, 0), 0.0) AS rc FROM s),
f AS (SELECT CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT (SELECT count(*) FROM ev WHERE weekofyear(ts) IN (1, 2, 3)) AS n_train, (SELECT count(*) FROM t) AS n_test,
       round(avg(f1), 9) AS macro_f1,
       CASE WHEN avg(f1) > 0.9 THEN 'generalises' WHEN avg(f1) > 0.75 THEN 'partial' ELSE 'overfit' END AS verdict FROM f""")
def q_holdout_verdict(spark, sf):
    x = SP.run_holdout(scored(spark, sf), "week", [1, 2, 3])
    # one pass: counts of (split, truth, prediction); the split sizes come
    # from windows over that tiny table and ride along with the test report
    c = x.groupBy("is_train", F.col("label").alias("y_true"), F.col("pred").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    g = Window.partitionBy()
    c = (c.withColumn("n_train", F.sum(F.when(F.col("is_train"), F.col("n")).otherwise(0)).over(g))
          .withColumn("n_test", F.sum(F.when(~F.col("is_train"), F.col("n")).otherwise(0)).over(g))
          .filter(~F.col("is_train")))
    rep = M.class_report(c, carry=["n_train", "n_test"]).filter(F.col("row") == "macro avg")
    return rep.select("n_train", "n_test", rnd("f1", 9).alias("macro_f1"),
                      SP.holdout_verdict(F.col("f1")).alias("verdict"))


# --- scoring ------------------------------------------------------------------------------

def _probs_spark():
    v, k = F.col("value"), F.col("k")

    def norm(*xs):
        arr = F.array(*xs)
        s = F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)
        return F.transform(arr, lambda x: x / s)
    p1 = norm(F.lit(1.0), v / 100, k / 100, F.lit(0.5))
    p2 = norm(F.lit(2.0), k / 50, v / 200, F.lit(1.0))
    p3 = F.when(k >= 20, norm(F.lit(1.0), F.lit(1.0), v / 100, k / 100))
    return p1, p2, p3


def _probs_sql():
    def norm(prefix, xs):
        s = "(" + " + ".join(xs) + ")"
        return [f"{x} / {s} AS {prefix}{i}" for i, x in enumerate(xs)]
    a = norm("a", ["1.0", "value / 100", "k / 100", "0.5"])
    b = norm("b", ["2.0", "k / 50", "value / 200", "1.0"])
    c = [f"CASE WHEN k >= 20 THEN {x.split(' AS ')[0]} END AS c{i}" for i, x in enumerate(
        norm("c", ["1.0", "1.0", "value / 100", "k / 100"]))]
    return ", ".join(a + b + c)


def _argmax_sql(p):
    return (f"CASE WHEN {p}0 >= {p}1 AND {p}0 >= {p}2 AND {p}0 >= {p}3 THEN 0 "
            f"WHEN {p}1 >= {p}2 AND {p}1 >= {p}3 THEN 1 WHEN {p}2 >= {p}3 THEN 2 ELSE 3 END")


W1, W2, W3 = 0.40, 0.35, 0.25


@register("ensemble_vote", f"""WITH {EV}, p AS (SELECT event_id, {_probs_sql()} FROM ev),
q AS (SELECT *, {", ".join(f"CASE WHEN c0 IS NULL THEN (a{i} * {W1} + b{i} * {W2}) / {W1 + W2!r} ELSE (a{i} * {W1} + b{i} * {W2}) + c{i} * {W3} END AS e{i}" for i in range(4))} FROM p)
SELECT event_id, CAST({_argmax_sql("e")} AS INTEGER) AS class_id, round(greatest(e0, e1, e2, e3), 9) AS confidence,
       {_argmax_sql("e")} > 0 AS is_attack,
       {_argmax_sql("a")} AS vote_gbt, {_argmax_sql("b")} AS vote_mlp,
       CASE WHEN c0 IS NULL THEN -1 ELSE {_argmax_sql("c")} END AS vote_seq,
       CAST({_argmax_sql("a")} AS INTEGER) AS gbt_class, round(greatest(a0, a1, a2, a3), 9) AS gbt_confidence,
       ({_argmax_sql("e")} = 0 OR greatest(e0, e1, e2, e3) >= 0.55) AS passes_threshold
FROM q""")
def q_ensemble_vote(spark, sf):
    ev = events(spark, sf).select("event_id", "value", "k")
    p1, p2, p3 = _probs_spark()
    x = ev.select("event_id", S.ensemble_vote(p1, p2, p3, (W1, W2, W3)).alias("r"),
                  S.class_from_probs(p1).alias("c1"))
    return x.select("event_id", "r.class_id", rnd("r.confidence", 9).alias("confidence"), "r.is_attack",
                    F.col("r.model_votes")["gbt"].cast("int").alias("vote_gbt"),
                    F.col("r.model_votes")["mlp"].cast("int").alias("vote_mlp"),
                    F.col("r.model_votes")["seq"].cast("int").alias("vote_seq"),
                    F.col("c1.class_id").alias("gbt_class"), rnd("c1.confidence", 9).alias("gbt_confidence"),
                    S.passes_confidence(F.col("r.class_id"), F.col("r.confidence")).alias("passes_threshold"))


@register("robust_scale", f"""WITH {EV}, q AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iv,
  quantile_cont(k, 0.5) AS mk, quantile_cont(k, 0.75) - quantile_cont(k, 0.25) AS ik FROM ev)
SELECT event_id, round((value - mv) / CASE WHEN iv = 0 THEN 1.0 ELSE iv END, 9) AS value_scaled,
       round((k - mk) / CASE WHEN ik = 0 THEN 1.0 ELSE ik END, 9) AS k_scaled FROM ev, q""")
def q_robust_scale(spark, sf):
    from vigil.operators.ml import RobustScalerExact
    ev = events(spark, sf).select("event_id", "value", "k")
    model = RobustScalerExact(inputCols=["value", "k"], outputCols=["value_scaled", "k_scaled"]).fit(ev)
    out = model.transform(ev).select("event_id", "value_scaled", "k_scaled")
    return _round(out, ["value_scaled", "k_scaled"], 9)

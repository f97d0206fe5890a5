"""Time-series feature queries (families A and B) on ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import rnd
from vigil.operators import chunking as CH
from vigil.operators import features as X
from vigil.operators.timeline import Timeline
from vigil.plans.registry import EV, register
from vigil.sources.tables import EVENTS_TL as TL, LINEITEM_TL, events, lineitem

W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _frame(lo: str, hi: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {lo} AND {hi})"


def _ev(spark, sf, *cols):
    return events(spark, sf).select("event_id", "user_id", "ts", *cols)


def _round(df, cols, d):
    return df.select(*[rnd(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("rate_accel", f"""WITH {EV}
SELECT event_id, user_id,
  value - lag(value) OVER w AS value_rate,
  (value - lag(value) OVER w) - (lag(value) OVER w - lag(value, 2) OVER w) AS value_accel,
  k - lag(k) OVER w AS k_rate,
  (k - lag(k) OVER w) - (lag(k) OVER w - lag(k, 2) OVER w) AS k_accel
FROM ev {W}""")
def q_rate_accel(spark, sf):
    df = _ev(spark, sf, "t", "value", "k")
    return CH.chunked(df, TL, lambda d, tl: X.build(
        d, ["event_id", "user_id"] + CH.ctx(d), X.rate_accel("value", tl), X.rate_accel("k", tl)), back=2).select(
        "event_id", "user_id", "value_rate", "value_accel", "k_rate", "k_accel")


def _rolling_a_sql():
    cols = []
    for n in (5, 10, 30):
        fr = _frame(f"{n - 1} PRECEDING")
        full = f"count(value) OVER {fr} = {n}"
        cols += [f"round(CASE WHEN {full} THEN avg(value) OVER {fr} END, 9) AS value_mean_{n}s",
                 f"round(CASE WHEN {full} THEN stddev_samp(value) OVER {fr} END, 6) AS value_std_{n}s",
                 f"CASE WHEN {full} THEN max(value) OVER {fr} END AS value_max_{n}s",
                 f"CASE WHEN {full} THEN min(value) OVER {fr} END AS value_min_{n}s"]
    return f"WITH {EV}\nSELECT event_id, user_id,\n  " + ",\n  ".join(cols) + "\nFROM ev"


@register("rolling_stats_a", _rolling_a_sql())
def q_rolling_stats_a(spark, sf):
    df = _ev(spark, sf, "t", "value")
    out = CH.chunked(df, TL, lambda d, tl: X.build(
        d, ["event_id", "user_id"] + CH.ctx(d), *[X.rolling_full("value", tl, n) for n in (5, 10, 30)]), back=29)
    out = out.select("event_id", "user_id", *[f"value_{s}_{n}s" for n in (5, 10, 30) for s in ("mean", "std", "max", "min")])
    out = _round(out, [c for c in out.columns if "_std_" in c], 6)
    return _round(out, [c for c in out.columns if "_mean_" in c], 9)


@register("expanding_z", f"""WITH {EV}
SELECT event_id, user_id,
  round(CASE WHEN count(value) OVER p >= 5 THEN (value - avg(value) OVER p) / (stddev_samp(value) OVER p + 1e-6) END, 6)
    AS value_zscore,
  round(CASE WHEN count(k) OVER p >= 5 THEN (k - avg(k) OVER p) / (stddev_samp(k) OVER p + 1e-6) END, 6)
    AS k_zscore
FROM ev WINDOW p AS {_frame("UNBOUNDED PRECEDING", "1 PRECEDING")}""")
def q_expanding_z(spark, sf):
    df = _ev(spark, sf, "t", "value", "k")
    out = X.add_expanding_prior_z(df, TL, ["value", "k"]).select("event_id", "user_id", "value_zscore", "k_zscore")
    return _round(out, ["value_zscore", "k_zscore"], 6)


def _iqr_sql(c):
    q25 = f"quantile_cont({c}, 0.25) OVER p"
    q75 = f"quantile_cont({c}, 0.75) OVER p"
    lo = f"({q25} - 1.5 * ({q75} - {q25}))"
    hi = f"({q75} + 1.5 * ({q75} - {q25}))"
    return (f"round(CASE WHEN count({c}) OVER p >= 5 AND {c} IS NOT NULL THEN "
            f"greatest(0.0, {lo} - {c}, {c} - {hi}) END, 6) AS {c}_outlier_dist")


@register("iqr_distance", f"""WITH {EV}
SELECT event_id, user_id, {_iqr_sql("value")}, {_iqr_sql("k")}
FROM ev WINDOW p AS {_frame("30 PRECEDING", "1 PRECEDING")}""")
def q_iqr_distance(spark, sf):
    df = _ev(spark, sf, "t", "value", "k")
    out = CH.chunked(df, TL, lambda d, tl: X.build(
        d, ["event_id", "user_id"] + CH.ctx(d), X.prior_iqr_distance("value", tl),
        X.prior_iqr_distance("k", tl)), back=30).select("event_id", "user_id", "value_outlier_dist", "k_outlier_dist")
    return _round(out, ["value_outlier_dist", "k_outlier_dist"], 6)


@register("pct_change", f"""WITH {EV}
SELECT event_id, user_id, value / nullif(lag(value) OVER w, 0) - 1 AS value_pct_change,
  coalesce(CAST(value / nullif(lag(value) OVER w, 0) - 1 > 0.05 AS INTEGER), 0) AS value_spike
FROM ev {W}""")
def q_pct_change(spark, sf):
    return CH.chunked(_ev(spark, sf, "t", "value"), TL, lambda d, tl: X.build(
        d, ["event_id", "user_id"] + CH.ctx(d), X.pct_change("value", tl)), back=1).select(
        "event_id", "user_id", "value_pct_change", "value_spike")


DT = "greatest(coalesce(t - lag(t) OVER w, 0.2), 0.01)"


@register("derivative_dt", f"""WITH {EV}
SELECT event_id, user_id, coalesce(value - lag(value) OVER w, 0.0) / {DT} AS d_value_dt,
       coalesce(k - lag(k) OVER w, 0.0) / {DT} AS d_k_dt
FROM ev {W}""")
def q_derivative_dt(spark, sf):
    df = _ev(spark, sf, "t", "value", "k")
    return X.family_b(df, TL, ["value", "k"], keep=["event_id", "user_id"]).select(
        "event_id", "user_id", "d_value_dt", "d_k_dt")


def _rolling_b_sql():
    cols = []
    for n in (10, 25, 50):
        fr = _frame(f"{n - 1} PRECEDING")
        cols += [f"round(avg(value) OVER {fr}, 9) AS value_rmean{n}",
                 f"round(coalesce(stddev_samp(value) OVER {fr}, 0.0), 6) AS value_rstd{n}"]
    return f"WITH {EV}\nSELECT event_id, user_id,\n  " + ",\n  ".join(cols) + "\nFROM ev"


@register("rolling_stats_b", _rolling_b_sql())
def q_rolling_stats_b(spark, sf):
    df = _ev(spark, sf, "t", "value")
    out = X.family_b(df, TL, ["value"], keep=["event_id", "user_id"])
    cols = [f"value_r{s}{n}" for n in (10, 25, 50) for s in ("mean", "std")]
    out = _round(out.select("event_id", "user_id", *cols), [c for c in cols if "rstd" in c], 6)
    return _round(out, [c for c in cols if "rmean" in c], 9)


@register("zscore50", f"""WITH {EV}
SELECT event_id, user_id,
  round(coalesce(CASE WHEN count(value) OVER q >= 10 THEN
        (value - avg(value) OVER q) / greatest(stddev_samp(value) OVER q, 0.001) END, 0.0), 6) AS value_zscore50
FROM ev WINDOW q AS {_frame("49 PRECEDING")}""")
def q_zscore50(spark, sf):
    df = _ev(spark, sf, "t", "value")
    out = X.family_b(df, TL, ["value"], keep=["event_id", "user_id"]).select(
        "event_id", "user_id", "value_zscore50")
    return _round(out, ["value_zscore50"], 6)


@register("roc50", f"""WITH {EV},
x AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n,
             lag(value, 50) OVER w AS sh, first_value(value) OVER w AS v0 FROM ev {W})
SELECT event_id, user_id,
  round(coalesce((value - CASE WHEN rn > 50 THEN sh WHEN n > 50 THEN v0 END) / 50, 0.0), 9) AS value_roc50
FROM x""")
def q_roc50(spark, sf):
    df = _ev(spark, sf, "t", "value")
    out = X.family_b(df, TL, ["value"], keep=["event_id", "user_id"]).select(
        "event_id", "user_id", "value_roc50")
    return _round(out, ["value_roc50"], 9)


@register("ffill_bfill", f"""WITH {EV},
x AS (SELECT *, CASE WHEN label = 3 THEN NULL ELSE value END AS v FROM ev)
SELECT event_id, user_id,
  coalesce(last_value(v IGNORE NULLS) OVER {_frame("UNBOUNDED PRECEDING")}, 0.0) AS v_ffill0,
  coalesce(last_value(v IGNORE NULLS) OVER {_frame("UNBOUNDED PRECEDING")},
           first_value(v IGNORE NULLS) OVER {_frame("CURRENT ROW", "UNBOUNDED FOLLOWING")}, 0.0) AS v_ffill_bfill0
FROM x""")
def q_ffill_bfill(spark, sf):
    df = _ev(spark, sf, "t", "label", "value").withColumn(
        "v", F.when(F.col("label") == 3, None).otherwise(F.col("value")))
    x, tl, ch = CH.plan_chunks(df, TL, back=0)
    if ch:  # nearest non-null across chunks from one-row-per-chunk summaries
        x = CH.carry_nearest(x, tl, [("v", "prev", "_p"), ("v", "next", "_n")])
    else:
        x = x.withColumn("_p", TL.prev_non_null("v")).withColumn("_n", TL.next_non_null("v"))
    x = CH.finish(x, ch)
    return x.select("event_id", "user_id", F.coalesce("_p", F.lit(0.0)).alias("v_ffill0"),
                    F.coalesce("_p", "_n", F.lit(0.0)).alias("v_ffill_bfill0"))


LI_TL = LINEITEM_TL


@register("zscore_anomalies", """SELECT l_suppkey, l_orderkey, l_linenumber, round(z, 6) AS z FROM (
  SELECT *, CASE WHEN count(l_extendedprice) OVER q = 100 AND stddev_samp(l_extendedprice) OVER q > 0
    THEN (l_extendedprice - avg(l_extendedprice) OVER q) / stddev_samp(l_extendedprice) OVER q END AS z
  FROM lineitem
  WINDOW q AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber
               ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
WHERE abs(z) > 2.0""")
def q_zscore_anomalies(spark, sf):
    li = lineitem(spark, sf).select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "t", "l_extendedprice")
    out = CH.chunked(li, LI_TL, lambda d, tl: X.rolling_z_anomalies(d, "l_extendedprice", tl, 100, 2.0), back=99)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", rnd("z", 6).alias("z"))


@register("depletion_pct", f"""WITH {EV},
b AS (SELECT user_id, first(value ORDER BY ts, event_id) FILTER (WHERE label = 0 AND value IS NOT NULL) AS s
      FROM ev GROUP BY user_id)
SELECT event_id, ev.user_id, s AS value_baseline,
       round(least(1.0, greatest(0.0, (s - value) / greatest(s, 1.0))), 9) AS value_pct
FROM ev LEFT JOIN b ON ev.user_id = b.user_id""")
def q_depletion_pct(spark, sf):
    df = _ev(spark, sf, "label", "value")
    out = X.depletion_pct(df, TL, "value")
    return out.select("event_id", "user_id", "value_baseline", rnd("value_pct", 9).alias("value_pct"))


@register("sequence_windows", f"""WITH {EV},
x AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n,
        lead(label, 24) OVER w AS seq_label,
        sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS sv,
        count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS sl
      FROM ev {W})
SELECT user_id, rn AS seq_start, seq_label, sl AS seq_len, round(sv, 6) AS seq_sum
FROM x WHERE rn % 5 = 0 AND rn < n - 25""")
def q_sequence_windows(spark, sf):
    df = _ev(spark, sf, "t", "label", "value")
    out = X.sequence_windows(df, TL, ["value"], 25, 5)
    return out.select("user_id", F.col("seq_start").cast("bigint").alias("seq_start"), "seq_label",
                      F.size("seq").cast("bigint").alias("seq_len"),
                      rnd(F.aggregate("seq", F.lit(0.0), lambda a, r: a + r[0]), 6).alias("seq_sum"))


@register("rolling_corr", f"""WITH {EV}
SELECT event_id, user_id,
  round(CASE WHEN count(*) OVER q = 10 THEN covar_samp(value, k) OVER q
        / nullif(stddev_samp(value) OVER q * stddev_samp(k) OVER q, 0) END, 6) AS corr_value_k_10,
  round(avg(CAST(label <> 0 AS INTEGER)::DOUBLE) OVER q, 9) AS active_duty_10
FROM ev WINDOW q AS {_frame("9 PRECEDING")}""")
def q_rolling_corr(spark, sf):
    df = _ev(spark, sf, "t", "label", "value", "k").withColumn("active", F.col("label") != 0)
    out = CH.chunked(df, TL, lambda d, tl: X.build(
        d, ["event_id", "user_id"] + CH.ctx(d), X.rolling_corr("value", "k", tl, 10),
        X.duty_cycle("active", tl, 10)), back=9).select("event_id", "user_id", "corr_value_k_10", "active_duty_10")
    return _round(out, ["corr_value_k_10"], 6).select(
        "event_id", "user_id", "corr_value_k_10", rnd("active_duty_10", 9).alias("active_duty_10"))


ORDER_TL = Timeline(run="l_orderkey", order=("l_linenumber",), t=None)


def _ramp_sql():
    steps = ["(x - lag(x, 1) OVER w)"] + [f"(lag(x, {k}) OVER w - lag(x, {k + 1}) OVER w)" for k in (1, 2)]
    mean = f"((0.0 + {steps[0]} + {steps[1]} + {steps[2]}) / 3)"
    dev = "greatest(" + ", ".join(f"abs({s} - {mean})" for s in steps) + ")"
    return (f"SELECT l_orderkey, l_linenumber, {dev} <= 0.01 AS x_ramp3 FROM "
            "(SELECT *, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem) "
            "WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")


@register("linear_ramp", _ramp_sql())
def q_linear_ramp(spark, sf):
    li = lineitem(spark, sf).select("l_orderkey", "l_linenumber",
                                    F.col("l_linenumber").cast("double").alias("x"))
    return CH.chunked(li, ORDER_TL, lambda d, tl: X.build(
        d, ["l_orderkey", "l_linenumber"] + CH.ctx(d), X.linear_ramp("x", tl, 3, 0.01)), back=3).select(
        "l_orderkey", "l_linenumber", "x_ramp3")


@register("physics_features", f"""WITH {EV}
SELECT event_id, user_id,
  abs(k * {100 / 3600!r} - (value - lag(value) OVER w)) AS mass_balance_violation,
  CAST(coalesce(value - lag(value) OVER w > 0, false) AND coalesce(label, 0) = 0 AS INTEGER) AS ph_pump_anomaly,
  value / nullif(k + 1, 0) AS pressure_flow_ratio,
  (0.0 + coalesce(value, 0.0) + coalesce(k, 0.0) + coalesce(label, 0)) /
    (CAST(value IS NOT NULL AS INTEGER) + CAST(k IS NOT NULL AS INTEGER) + CAST(label IS NOT NULL AS INTEGER))
    AS stage_avg,
  k / nullif(value + 1, 0) AS tank_ratio
FROM ev {W}""")
def q_physics_features(spark, sf):
    df = _ev(spark, sf, "t", "label", "value", "k")
    out = CH.chunked(df, TL, lambda d, tl: X.build(
        d, ["event_id", "user_id"] + CH.ctx(d),
        X.mass_balance("k", "value", tl), X.rising_while_off("value", "label", tl),
        X.ratio_plus_one("value", "k", "pressure_flow_ratio"),
        X.stage_average(["value", "k", "label"], "stage_avg"),
        X.ratio_plus_one("k", "value", "tank_ratio")), back=1)
    return out.select("event_id", "user_id", "mass_balance_violation", "ph_pump_anomaly",
                      "pressure_flow_ratio", "stage_avg", "tank_ratio")

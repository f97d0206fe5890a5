"""Quality-report queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import rnd
from vigil.functions.dims import map_lookup
from vigil.operators import folds as FD
from vigil.operators import quality as Q
from vigil.operators.labels import union_runs
from vigil.plans.registry import EV, LABEL_NAME_SQL, W_EV, register
from vigil.sources.tables import EVENT_LABEL_NAMES, EVENTS_TL as TL, LINEITEM_TL, event_label, events, table

def names():
    return map_lookup(EVENT_LABEL_NAMES, "label")


def _round_cols(df, cols, d=6):
    return df.select(*[rnd(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("class_distribution", f"""WITH {EV}
SELECT label, {LABEL_NAME_SQL} AS label_name, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct
FROM ev GROUP BY label""")
def q_class_distribution(spark, sf):
    return Q.class_distribution(events(spark, sf).select("label"), "label", names())


@register("label_totals", f"""WITH {EV}
SELECT count(*) FILTER (WHERE label = 0) AS n_normal, count(*) FILTER (WHERE label <> 0) AS n_attack,
       round(CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) FILTER (WHERE label <> 0), 6)
         AS normal_to_attack
FROM ev""")
def q_label_totals(spark, sf):
    return Q.normal_attack_totals(events(spark, sf).select("label"), "label")


@register("baseline_drift", f"""WITH {EV},
n AS (SELECT CAST(weekofyear(ts) AS INTEGER) AS week, value, k FROM ev WHERE label = 0),
p AS (SELECT week, 'value' AS sensor, avg(value) AS mean, stddev_samp(value) AS std FROM n GROUP BY week
      UNION ALL SELECT week, 'k', avg(k), stddev_samp(k) FROM n GROUP BY week),
q AS (SELECT *, coalesce(std = 0, false) AS is_flat FROM p),
r AS (SELECT *,
        count(CASE WHEN NOT is_flat THEN mean END) OVER (PARTITION BY sensor) AS nl,
        max(CASE WHEN NOT is_flat THEN mean END) OVER (PARTITION BY sensor)
          - min(CASE WHEN NOT is_flat THEN mean END) OVER (PARTITION BY sensor) AS d,
        max(CASE WHEN week = 1 THEN std END) OVER (PARTITION BY sensor) AS fs FROM q)
SELECT week, sensor, round(mean, 6) AS mean, round(std, 6) AS std, is_flat,
       round(CASE WHEN nl > 1 THEN d END, 6) AS max_drift,
       CASE WHEN nl > 1 THEN d > 0.5 * fs END AS drift_warn
FROM r""")
def q_baseline_drift(spark, sf):
    ev = events(spark, sf).select("label", "value", "k", F.weekofyear("ts").alias("week"))
    out = Q.baseline_drift(ev, "label", "week", ["value", "k"], first_run=1)
    return _round_cols(out, ["mean", "std", "max_drift"]).select(
        "week", "sensor", "mean", "std", "is_flat", "max_drift", "drift_warn")


DEAD_COLS_EV = ["event_type", "user_id", "value", "k", "props"]


@register("dead_columns", f"""WITH {EV.replace("event_type, value,", "event_type, value, props,")}
""" + "\nUNION ALL\n".join(
    f"SELECT label, '{c}' AS column, coalesce((min({c}) = max({c})) OR count({c}) = 0, true) AS is_dead "
    f"FROM ev GROUP BY label" for c in DEAD_COLS_EV))
def q_dead_columns(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_type", "user_id", "value", "props", F.get_json_object("props", "$.k").cast("double").alias("k"),
        event_label().alias("label"))
    return Q.dead_columns(ev, DEAD_COLS_EV, by=["label"])


@register("signal_quality", f"""WITH {EV},
o AS (SELECT stddev_samp(value) AS ov, stddev_samp(k) AS okk FROM ev),
per AS (SELECT label, count(*) AS total_rows, count(DISTINCT user_id) AS runs_present,
               avg(value) AS mv, avg(k) AS mk, stddev_samp(value) AS sv, stddev_samp(k) AS sk
        FROM ev GROUP BY label),
nrm AS (SELECT mv AS nmv, mk AS nmk, sv AS nsv, sk AS nsk FROM per WHERE label = 0),
z AS (SELECT label, total_rows, runs_present, 'value' AS sensor, 0 AS idx,
             round(CASE WHEN nsv > 0 THEN abs(mv - nmv) / nsv ELSE 0 END, 2) AS z, coalesce(ov > 0, false) AS ok
      FROM per, nrm, o WHERE label <> 0
      UNION ALL
      SELECT label, total_rows, runs_present, 'k', 1,
             round(CASE WHEN nsk > 0 THEN abs(mk - nmk) / nsk ELSE 0 END, 2), coalesce(okk > 0, false)
      FROM per, nrm, o WHERE label <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, idx) AS rk FROM z WHERE ok)
SELECT label, {LABEL_NAME_SQL} AS label_name, total_rows, runs_present,
       max(CASE WHEN rk = 1 THEN sensor END) AS top_signal_1, max(CASE WHEN rk = 1 THEN z END) AS top_z_1,
       max(CASE WHEN rk = 2 THEN sensor END) AS top_signal_2, max(CASE WHEN rk = 2 THEN z END) AS top_z_2,
       max(CASE WHEN rk = 1 THEN z END) < 0.5 AS invisible
FROM r WHERE rk <= 2 GROUP BY label, total_rows, runs_present""")
def q_signal_quality(spark, sf):
    ev = events(spark, sf).select("label", "user_id", "value", "k")
    return Q.signal_quality(ev, "label", "user_id", ["value", "k"], label_name=names())


EV_LIMITS = {"value": (0.0, 400.0), "k": (1.0, 95.0)}


@register("range_violations", f"""WITH {EV}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, "
    f"count(*) FILTER (WHERE {c} < {lo}) AS n_below, "
    f"count(*) FILTER (WHERE {c} > {hi}) AS n_above, "
    f"count(*) FILTER (WHERE {c} < {lo}) + count(*) FILTER (WHERE {c} > {hi}) AS n_violations, "
    f"CAST(min({c}) AS DOUBLE) AS actual_min, CAST(max({c}) AS DOUBLE) AS actual_max FROM ev"
    for c, (lo, hi) in EV_LIMITS.items()))
def q_range_violations(spark, sf):
    return Q.range_report(events(spark, sf).select("value", "k"), EV_LIMITS)


@register("range_check", f"""WITH {EV}
""" + "\nUNION ALL\n".join(
    f"SELECT event_id, '{c}' AS column, CAST({c} AS DOUBLE) AS value, "
    f"CASE WHEN {c} < {lo} THEN '{c} below min {lo}' ELSE '{c} above max {hi}' END AS reason "
    f"FROM ev WHERE {c} < {lo} OR {c} > {hi}" for c, (lo, hi) in EV_LIMITS.items()))
def q_range_check(spark, sf):
    return Q.range_reasons(events(spark, sf).select("event_id", "value", "k"), EV_LIMITS, ["event_id"])


@register("clip_limits", f"""WITH {EV}
SELECT event_id, greatest(0.0, least(400.0, value)) AS value, greatest(1.0, least(95.0, k)) AS k,
       value < 0.0 OR value > 400.0 AS value_clipped, k < 1.0 OR k > 95.0 AS k_clipped
FROM ev""")
def q_clip_limits(spark, sf):
    return Q.clip_to_limits(events(spark, sf).select("event_id", "value", "k"), EV_LIMITS)


EV_DOMAINS = {"label": [0, 1, 2, 3], "k": list(range(0, 100))}


@register("domain_check", f"""WITH {EV}
SELECT 'label' AS column, coalesce(bool_and(label IN (0, 1, 2, 3)), true) AS in_domain,
       count(*) FILTER (WHERE NOT label IN (0, 1, 2, 3)) AS n_outside,
       CAST(min(label) AS DOUBLE) AS min, CAST(max(label) AS DOUBLE) AS max FROM ev
UNION ALL
SELECT 'k', coalesce(bool_and(k IN (SELECT range::DOUBLE FROM range(0, 100))), true),
       count(*) FILTER (WHERE NOT k IN (SELECT range::DOUBLE FROM range(0, 100))),
       CAST(min(k) AS DOUBLE), CAST(max(k) AS DOUBLE) FROM ev""")
def q_domain_check(spark, sf):
    return Q.domain_check(events(spark, sf).select("label", "k"), EV_DOMAINS)


LI_COLS = [("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False), ("l_linenumber", False),
           ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
           ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False)]


@register("missing_report", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if dbl else ''}) AS n_missing, "
    f"round(CAST(count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if dbl else ''}) AS DOUBLE) * 100.0 "
    f"/ count(*), 4) AS pct_missing FROM lineitem" for c, dbl in LI_COLS))
def q_missing_report(spark, sf):
    return Q.missing_report(table(spark, sf, "lineitem"), [c for c, _ in LI_COLS])


@register("duplicates", f"""WITH {EV}, g AS (SELECT user_id, event_type, count(*) AS c FROM ev GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
       round(CAST(sum(c - 1) AS DOUBLE) * 100.0 / sum(c), 4) AS pct_duplicates FROM g""")
def q_duplicates(spark, sf):
    return Q.duplicate_report(events(spark, sf).select("user_id", "event_type"))


@register("dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_dedup(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()


GAP_S = 86400.0


@register("sampling_gaps", f"""WITH {EV},
d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({W_EV})) / 1e6 AS dt,
             ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS ooo FROM ev)
SELECT user_id, count(*) AS n_rows, round(quantile_cont(dt, 0.5), 9) AS median_dt,
       round(min(dt), 9) AS min_dt, round(max(dt), 9) AS max_dt, round(avg(dt), 9) AS mean_dt,
       count(*) FILTER (WHERE dt > {GAP_S}) AS n_gaps, count(*) FILTER (WHERE ooo) AS n_out_of_order
FROM d GROUP BY user_id""")
def q_sampling_gaps(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "ts")
    out = Q.sampling_report(ev, TL, "ts", GAP_S, ingest="event_id")
    return _round_cols(out, ["median_dt", "min_dt", "max_dt", "mean_dt"], 9)


@register("label_durations", f"""WITH {EV}
SELECT label, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
       (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration_s FROM ev GROUP BY label""")
def q_label_durations(spark, sf):
    return Q.label_durations(events(spark, sf).select("label", "ts"), "label", "ts")


@register("std_ratio", f"""WITH {EV},
per AS (SELECT label, stddev_samp(value) AS sv, stddev_samp(k) AS sk FROM ev GROUP BY label),
n AS (SELECT sv AS nv, sk AS nk FROM per WHERE label = 0),
u AS (SELECT label, 'value' AS sensor, nv AS normal_std, sv AS label_std FROM per, n WHERE label <> 0
      UNION ALL SELECT label, 'k', nk, sk FROM per, n WHERE label <> 0)
SELECT label, sensor, round(normal_std, 6) AS normal_std, round(label_std, 6) AS label_std,
       round(label_std / normal_std, 6) AS ratio FROM u WHERE normal_std > 0""")
def q_std_ratio(spark, sf):
    out = Q.std_ratio(events(spark, sf).select("label", "value", "k"), "label", ["value", "k"])
    return _round_cols(out, ["normal_std", "label_std", "ratio"])


@register("run_summary", f"""WITH {EV}
SELECT user_id, count(*) AS n_rows,
       round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 60.0, 6) AS minutes,
       round(((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) / nullif(count(*) - 1, 0), 6) AS mean_interval_s,
       array_to_string(list_sort(list_distinct(list(label))), ',') AS labels_present
FROM ev GROUP BY user_id""")
def q_run_summary(spark, sf):
    out = Q.run_summary(events(spark, sf).select("user_id", "ts", "label"), TL, "ts", "label")
    return _round_cols(out, ["minutes", "mean_interval_s"])


@register("expected_rows", f"""WITH {EV}, g AS (SELECT user_id, count(*) AS n_rows FROM ev GROUP BY user_id)
SELECT user_id, n_rows, round(avg(n_rows) OVER (), 9) AS expected,
       round(n_rows / avg(n_rows) OVER (), 6) AS ratio, n_rows < 0.95 * avg(n_rows) OVER () AS warn FROM g""")
def q_expected_rows(spark, sf):
    out = Q.expected_rows(events(spark, sf).select("user_id"), "user_id")
    return _round_cols(out, ["expected"], 9)


@register("step_check", f"""WITH {EV},
x AS (SELECT *, row_number() OVER ({W_EV}) AS rn, abs(value - lag(value) OVER ({W_EV})) AS step FROM ev)
SELECT user_id, count(step) AS n_steps, round(avg(step), 6) AS mean_abs_step, avg(step) > 50.0 AS warn
FROM x WHERE rn <= 11 GROUP BY user_id""")
def q_step_check(spark, sf):
    out = Q.step_size_check(events(spark, sf).select("user_id", "ts", "event_id", "value"), TL, "value")
    return _round_cols(out, ["mean_abs_step"])


EV_NORMAL = {"value": (0.0, 300.0), "k": (0.0, 100.0)}


@register("normal_ranges", f"""WITH {EV}, n AS (SELECT * FROM ev WHERE label = 0)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS sensor, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, "
    f"min({c}) >= {lo} AND max({c}) <= {hi} AS ok FROM n" for c, (lo, hi) in EV_NORMAL.items()))
def q_normal_ranges(spark, sf):
    return Q.normal_range_sanity(events(spark, sf).select("label", "value", "k"), "label", EV_NORMAL)


@register("success_rate", f"""WITH {EV}
SELECT user_id, count(*) AS n_polls, count(*) FILTER (WHERE event_type <> 'error') AS n_ok,
       (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS span_s,
       round(CAST(count(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) / count(*), 6) AS success_rate,
       round(count(*) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 0), 9) AS polls_per_s
FROM ev GROUP BY user_id""")
def q_success_rate(spark, sf):
    ev = events(spark, sf).select("user_id", "ts", "event_type")
    out = Q.success_rate(ev, "user_id", F.col("event_type") != "error", "ts")
    return _round_cols(out, ["polls_per_s"], 9)


LI_RULES_SQL = {
    "bulk": "l_quantity > 45", "deep_discount": "l_discount >= 0.09", "no_tax": "l_tax = 0",
    "open_returned": "l_linestatus = 'O' AND l_returnflag = 'R'",
}


@register("alarm_rules", """SELECT l_returnflag, count(*) AS n_rows, """ + ", ".join(
    f"count(*) FILTER (WHERE {e}) AS n_{n}" for n, e in LI_RULES_SQL.items())
    + ", count(*) FILTER (WHERE (l_discount >= 0.09) <> (l_returnflag = 'A')) AS n_deep_discount_mismatch"
    " FROM lineitem GROUP BY l_returnflag")
def q_alarm_rules(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("flag_a", F.col("l_returnflag") == "A")
    rules = {n: F.expr(e) for n, e in LI_RULES_SQL.items()}
    x = Q.rule_flags(li, rules, recorded={"deep_discount": "flag_a"})
    return x.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(f"rule_{n}").alias(f"n_{n}") for n in rules],
        F.count_if("deep_discount_mismatch").alias("n_deep_discount_mismatch"))


@register("union_runs", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def q_union_runs(spark, sf):
    o = table(spark, sf, "orders")
    parts = [o.filter(F.col("o_orderstatus") == "F").drop("o_orderpriority"),
             o.filter(F.col("o_orderstatus") != "F")]
    return union_runs(parts)


@register("last_valid", f"""WITH RECURSIVE {EV},
e AS (SELECT *, CASE WHEN value IS NULL THEN 'null' WHEN value < 1 THEN 'low' WHEN value > 60 THEN 'high' END AS early FROM ev),
n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e WHERE early IS NULL),
s AS (SELECT user_id, event_id, rn, value AS last, true AS ok FROM n WHERE rn = 1
      UNION ALL
      SELECT n.user_id, n.event_id, n.rn, CASE WHEN abs(n.value - s.last) <= 15 THEN n.value ELSE s.last END, abs(n.value - s.last) <= 15
      FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1)
SELECT e.event_id, e.user_id, coalesce(s.ok, false) AS valid, coalesce(early, CASE WHEN NOT s.ok THEN 'jump' END) AS reason
FROM e LEFT JOIN s ON s.event_id = e.event_id""")
def q_last_valid(spark, sf):
    """Range and jump rule against the last valid reading of the run."""
    ev = events(spark, sf).select("event_id", "user_id", "ts", "value")
    return FD.last_valid_rule_check(ev, ["user_id"], ["ts", "event_id"], "value", 1.0, 60.0, 15.0).select(
        "event_id", "user_id", "valid", "reason")

"""Label-timeline queries on ``events`` (run = user_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import rnd
from vigil.functions.dims import map_lookup
from vigil.operators import labels as L
from vigil.operators import quality as Q
from vigil.plans.registry import EV, LABEL_NAME_SQL, W_EV, register
from vigil.sources.tables import EVENT_LABEL_NAMES, EVENTS_TL as TL, events

LEAK_WINDOW_S = 3600.0


@register("elapsed", f"""WITH {EV}
SELECT event_id, user_id,
       ((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) + 500) // 1000) / 1000.0
         AS elapsed_seconds
FROM ev""")
def q_elapsed(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "ts")
    return L.add_elapsed(ev, TL, "ts").select("event_id", "user_id", "elapsed_seconds")


@register("transitions", f"""WITH {EV}, x AS (
  SELECT *, lag(label) OVER ({W_EV}) AS prev_label FROM ev)
SELECT user_id, event_id, ts, prev_label, label FROM x
WHERE prev_label IS NOT NULL AND label <> prev_label""")
def q_transitions(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "ts", "label")
    return L.transitions(ev, TL).select("user_id", "event_id", "ts", "prev_label", "label")


@register("segments", f"""WITH {EV}, x AS (
  SELECT *, CASE WHEN lag(label) OVER ({W_EV}) <> label THEN 1 ELSE 0 END AS chg FROM ev),
s AS (SELECT *, sum(chg) OVER ({W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM x)
SELECT user_id, CAST(segment AS BIGINT) AS segment, min(label) AS label,
       min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows,
       (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration_s
FROM s GROUP BY user_id, segment""")
def q_segments(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "ts", "label")
    return L.episodes(ev, TL, "ts").select(
        "user_id", "segment", "label", "start_ts", "end_ts", "n_rows", "duration_s")


@register("leakage_removed", f"""WITH {EV}, x AS (
  SELECT *, lag(label) OVER ({W_EV}) AS pl FROM ev),
tr AS (SELECT user_id, t FROM x WHERE pl IS NOT NULL AND label <> pl)
SELECT e.event_id, e.user_id, e.label FROM ev e
WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = e.user_id
                  AND abs(e.t - tr.t) <= {LEAK_WINDOW_S})""")
def q_leakage_removed(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "ts", "t", "label")
    return L.remove_boundary_leakage(ev, TL, LEAK_WINDOW_S).select("event_id", "user_id", "label")


@register("asof_label", f"""WITH {EV},
r AS (SELECT * FROM ev WHERE event_type <> 'error'),
c AS (SELECT user_id, ts, event_id AS change_id, k AS change_k FROM ev WHERE event_type = 'error')
SELECT r.event_id, r.user_id, c.change_id AS asof_change_id, c.change_k AS asof_change_k
FROM r ASOF LEFT JOIN c ON r.user_id = c.user_id AND r.ts >= c.ts""")
def q_asof_label(spark, sf):
    ev = events(spark, sf)
    readings = ev.filter(F.col("event_type") != "error").select("event_id", "user_id", "ts")
    changes = (ev.filter(F.col("event_type") == "error")
                 .select("user_id", "ts", F.col("event_id").alias("change_id"),
                         F.col("k").alias("change_k")))
    return L.asof_join(readings, changes, TL, ["change_id", "change_k"]).select(
        "event_id", "user_id", "asof_change_id", "asof_change_k")


INTERVAL_S = 1800


@register("interval_label", f"""WITH {EV},
r AS (SELECT * FROM ev WHERE event_type <> 'error'),
iv AS (SELECT user_id, ts AS s, ts + INTERVAL {INTERVAL_S} SECOND AS e, event_id AS iid
       FROM ev WHERE event_type = 'error')
SELECT r.event_id, r.user_id, max(iv.iid) AS interval_id
FROM r LEFT JOIN iv ON r.user_id = iv.user_id AND r.ts >= iv.s AND r.ts < iv.e
GROUP BY r.event_id, r.user_id""")
def q_interval_label(spark, sf):
    ev = events(spark, sf)
    readings = ev.filter(F.col("event_type") != "error").select("event_id", "user_id", "ts")
    iv = (ev.filter(F.col("event_type") == "error")
            .select("user_id", F.col("ts").alias("s"),
                    (F.col("ts") + F.expr(f"INTERVAL {INTERVAL_S} SECONDS")).alias("e"),
                    F.col("event_id").alias("iid")))
    return L.interval_label(readings, iv, TL, "s", "e", "iid").select(
        "event_id", "user_id", "interval_id")


@register("coverage_matrix", f"""WITH {EV}
SELECT label, {LABEL_NAME_SQL} AS label_name, CAST(weekofyear(ts) AS INTEGER) AS run, count(*) AS n
FROM ev GROUP BY label, weekofyear(ts)""")
def q_coverage_matrix(spark, sf):
    """Rows per label and run, one row a pair: no list of runs, so none is lost."""
    ev = events(spark, sf).select("label", F.weekofyear("ts").alias("run"))
    return Q.coverage(ev, "label", "run", map_lookup(EVENT_LABEL_NAMES, "label"))


@register("episode_delta", f"""WITH {EV}, x AS (
  SELECT *, CASE WHEN lag(label) OVER ({W_EV}) <> label THEN 1 ELSE 0 END AS chg FROM ev),
s AS (SELECT *, sum(chg) OVER ({W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM x),
b AS (SELECT *, lag(segment) OVER ({W_EV}) AS ps, lead(segment) OVER ({W_EV}) AS ns,
        lag(value) OVER ({W_EV}) AS pv, lead(value) OVER ({W_EV}) AS nv,
        lag(k) OVER ({W_EV}) AS pk, lead(k) OVER ({W_EV}) AS nk FROM s),
g AS (SELECT user_id, segment, min(label) AS label,
        max(CASE WHEN ps IS NULL OR ps <> segment THEN pv END) AS bv,
        max(CASE WHEN ns IS NULL OR ns <> segment THEN nv END) AS av,
        max(CASE WHEN ps IS NULL OR ps <> segment THEN pk END) AS bk,
        max(CASE WHEN ns IS NULL OR ns <> segment THEN nk END) AS ak
      FROM b WHERE label <> 0 GROUP BY user_id, segment),
u AS (SELECT user_id, segment, label, 'value' AS sensor, bv AS before, av AS after FROM g
      UNION ALL SELECT user_id, segment, label, 'k', bk, ak FROM g)
SELECT user_id, CAST(segment AS BIGINT) AS segment, label, sensor, before, after,
       round(after - before, 6) AS delta
FROM u WHERE before IS NOT NULL AND after IS NOT NULL AND before <> after""")
def q_episode_delta(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "ts", "label", "value", "k")
    out = L.episode_state_delta(ev, TL, ["value", "k"])
    return out.withColumn("delta", rnd("delta"))


@register("episode_index", f"""WITH {EV}, x AS (
  SELECT *, CASE WHEN lag(label) OVER ({W_EV}) <> label THEN 1 ELSE 0 END AS chg FROM ev),
s AS (SELECT *, sum(chg) OVER ({W_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM x)
SELECT event_id, user_id, label, CAST(segment AS BIGINT) AS segment,
       row_number() OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) - 1 AS sample_index
FROM s WHERE label <> 0""")
def q_episode_index(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "ts", "label")
    out = L.episode_index(ev, TL)
    return out.select("event_id", "user_id", "label", "segment", F.col("sample_index").cast("bigint").alias("sample_index"))


@register("label_set_ops", f"""WITH {EV}, p AS (SELECT label AS y, CASE WHEN value > 300 THEN 2 WHEN k >= 90 THEN 3
                                   WHEN k < 10 THEN 1 ELSE 0 END AS p FROM ev)
SELECT 'union' AS op, l FROM (SELECT y AS l FROM p UNION SELECT p FROM p)
UNION ALL SELECT 'intersect', l FROM (SELECT y AS l FROM p INTERSECT SELECT p FROM p)
UNION ALL SELECT 'truth_only', l FROM (SELECT y AS l FROM p EXCEPT SELECT p FROM p)""")
def q_label_set_ops(spark, sf):
    """Union / intersection / difference of the label sets of truth and
    prediction (O5) from ONE pass: each row contributes its label in the
    "truth" role and its prediction in the "pred" role; a grouped aggregate
    records which roles every label has."""
    from vigil.plans.q_analysis import rule_pred
    ev = events(spark, sf).select("label", "value", "k")
    roles = ev.select(F.explode(F.array(
        F.struct(F.col("label").alias("l"), F.lit(True).alias("y"), F.lit(False).alias("p")),
        F.struct(rule_pred().alias("l"), F.lit(False).alias("y"), F.lit(True).alias("p")))).alias("_r")).select("_r.*")
    g = roles.groupBy("l").agg(F.bool_or("y").alias("in_y"), F.bool_or("p").alias("in_p"))
    ops = F.filter(F.array(F.lit("union"), F.when(F.col("in_y") & F.col("in_p"), F.lit("intersect")),
                           F.when(F.col("in_y") & ~F.col("in_p"), F.lit("truth_only"))), lambda o: o.isNotNull())
    return g.select(F.explode(ops).alias("op"), "l")

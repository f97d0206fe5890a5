"""Streaming queries: replay ``events`` through the online detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.columns import epoch_seconds, event_time, from_micros_ntz, rnd
from vigil.functions.dims import ALERT_LEVELS, CLASS_NAMES
from vigil.operators import chunking as CH
from vigil.operators import closed_form as M
from vigil.operators import features as X
from vigil.operators import scoring as S
from vigil.plans.registry import EV, register
from vigil.sources.poll import polled
from vigil.sources.tables import EVENTS_TL, event_label, events, table
from vigil.streaming import detector as D

LATE = "6 hours"        # how much later than a newer one a reading may come
WAIT = 3600.0           # cooldown of an alert, seconds


def event_stream(spark, sf):
    """The recorded events as a stream, closed by one event moved past the end of time."""
    ev = table(spark, sf, "events")
    at = ev.schema["ts"].dataType
    last = ev.limit(1).withColumn("ts", (F.lit(D.CLOSING).cast(at) + F.expr("INTERVAL 20 YEARS")).cast(at))
    s = D.replay_source(spark, f"{sf}/events.parquet", "ts", last)
    # the closing row comes to every operator of its kind, so it has each label in turn
    labels = F.when(F.col("ts") >= F.lit(D.CLOSING).cast(at), F.expr("array('view', 'signup', 'purchase', 'error')"))
    s = s.withColumn("event_type", F.explode(F.coalesce(labels, F.array("event_type"))))
    return s.select("event_id", "ts", "user_id", "event_type", "value",
                    F.get_json_object("props", "$.k").cast("double").alias("k"),
                    event_label().alias("label"), epoch_seconds("ts").alias("t"),
                    event_time("ts").alias(D.EVENT_TS))


@register("stream_window_counts", f"""WITH {EV}
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, label, count(*) AS n FROM ev GROUP BY ALL""")
def q_stream_window_counts(spark, sf):
    c = D.alert_counts(event_stream(spark, sf), D.EVENT_TS, "1 day", LATE, by=["label"])
    c = c.select(from_micros_ntz(F.unix_micros(F.col("w.start"))).alias("window_start"), "label", "n")
    return D.run_to_table(c, "window-counts", mode="update", key=["window_start", "label"])


def _b_sql():
    """Family B online: batch frames over the rows up to each one."""
    out = ["CASE WHEN lag({c}) OVER w IS NULL OR {c} IS NULL THEN 0 ELSE {c} - lag({c}) OVER w END / "
           "greatest(coalesce(t - lag(t) OVER w, 0.2), 0.01) AS d_{c}_dt"]
    for n in (10, 25, 50):
        fr = f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out += [f"round(avg({{c}}) OVER {fr}, 9) AS {{c}}_rmean{n}", f"round(coalesce(stddev_samp({{c}}) OVER {fr}, 0), 6) AS {{c}}_rstd{n}"]
    out += [f"round(coalesce(CASE WHEN count({{c}}) OVER {fr} >= 10 THEN ({{c}} - avg({{c}}) OVER {fr}) / "
            f"greatest(stddev_samp({{c}}) OVER {fr}, 0.001) END, 0), 6) AS {{c}}_zscore50",
            "round(coalesce(({c} - coalesce(lag({c}, 50) OVER w, first_value({c}) OVER w)) / 50, 0), 9) AS {c}_roc50"]
    return ",\n  ".join(x.format(c=c) for c in ("value", "k") for x in out)


@register("stream_features", f"""WITH {EV}
SELECT event_id, user_id, ts, t, label,
  {_b_sql()},
  row_number() OVER w - 1 AS row_index, row_number() OVER w >= 25 AS seq_ready
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
QUALIFY row_number() OVER w >= 25""")
def q_stream_features(spark, sf):
    """Family B of every reading once its run has 25 rows."""
    f = D.online_features(event_stream(spark, sf), "user_id", ["event_id"], "t", ["value", "k"],
                          keep=["event_id", "user_id", "ts", "t", "label"], late=LATE)
    out = D.run_to_table(f, "online-features")
    digits = {c: 9 if "_rmean" in c or c.endswith("roc50") else 6 for c in out.columns if any(x in c for x in ("_rmean", "_rstd", "_roc", "zscore"))}
    return out.select(*[rnd(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


SPEC = X.FamilyA(sensors=("value", "k"), balance=("k", "value"), ratio=("k", "value"))


def _a_sql():
    w = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND {})"
    out = ["{c} - lag({c}) OVER w AS {c}_rate", "({c} - lag({c}) OVER w) - (lag({c}) OVER w - lag({c}, 2) OVER w) AS {c}_accel"]
    for n in SPEC.windows:
        fr = w.format(n - 1, "CURRENT ROW")
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")):
            out.append(f"round(CASE WHEN count({{c}}) OVER {fr} = {n} THEN {fn}({{c}}) OVER {fr} END, 6) AS {{c}}_{name}_{n}s")
    past, near = w.format("UNBOUNDED", "1 PRECEDING"), w.format(SPEC.prior, "1 PRECEDING")
    q25, q75 = (f"quantile_cont({{c}}, {q}) OVER {near}" for q in (0.25, 0.75))
    out += [f"round(CASE WHEN count({{c}}) OVER {past} >= 5 THEN ({{c}} - avg({{c}}) OVER {past}) / (stddev_samp({{c}}) OVER {past} + 1e-6) END, 6) AS {{c}}_zscore",
            f"round(CASE WHEN count({{c}}) OVER {near} >= 5 AND {{c}} IS NOT NULL THEN greatest(0.0, {q25} - 1.5 * ({q75} - {q25}) - {{c}}, "
            f"{{c}} - ({q75} + 1.5 * ({q75} - {q25}))) END, 6) AS {{c}}_outlier_dist",
            "round({c} / nullif(lag({c}) OVER w, 0) - 1, 6) AS {c}_pct_change",
            "CAST(coalesce(CAST({c} / nullif(lag({c}) OVER w, 0) - 1 > 0.05 AS INTEGER), 0) AS DOUBLE) AS {c}_spike"]
    return ",\n  ".join(x.format(c=c) for c in SPEC.sensors for x in out)


@register("stream_family_a", f"""WITH {EV}
SELECT event_id, user_id,
  {_a_sql()},
  round(abs(k * (100.0 / 3600) - (value - lag(value) OVER w)), 6) AS mass_balance_violation,
  round(k / nullif(value + 1, 0), 6) AS ratio
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_stream_family_a(spark, sf):
    """T4: family A of every reading, with merged moments and bounded tails in state."""
    f = D.online_family_a(event_stream(spark, sf), "user_id", ["event_id"], SPEC, keep=["event_id", "user_id"], late=LATE)
    out = D.run_to_table(f, "online-family-a")
    exact = ("_rate", "_accel", "_spike", "_id")
    return out.select(*[c if c.endswith(exact) else rnd(c, 6).alias(c) for c in out.columns])

@register("stream_carry_forward", f"""WITH {EV}, x AS (SELECT *, CASE WHEN label = 3 THEN NULL ELSE value END AS v FROM ev)
SELECT event_id, user_id,
  coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1.0) AS v
FROM x""")
def q_stream_carry_forward(spark, sf):
    """T3 on the replayed stream: readings with a missing value (errors) are
    completed from the run's last known value kept in keyed state."""
    ev = event_stream(spark, sf)
    ev = ev.withColumn("v", F.when(F.col("label") == 3, None).otherwise(F.col("value")))
    out = D.carry_forward(ev, "user_id", ["event_id"], ["v"], {"v": -1.0}, keep=["event_id", "user_id"], late=LATE)
    return D.run_to_table(out, "carry-forward")


HISTORY = "2024-01-16"      # the models are fitted on the readings before this day
BINS = [10.0, 25.0, 50.0, 75.0, 90.0]
SURE = 0.27                 # least confidence of an alert: four classes of equal weight, a quarter each by chance
CLASSES = 4


def _alerts_sql():
    fr = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    z, rm = fr.format(49), fr.format(9)
    like = " + ".join(f"-0.5 * (ln(2 * pi() * v{i}) + (x{i} - m{i}) * (x{i} - m{i}) / v{i})" for i in (1, 2, 3))
    far = " + ".join(f"(x{i} - m{i}) / s{i} * ((x{i} - m{i}) / s{i})" for i in (2, 3))
    case = lambda d, other: "CASE a.class_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in d.items()) + f" ELSE '{other}' END"
    return f"""WITH RECURSIVE {EV},
x AS (SELECT event_id, user_id, ts, t, label, value AS x1,
        (value - avg(value) OVER {z}) / greatest(stddev_samp(value) OVER {z}, 0.001) AS x2, avg(k) OVER {rm} AS x3,
        {" + ".join(f"CAST(k >= {e} AS INT)" for e in BINS)} AS bin
      FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 25),
h AS (FROM x WHERE ts < TIMESTAMP '{HISTORY}'),
c AS (SELECT label AS class, {", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) + 1e-6 AS v{i}" for i in (1, 2, 3))} FROM h GROUP BY label),
s AS (SELECT stddev_pop(x2) AS s2, stddev_pop(x3) AS s3 FROM h),
b AS (SELECT class, q.bin AS bin, (count(h.label) + 1) / (sum(count(h.label)) OVER (PARTITION BY class) + {len(BINS) + 1}) AS share
      FROM (SELECT unnest(range({CLASSES})) AS class), (SELECT unnest(range({len(BINS) + 1})) AS bin) q LEFT JOIN h ON h.label = class AND h.bin = q.bin
      GROUP BY class, q.bin),
e AS (SELECT event_id, user_id, ts, t, c.class, exp({like}) AS e1, exp(-({far})) AS e2, share AS e3
      FROM x CROSS JOIN s CROSS JOIN c JOIN b ON b.class = c.class AND b.bin = x.bin),
p AS (SELECT *, e1 / sum(e1) OVER w * 0.40 + e2 / sum(e2) OVER w * 0.35 + e3 / sum(e3) OVER w * 0.25 AS p FROM e WINDOW w AS (PARTITION BY event_id)),
v AS (SELECT event_id, user_id, ts, t, class AS class_id, p AS confidence FROM p
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p DESC, class) = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, class_id ORDER BY ts, event_id) AS rn FROM v WHERE class_id > 0 AND confidence >= {SURE}),
nx AS (SELECT a.user_id, a.class_id, a.rn, min(d.rn) AS nrn FROM a LEFT JOIN a d
         ON d.user_id = a.user_id AND d.class_id = a.class_id AND d.t >= a.t + {WAIT} GROUP BY ALL),
f AS (SELECT user_id, class_id, rn FROM a WHERE rn = 1
      UNION ALL
      SELECT f.user_id, f.class_id, nx.nrn FROM f JOIN nx ON nx.user_id = f.user_id AND nx.class_id = f.class_id
        AND nx.rn = f.rn WHERE nx.nrn IS NOT NULL)
SELECT event_id, a.user_id, ts, CAST(a.class_id AS INTEGER) AS class_id, round(confidence, 9) AS confidence,
       {case(CLASS_NAMES, 'Unknown')} AS class_name, {case(ALERT_LEVELS, 'INFO')} AS alert_level
FROM a JOIN f ON f.user_id = a.user_id AND f.class_id = a.class_id AND f.rn = a.rn"""


def fitted_models(spark, sf):
    """Three models fitted on the history of every run from its 25th reading on, by
    way of their bundle in the shared folder."""
    keep = ["event_id", "user_id", "ts", "t", "label", "value", "k"]
    seen = CH.add_sequence(events(spark, sf).select(*keep), EVENTS_TL, CH._conf(spark, CH.BUCKET_S_CONF, CH.DEFAULT_BUCKET_S))
    f = X.family_b(seen, EVENTS_TL, ["value", "k"], windows=(10,), keep=[*keep, "_seq"])
    f = f.filter((F.col("_seq") >= 24) & (F.col("ts") < F.lit(HISTORY).cast(f.schema["ts"].dataType)))
    models = [M.GaussianBayes.fit(f, ["value", "value_zscore50", "k_rmean10"], "label", CLASSES),
              M.Centroids.fit(f, ["value_zscore50", "k_rmean10"], "label", CLASSES),
              M.BinnedBayes.fit(f, "k", BINS, "label", CLASSES)]
    path = D.stream_folder(spark, "bundle")
    M.save(spark, path, models)
    return M.load(spark, path)


@register("stream_alerts", _alerts_sql())
def q_stream_alerts(spark, sf):
    """T1-T7 as one streaming query: readings -> online features -> vote of three
    fitted models -> confidence filter -> per (run, class) cooldown -> alert log."""
    p1, p2, p3 = (m.probabilities() for m in fitted_models(spark, sf))
    f = D.online_features(event_stream(spark, sf), "user_id", ["event_id"], "t", ["value", "k"],
                          keep=["event_id", "user_id", "ts", "t", "value", "k", D.EVENT_TS], late=LATE)
    f = f.withColumns({"p1": p1, "p2": p2, "p3": F.when(F.col("seq_ready"), p3)})
    scored = f.withColumn("r", S.ensemble_vote(F.col("p1"), F.col("p2"), F.col("p3")))
    scored = scored.select("event_id", "user_id", "ts", "t", D.EVENT_TS, "r.class_id", "r.confidence")
    cand = scored.filter((F.col("class_id") > 0) & S.passes_confidence(F.col("class_id"), F.col("confidence"), SURE))
    fired = D.dedup_alerts(cand, ["user_id", "class_id"], ["event_id"], "t", WAIT,
                           keep=["event_id", "user_id", "ts", "class_id", "confidence"], late=None)
    return D.run_to_table(D.alert_record(fired), "alerts").withColumn("confidence", rnd("confidence", 9))


_FIRED = f"""a AS (SELECT user_id, label, event_id, ts, t, k,
             row_number() OVER (PARTITION BY user_id, label ORDER BY ts, event_id) AS rn FROM ev WHERE label <> 0),
nx AS (SELECT a.user_id, a.label, a.rn, min(b.rn) AS nrn FROM a LEFT JOIN a b
         ON b.user_id = a.user_id AND b.label = a.label AND b.t >= a.t + {WAIT} GROUP BY ALL),
f AS (SELECT user_id, label, rn FROM a WHERE rn = 1
      UNION ALL
      SELECT f.user_id, f.label, nx.nrn FROM f JOIN nx ON nx.user_id = f.user_id AND nx.label = f.label
        AND nx.rn = f.rn WHERE nx.nrn IS NOT NULL)"""


@register("stream_alert_dedup", f"""WITH RECURSIVE {EV},
{_FIRED}
SELECT a.event_id, a.user_id, a.label FROM a JOIN f ON f.user_id = a.user_id AND f.label = a.label AND f.rn = a.rn""")
def q_stream_alert_dedup(spark, sf):
    """T6 on the replayed stream: last fired time per (run, class) in keyed
    state, event time; only fired alerts are emitted."""
    out = D.dedup_alerts(event_stream(spark, sf).filter(F.col("label") != 0), ["user_id", "label"], ["event_id"], "t", WAIT,
                         keep=["event_id", "user_id", "label"], late=LATE)
    return D.run_to_table(out, "alert-dedup")


@register("stream_counters", f"""WITH RECURSIVE {EV},
{_FIRED},
n AS (SELECT count(*) AS polls, count(*) FILTER (WHERE label = 3) AS errors, count(*) FILTER (WHERE label <> 3) AS preds,
             count(*) FILTER (WHERE label IN (1, 2)) AS attacks,
             (SELECT count(*) FROM f WHERE label IN (1, 2)) AS fired FROM ev)
SELECT unnest(['polls', 'errors', 'preds', 'attacks', 'fired', 'suppressed', 'late_rows']) AS counter,
       unnest([polls, errors, preds, attacks, fired, attacks - fired, 0]) AS n FROM n""")
def q_stream_counters(spark, sf):
    """What the detector counts as it runs, from metrics observed on the
    stream: readings, failed ones, predictions, attacks, alerts fired and suppressed."""
    ev = event_stream(spark, sf)
    real, label = F.col(D.EVENT_TS) < F.lit(D.CLOSING).cast("timestamp"), F.col("label")
    seen = D.observed(ev, "readings", polls=real, errors=real & (label == 3), preds=real & (label != 3), attacks=real & label.isin(1, 2))
    out = D.dedup_alerts(seen.filter(label.isin(1, 2)), ["user_id", "label"], ["event_id"], "t", WAIT,
                         keep=["event_id", "user_id", "label"], late=LATE, suppressed=True)
    counters = {}
    D.run_to_table(D.observed(out, "alerts", fired=F.col("fired"), suppressed=~F.col("fired")), "counted-alerts", counters=counters)
    names = ("polls", "errors", "preds", "attacks", "fired", "suppressed", "late_rows")
    return spark.createDataFrame([(c, int(counters.get(c, 0))) for c in names], "counter string, n long")


@register("stream_sessions", f"""WITH {EV}, g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n,
       count(*) FILTER (WHERE label = 3) AS errors, max(value) AS top FROM s GROUP BY user_id, session""")
def q_stream_sessions(spark, sf):
    """Sessions of each run (gaps under 12 hours), merged in state."""
    s = D.session_counts(event_stream(spark, sf), D.EVENT_TS, "12 hours", LATE, ["user_id"],
                         errors=F.count(F.when(F.col("label") == 3, 1)), top=F.max("value"))
    at = lambda c: from_micros_ntz(F.unix_micros(c))
    s = s.select("user_id", at(F.col("w.start")).alias("session_start"), at(F.col("w.end")).alias("session_end"), "n", "errors", "top")
    return D.run_to_table(s, "sessions")


@register("stream_sliding_counts", f"""WITH {EV}
SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL (i) DAY AS window_start, label, count(*) AS n
FROM ev, (SELECT unnest([0, 1]) AS i) GROUP BY ALL""")
def q_stream_sliding_counts(spark, sf):
    """Counts over two days, every day."""
    c = D.sliding_counts(event_stream(spark, sf), D.EVENT_TS, "2 days", "1 day", LATE, by=["label"])
    return D.run_to_table(c.select(from_micros_ntz(F.unix_micros(F.col("w.start"))).alias("window_start"), "label", "n"), "sliding")


@register("stream_resends", f"WITH {EV} SELECT event_id, user_id, label, value FROM ev")
def q_stream_resends(spark, sf):
    """Readings of errors and purchases are sent twice; each counts once."""
    ev = event_stream(spark, sf)
    twice = ev.withColumn("copy", F.explode(F.when(F.col("label") >= 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return D.run_to_table(D.without_resends(twice, ["event_id"], D.EVENT_TS, LATE).select("event_id", "user_id", "label", "value"), "resends")


@register("stream_truth", f"""WITH {EV},
p AS (SELECT event_id, user_id, ts, CASE WHEN value > 20 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS predicted FROM ev WHERE k >= 20),
t AS (SELECT event_id, user_id, label, ts + INTERVAL (k) MINUTE AS told FROM ev WHERE label <> 0)
SELECT p.event_id, p.user_id, CAST(p.predicted AS INTEGER) AS predicted, t.label AS truth, p.predicted = t.label AS correct
FROM p LEFT JOIN t ON p.user_id = t.user_id AND p.event_id = t.event_id AND t.told BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR""")
def q_stream_truth(spark, sf):
    """Predictions of a rule against the class told up to an hour later, on
    two streams; a prediction nothing is told about in time has no truth."""
    ev = event_stream(spark, sf).filter((F.col("k") >= 20) | (F.col(D.EVENT_TS) >= F.lit(D.CLOSING).cast("timestamp")))
    rule = F.when(F.col("value") > 20, 3).when(F.col("value") > 10, 2).otherwise(1)
    p = ev.filter((F.col(D.EVENT_TS) < F.lit(D.CLOSING).cast("timestamp")) | (F.col("label") == 0)).select(
        "event_id", "user_id", D.EVENT_TS, rule.alias("predicted"))
    told = event_stream(spark, sf).filter(F.col("label") != 0).select(
        "event_id", "user_id", F.col("label").alias("truth"),
        F.timestamp_micros(F.unix_micros(D.EVENT_TS) + (F.col("k") * 60_000_000).cast("long")).alias("truth_ts"))
    j = D.with_truth(p, told, ["user_id", "event_id"], "1 HOUR", LATE)
    return D.run_to_table(j.select("event_id", "user_id", "predicted", "truth", (F.col("predicted") == F.col("truth")).alias("correct")), "truth")


POLLS = 32                  # daily snapshots asked for; the days there are none of give null readings


@register("stream_poll", f"""WITH {EV},
p AS (SELECT unnest(range({POLLS})) AS poll)
SELECT poll, event_id, user_id, value FROM p LEFT JOIN ev ON date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) = poll""")
def q_stream_poll(spark, sf):
    """The events as daily snapshots of an endpoint, polled one after the other."""
    folder = D.stream_folder(spark, "snapshots")
    day = F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    ev = table(spark, sf, "events").select("event_id", "user_id", "value", day.alias("poll"))
    ev.repartition("poll").write.partitionBy("poll").json(folder)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    s = polled(spark, "vigil.sources.poll:snapshot", "event_id long, user_id long, value double", uri,
               polls=POLLS, batch=8, wait=0.01)
    return D.run_to_table(s, "polled", until_idle=True)

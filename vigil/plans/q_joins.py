"""Fold, dimension-join and neighbour queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions.columns import rnd
from vigil.operators import folds as FD
from vigil.plans.registry import EV, register
from vigil.sources.tables import events

COOLDOWN_S = 3600.0


@register("alert_dedup", f"""WITH RECURSIVE {EV},
a AS (SELECT user_id, label, event_id, t,
             row_number() OVER (PARTITION BY user_id, label ORDER BY ts, event_id) AS rn FROM ev WHERE label <> 0),
nx AS (SELECT a.user_id, a.label, a.rn, min(b.rn) AS nrn FROM a LEFT JOIN a b
         ON b.user_id = a.user_id AND b.label = a.label AND b.t >= a.t + {COOLDOWN_S} GROUP BY ALL),
f AS (SELECT user_id, label, rn FROM a WHERE rn = 1
      UNION ALL
      SELECT f.user_id, f.label, nx.nrn FROM f JOIN nx ON nx.user_id = f.user_id AND nx.label = f.label
        AND nx.rn = f.rn WHERE nx.nrn IS NOT NULL)
SELECT a.event_id, a.user_id, a.label, f.rn IS NOT NULL AS fired
FROM a LEFT JOIN f ON f.user_id = a.user_id AND f.label = a.label AND f.rn = a.rn""")
def q_alert_dedup(spark, sf):
    ev = events(spark, sf).filter(F.col("label") != 0).select("event_id", "user_id", "label", "ts", "t")
    out = FD.alert_dedup(ev, ["user_id", "label"], ["ts", "event_id"], "t", COOLDOWN_S)
    return out.select("event_id", "user_id", "label", "fired")




# --- dimension joins (J1, J7, P7, P11) and splits / reports (K8, K9) ----------------------

from vigil.functions.dims import ATTACK_REGISTRY, ID_REMAP, attach_dimension, map_lookup  # noqa: E402
from vigil.operators import labels as L  # noqa: E402
from vigil.plans.registry import LABEL_NAME_SQL  # noqa: E402
from vigil.sources.tables import EVENTS_TL, table  # noqa: E402

# Fixed values for the event stream's own remediation dimension (label -> severity, actions).
EVENT_REMEDIATION = {1: ("LOW", ["verify account"]), 2: ("MEDIUM", ["check payment", "confirm order"]),
                     3: ("HIGH", ["page on-call", "open incident", "collect logs"])}


@register("remediation_join", f"""WITH {EV},
d AS (SELECT * FROM (VALUES (1, 'LOW', 'verify account'), (2, 'MEDIUM', 'check payment; confirm order'),
                            (3, 'HIGH', 'page on-call; open incident; collect logs')) AS d(label, severity, actions))
SELECT event_id, ev.label, {LABEL_NAME_SQL.replace("label", "ev.label")} AS label_name,
       coalesce(d.severity, 'Unknown') AS severity, coalesce(d.actions, '') AS actions
FROM ev LEFT JOIN d ON ev.label = d.label""")
def q_remediation_join(spark, sf):
    from vigil.sources.tables import EVENT_LABEL_NAMES
    from vigil.functions.dims import literal_table
    dim = literal_table(spark, [(k, s, a) for k, (s, a) in EVENT_REMEDIATION.items()],
                        "label int, severity string, actions array<string>")
    ev = events(spark, sf).select("event_id", "label")
    out = attach_dimension(ev, dim, "label", {"severity": "Unknown"})
    return out.select("event_id", "label", map_lookup(EVENT_LABEL_NAMES, "label").alias("label_name"),
                      "severity", F.coalesce(F.array_join("actions", "; "), F.lit("")).alias("actions"))


@register("normal_vs_group", f"""WITH {EV}, n AS (SELECT avg(value) AS nv, avg(k) AS nk, stddev_samp(value) AS sv FROM ev WHERE label = 0)
SELECT label, count(*) AS n_rows, round(avg(value) - nv, 9) AS value_mean_diff, round(avg(k) - nk, 9) AS k_mean_diff,
       round(stddev_samp(value) / sv, 9) AS value_std_ratio
FROM ev, n WHERE label <> 0 GROUP BY label, nv, nk, sv""")
def q_normal_vs_group(spark, sf):
    ev = events(spark, sf).select("label", "value", "k")
    # one grouped pass; the single normal row is spread by a window over the
    # per-label table instead of a second scan + cross join
    g = ev.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mv"),
                                F.avg("k").alias("mk"), F.stddev_samp("value").alias("s"))
    w = Window.partitionBy()
    nrm = lambda c: F.max(F.when(F.col("label") == 0, F.col(c))).over(w)
    j = g.select("*", nrm("mv").alias("nv"), nrm("mk").alias("nk"), nrm("s").alias("sv")).filter("label <> 0")
    return j.select("label", "n_rows", rnd(F.col("mv") - F.col("nv"), 9).alias("value_mean_diff"),
                    rnd(F.col("mk") - F.col("nk"), 9).alias("k_mean_diff"),
                    rnd(F.col("s") / F.col("sv"), 9).alias("value_std_ratio"))


def _map_sql(mapping: dict, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {k} THEN {v!r}" if isinstance(v, str) else
                              f"WHEN {key} = {k} THEN {v}" for k, v in mapping.items()) + " END"


@register("class_remap", f"""SELECT n_nationkey, {_map_sql(ID_REMAP, "n_nationkey")} AS class_id,
  {_map_sql(ATTACK_REGISTRY, "n_nationkey").replace("'", "'")} AS attack_name,
  CAST(n_nationkey > 0 AS INTEGER) AS is_attack FROM nation""")
def q_class_remap(spark, sf):
    from vigil.sources.runs import remap_classes
    n = table(spark, sf, "nation").select("n_nationkey")
    out = remap_classes(n, "n_nationkey", "class_id")
    return out.select("n_nationkey", "class_id", map_lookup(ATTACK_REGISTRY, "n_nationkey").alias("attack_name"),
                      "is_attack")


@register("identify_nation", """SELECT s_suppkey, coalesce(n_name, 'Unknown') AS nation_name
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def q_identify_nation(spark, sf):
    from vigil.functions.schema import identify
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("address"), F.col("n_name").alias("name"))
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return identify(sup, "s_nationkey", nat, "nation_name").select("s_suppkey", "nation_name")


@register("split_outputs", f"""WITH {EV}
SELECT label <> 0 AS is_attack, count(*) AS n_rows, count(DISTINCT user_id) AS n_runs FROM ev GROUP BY 1""")
def q_split_outputs(spark, sf):
    ev = events(spark, sf).select("label", "user_id")
    return ev.groupBy((F.col("label") != 0).alias("is_attack")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_runs"))


@register("episode_totals", f"""WITH {EV}, x AS (
  SELECT *, CASE WHEN lag(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> label THEN 1 ELSE 0 END AS chg FROM ev),
s AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM x),
e AS (SELECT user_id, seg, min(label) AS label, count(*) AS n_rows,
             (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration_s FROM s GROUP BY user_id, seg)
SELECT label, count(*) AS episodes, round(sum(duration_s), 6) AS total_duration_s, CAST(sum(n_rows) AS BIGINT) AS total_rows
FROM e WHERE label <> 0 GROUP BY label""")
def q_episode_totals(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "ts", "label")
    tot = L.episode_totals(L.episodes(ev, EVENTS_TL, "ts"), EVENTS_TL)
    return tot.withColumn("total_duration_s", rnd("total_duration_s", 6))


# --- neighbours (J9, O9) ------------------------------------------------------------------

KNN_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS nid, b.label AS nl, list_distance(a.v, b.v) AS d
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nid) AS rk FROM p),
t AS (SELECT * FROM r WHERE rk <= 5),
z AS (SELECT vec_id, bool_or(d = 0) AS hz, max(d) AS d5 FROM t GROUP BY vec_id),
w AS (SELECT t.vec_id, nl, sum(CASE WHEN z.hz THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END) AS wt
      FROM t JOIN z ON t.vec_id = z.vec_id GROUP BY t.vec_id, nl),
v AS (SELECT vec_id, arg_max(nl, (wt, -nl)) AS pred_label FROM w GROUP BY vec_id)
SELECT e.vec_id, e.label, CAST(v.pred_label AS BIGINT) AS pred_label, round(z.d5, 6) AS nn5_dist
FROM e JOIN v ON e.vec_id = v.vec_id JOIN z ON e.vec_id = z.vec_id"""


@register("knn_vote", KNN_SQL)
def q_knn_vote(spark, sf):
    from vigil.operators.neighbors import knn, neighbour_vote
    emb = table(spark, sf, "embeddings")
    nn = knn(emb, emb, 5, "vec_id", "embedding", ref_label="label")
    vote = neighbour_vote(nn.select("vec_id", "nn_dist", "nn_labels"))
    d5 = nn.select("vec_id", rnd(F.element_at("nn_dist", -1), 6).alias("nn5_dist"))
    return (emb.select("vec_id", "label").join(vote, "vec_id").join(d5, "vec_id")
            .select("vec_id", "label", "pred_label", "nn5_dist"))


@register("smote_counts", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, CAST(greatest(n, (SELECT max(n) FROM c)) AS BIGINT) AS n_rows,
       CAST(greatest((SELECT max(n) FROM c) - n, 0) AS BIGINT) AS n_synthetic FROM c""")
def q_smote_counts(spark, sf):
    from vigil.operators.neighbors import smote
    emb = table(spark, sf, "embeddings")
    counts = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    target = counts.agg(F.max("n")).first()[0]
    labels = [r.label for r in counts.select("label").collect()]
    out = smote(emb, "vec_id", "embedding", "label", {c: target for c in labels}, k=3)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("synthetic").alias("n_synthetic"))

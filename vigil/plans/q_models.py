"""Model queries: features from ``events``, chronological split per run, fit on
the train part, score every row.  The isolation forest is repeated by its SQL from
the draws on; the others are checked by rows here and by SQL from their written
weights and trees in the tests."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigil.functions.columns import rnd
from vigil.operators import boosting as BO
from vigil.operators import chunking as CH
from vigil.operators import features as X
from vigil.operators import isolation as ISO
from vigil.operators import kernel as KE
from vigil.operators import models as MD
from vigil.operators import splits as SP
from vigil.plans.registry import EV, register
from vigil.sources.tables import EVENTS_TL as TL, events

FEATURES = ["value", "k", "value_rate", "value_accel", "value_mean_5s", "value_std_5s",
            "k_mean_5s", "k_std_5s", "value_zscore"]


def feature_table(spark, sf):
    ev = events(spark, sf).select("event_id", "user_id", "ts", "t", "label", "value", "k")

    def fn(d, tl):
        return X.build(d, d.columns, X.rate_accel("value", tl), X.rolling_full("value", tl, 5),
                       X.rolling_full("k", tl, 5))
    f = CH.chunked(ev, TL, fn, back=4)
    f = X.add_expanding_prior_z(f, TL, ["value"])
    f = SP.chrono_split(f, TL)
    # fit and scoring both read the windowed features: materialise them once
    # in the shared checkpoint folder (reliable, cuts the lineage)
    from vigil.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return MD.prepare(f, FEATURES, "label", keep=["event_id", "is_train"]).checkpoint()


@register("rf_score")
def q_rf_score(spark, sf):
    ft = feature_table(spark, sf)
    train = MD.with_weights(ft.filter("is_train"))
    model = MD.random_forest(FEATURES, num_trees=20, max_depth=6).fit(train)
    s = model.transform(ft)
    return s.select("event_id", F.col("prediction").cast("int").alias("class_id"),
                    F.array_max(vector_to_array("probability")).alias("confidence"))


@register("gbt_score")
def q_gbt_score(spark, sf):
    ft = feature_table(spark, sf).withColumn("label", (F.col("label") == 2).cast("double"))
    model = MD.boosted_trees(FEATURES, 2, max_iter=10, max_depth=4).fit(ft.filter("is_train"))
    s = model.transform(ft)
    return s.select("event_id", F.col("prediction").cast("int").alias("is_purchase"),
                    vector_to_array("probability")[1].alias("p_purchase"))


@register("boosted_classes")
def q_boosted_classes(spark, sf):
    """M2: boosted trees for all four classes at once."""
    ft = feature_table(spark, sf)
    model = BO.fit(ft.filter("is_train"), FEATURES, "label", 4, rounds=10, depth=4)
    p = F.col("probabilities")
    return BO.predict(ft, model).select("event_id", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("class_id"),
                                        F.array_max(p).alias("confidence"))


@register("kernel_svm")
def q_kernel_svm(spark, sf):
    """M5: the RBF machine for all four classes at once."""
    ft = feature_table(spark, sf)
    model = KE.fit(ft.filter("is_train"), FEATURES, "label", 4, columns=128, steps=12)
    s = F.col("scores")
    return KE.predict(ft, model).select("event_id", (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("class_id"),
                                        F.array_max(s).alias("score"))


TREES, ROWS, SEED, DEPTH = 100, 256, 42, 8


def _iso_sql():
    """The forest grown level by level from the same draws, then walked."""
    def draw(i, t, salt):
        x = f"((({i}) % {ISO.PRIME}) * 1103 + ({t}) * 7919 + {salt}) % {ISO.PRIME}"
        return f"(((({x}) * ({x}) + ({i}) % {ISO.PRIME}) % {ISO.PRIME}) * 48271 % {ISO.PRIME})"
    at = "CAST(tree AS BIGINT)"
    parts = [f"""WITH RECURSIVE {EV},
e AS (SELECT event_id, label, [value, k, t - floor(t / 86400) * 86400] AS x FROM ev),
trees AS (SELECT CAST(unnest(range({TREES})) AS BIGINT) AS tree),
s0 AS (SELECT tree, CAST(1 AS BIGINT) AS node, x FROM e, trees WHERE label = 0
       QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {draw('event_id', at, SEED)}, event_id) <= {ROWS})"""]
    for d in range(DEPTH + 1):
        parts.append(f"""g{d} AS (SELECT tree, node, count(*) AS size, [min(x[1]), min(x[2]), min(x[3])] AS lo,
  [max(x[1]), max(x[2]), max(x[3])] AS hi FROM s{d} GROUP BY tree, node),
h{d} AS (SELECT *, list_filter([1, 2, 3], lambda i: hi[i] > lo[i]) AS free FROM g{d}),
n{d} AS (SELECT tree, node, size, lo, hi, CASE WHEN size > 1 AND len(free) > 0 AND {d} < {DEPTH}
  THEN free[{draw('node', at, SEED + 1)} % len(free) + 1] END AS f FROM h{d}),
m{d} AS (SELECT tree, node, size, f, lo[f] + (hi[f] - lo[f]) * ({draw('node', at, SEED + 2)} / CAST({ISO.PRIME} AS DOUBLE)) AS cut FROM n{d})""")
        if d < DEPTH:
            parts.append(f"""s{d + 1} AS (SELECT s.tree, 2 * s.node + CAST(x[f] >= cut AS BIGINT) AS node, x
  FROM s{d} s JOIN m{d} m ON s.tree = m.tree AND s.node = m.node WHERE f IS NOT NULL)""")
    parts.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM m{d}" for d in range(DEPTH + 1)) + ")")
    def c(n):
        return f"(CASE WHEN {n} > 2 THEN 2 * (ln(greatest({n}, 3) - 1) + {ISO.EULER}) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) WHEN {n} = 2 THEN 1.0 ELSE 0.0 END)"
    parts.append(f"""r AS (SELECT event_id, x, tree, CAST(1 AS BIGINT) AS node, 0 AS depth FROM e, trees
  UNION ALL SELECT event_id, x, r.tree, 2 * r.node + CAST(x[f] >= cut AS BIGINT), depth + 1
  FROM r JOIN nodes n ON n.tree = r.tree AND n.node = r.node WHERE f IS NOT NULL),
p AS (SELECT event_id, avg(depth + {c('coalesce(size, 0)')}) AS path FROM r LEFT JOIN nodes n ON n.tree = r.tree AND n.node = r.node
      WHERE f IS NULL GROUP BY event_id)
SELECT event_id, round(pow(2.0, -path / {c(ROWS)}), 9) AS anomaly FROM p""")
    return ",\n".join(parts)


@register("isolation_forest", _iso_sql())
def q_isolation_forest(spark, sf):
    """M9: a forest of 100 trees on normal readings, every reading scored."""
    ev = events(spark, sf).select("event_id", "label", F.col("value").alias("f0"), F.col("k").alias("f1"),
                                  (F.col("t") - F.floor(F.col("t") / 86400) * 86400).alias("f2"))
    names = ["f0", "f1", "f2"]
    forest = ISO.grow(ev.filter("label = 0"), names, "event_id", TREES, ROWS, SEED)
    return ISO.score(ev, forest, names, ROWS).select("event_id", rnd("anomaly", 9).alias("anomaly"))

"""Row-wise items over ``events``: infinite values, distance from the normal
state, aligned features, response curves, registers, switches, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import columns as C
from vigil.functions import schema as SC
from vigil.functions.columns import rnd
from vigil.operators import features as X
from vigil.plans.registry import EV, register
from vigil.sources.tables import events

INF = "CASE WHEN k % 10 = 0 THEN CAST('inf' AS DOUBLE) WHEN k % 10 = 1 THEN CAST('-inf' AS DOUBLE) WHEN k % 10 = 2 THEN NULL ELSE value END"


def _with_inf(ev):
    last = F.col("k") % 10
    inf = F.lit(float("inf"))
    return ev.withColumn("x", F.when(last == 0, inf).when(last == 1, -inf).when(last != 2, F.col("value")))


@register("infinite_replaced", f"""WITH {EV}, e AS (SELECT event_id, {INF} AS x FROM ev),
m AS (SELECT quantile_cont(x, 0.5) AS m FROM e WHERE isfinite(x))
SELECT event_id, CASE WHEN isinf(x) THEN m ELSE x END AS x FROM e, m""")
def q_infinite_replaced(spark, sf):
    """Infinite readings get the median of the finite ones, nulls stay."""
    return X.finite_features(_with_inf(events(spark, sf).select("event_id", "k", "value")).select("event_id", "x"), ["x"])


@register("mahalanobis", f"""WITH {EV},
m AS (SELECT avg(value) AS mv, avg(k) AS mk, var_samp(value) AS a, covar_samp(value, k) AS b, var_samp(k) AS c FROM ev WHERE label = 0),
d AS (SELECT event_id, value - mv AS x, k - mk AS y, a, b, c FROM ev, m)
SELECT event_id, round(sqrt((c * x * x - 2 * b * x * y + a * y * y) / (a * c - b * b)), 6) AS distance FROM d""")
def q_mahalanobis(spark, sf):
    """Distance of every reading from the normal ones."""
    ev = events(spark, sf)
    mu, inv = X.mahalanobis_fit(ev, ["value", "k"], "label", 0)
    return ev.select("event_id", rnd(X.mahalanobis(["value", "k"], mu, inv), 6).alias("distance"))


@register("aligned_features", f"""WITH {EV}, e AS (SELECT event_id, value, k, {INF} AS x FROM ev)
SELECT CAST(event_id AS DOUBLE) AS event_id, k, 0.0::DOUBLE AS absent, CASE WHEN x IS NULL OR isinf(x) THEN 0 ELSE x END AS x, value FROM e""")
def q_aligned_features(spark, sf):
    """The columns a model was trained on, in its order."""
    ev = _with_inf(events(spark, sf).select("event_id", "value", "k", "label"))
    return X.align_features(ev, ["event_id", "k", "absent", "x", "value"])


@register("response_curves", f"""WITH {EV}
SELECT event_id, round(20 + (value - 20) * exp(-k / 30), 9) AS first_order,
       round(value + (20 - value) / (1 + exp(-(k / 100 * 10 - 5))), 9) AS s_curve FROM ev""")
def q_response_curves(spark, sf):
    """F8: first-order and logistic responses from the reading to 20."""
    k, target = F.col("k"), F.lit(20.0)
    return events(spark, sf).select("event_id", rnd(C.exp_response(k, "value", target, F.lit(30.0)), 9).alias("first_order"),
                                    rnd(C.logistic_response(k, "value", target, F.lit(100.0)), 9).alias("s_curve"))


@register("checksums", f"""WITH {EV}
SELECT event_id, CAST(list_sum(list_transform(string_split(event_type || user_id, ''), lambda c: ascii(c))) % 256 AS INTEGER) AS checksum FROM ev""")
def q_checksums(spark, sf):
    """The frame checksum over the bytes of a reading's name."""
    name = F.concat("event_type", F.col("user_id").cast("string")).cast("binary")
    return events(spark, sf).select("event_id", C.checksum8(name).cast("int").alias("checksum"))


REGISTERS = [("flow", 100, "l/s"), ("level", 1, "mm"), ("missing", 10, "-")]


@register("registers", f"""WITH {EV}, r AS (SELECT event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS a, CAST(k AS BIGINT) AS b FROM ev)
SELECT event_id, a / 100 AS flow, b AS level, CAST(NULL AS DOUBLE) AS missing, b % 2 = 1 AS pump,
       CAST(trunc(a / 100 * 10) AS BIGINT) AS encoded FROM r""")
def q_registers(spark, sf):
    """P10: raw registers and coils to named values and back."""
    raw = F.array(F.floor(F.col("value") * 100 + 0.5).cast("long"), F.col("k").cast("long"))
    bits = F.array((F.col("k").cast("long") % 2).cast("int"))
    ev = events(spark, sf).select("event_id", *SC.decode_registers(raw, REGISTERS), *SC.decode_coils(bits, [("pump", "w")]))
    return ev.withColumn("encoded", SC.encode_value(F.col("flow"), 10))


SWITCHES = {"view": "True", "click": "false ", "signup": "1", "purchase": "0.0"}


@register("switches", f"""WITH {EV}, s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 1 WHEN 'click' THEN 0
  WHEN 'purchase' THEN 0 END AS on_, k, value FROM ev)
SELECT event_id, CAST(on_ AS TINYINT) AS switch, CAST(coalesce(on_, 0) + CAST(k > 50 AS INT) + CAST(value > 20 AS INT) AS INTEGER) AS total_pumps_on FROM s""")
def q_switches(spark, sf):
    """Switch texts to 0, 1 or null, and how many pumps are on."""
    text = F.element_at(F.create_map(*(F.lit(x) for kv in SWITCHES.items() for x in kv)), F.col("event_type"))
    ev = events(spark, sf).select("event_id", C.to_tinyint_bool(text).alias("P_101"), (F.col("k") > 50).alias("P_102"),
                                  (F.col("value") > 20).alias("P_203"), F.lit(True).alias("P_x"))
    return ev.select("event_id", F.col("P_101").alias("switch"), *(c.cast("int").alias(n) for n, c in X.pumps_on(ev).items()))

"""Query registry: name -> (spark callable, oracle SQL).

Query modules register themselves with :func:`register`; importing
``vigil.plans.registry`` imports them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# SQL prelude shared by the oracles: the events table in the sensor-run model.
EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2
                              WHEN 'error' THEN 3 ELSE 0 END AS INTEGER) AS label,
         epoch_us(ts) / 1e6 AS t
  FROM events)"""

LABEL_NAME_SQL = ("CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'signup' "
                  "WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' END")

W_EV = "PARTITION BY user_id ORDER BY ts, event_id"

from vigil.plans import merge, q_analysis, q_features, q_joins, q_labels, q_models, q_quality, q_rows, q_stream  # noqa: E402,F401

"""Flagship query: the minimum end-to-end slice of the merge job.

events -> elapsed seconds per run -> boundary-leakage removal (3600 s)
-> label x run coverage of the rows kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.dims import map_lookup
from vigil.operators import labels as L
from vigil.operators import quality as Q
from vigil.sources.tables import EVENT_LABEL_NAMES, EVENTS_TL, events


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_id", "user_id", "ts", "t", "label")
    ev = L.add_elapsed(ev, EVENTS_TL, "ts")
    tl = EVENTS_TL.with_(t="elapsed_seconds")
    kept = L.remove_boundary_leakage(ev, tl, 3600.0)
    kept = kept.withColumn("week", F.weekofyear("ts"))
    return Q.coverage(kept, "label", "week", map_lookup(EVENT_LABEL_NAMES, "label"))

"""The merge job: recorded runs become one training table with its reports.

union of drifting schemas -> coverage -> drift of the normal state -> removal
of rows near label changes -> constant columns dropped -> signal quality ->
table and reports written.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import labels as L
from vigil.operators import quality as Q
from vigil.operators.timeline import Timeline
from vigil.plans.registry import EV, register
from vigil.sources.sinks import write_dataset, write_reports
from vigil.sources.tables import EVENTS_TL, events


@dataclass
class Merged:
    """The merged table, its reports, and per run the columns it has too many
    or too few."""
    table: DataFrame
    reports: dict[str, DataFrame]
    schema: list[tuple]

    def write(self, folder: str, run: str, sort: list[str]) -> None:
        write_dataset(self.table, os.path.join(folder, "table"), run, sort)
        write_reports(self.reports, os.path.join(folder, "reports"))


def merge_runs(runs: dict, tl: Timeline, run: str, sensors: list[str], window_s: float, normal=0) -> Merged:
    """Merge ``runs`` (run id -> frame), whose columns may differ.  ``tl`` is the
    timeline inside a run; the first run is the reference of the schema check and
    of the drift."""
    ids = list(runs)
    rows = L.union_runs([runs[r].withColumn(run, F.lit(r)) for r in ids])
    return merge_rows(rows, tl, run, sensors, window_s, ids[0], normal, L.schema_diff({r: runs[r].columns for r in ids}))


def merge_rows(rows: DataFrame, tl: Timeline, run: str, sensors: list[str], window_s: float, first, normal=0,
               schema: list[tuple] = ()) -> Merged:
    """Merge runs that lie in one table, told apart by the column ``run``: one
    scan, however many there are.  ``first`` is the drift's reference run."""
    kept = L.remove_boundary_leakage(rows, tl, window_s)
    before, after = Q.coverage(rows, tl.label, run), Q.coverage(kept, tl.label, run).withColumnRenamed("n", "n_kept")
    totals = (before.join(after, [tl.label, run], "left")
              .select(run, tl.label, F.col("n").alias("n_rows"), F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept")))
    dead_report = Q.dead_columns(kept, sensors)
    dead = [r["column"] for r in dead_report.collect() if r["is_dead"]]      # one row a sensor
    live = [s for s in sensors if s not in dead]
    table = kept.drop(*dead)
    reports = {"coverage": totals,
               "drift": Q.baseline_drift(rows, tl.label, run, sensors, first),
               "dead_columns": dead_report}
    if live:
        reports["signal_quality"] = Q.signal_quality(table, tl.label, run, live, normal)
    return Merged(table, reports, list(schema))


WEEK = "isoyear(ts) * 100 + weekofyear(ts)"


@register("merge_job", f"""WITH {EV}, x AS (SELECT *, lag(label) OVER (PARTITION BY user_id, {WEEK} ORDER BY ts, event_id) AS pl,
       {WEEK} AS run FROM ev),
tr AS (SELECT user_id, run, t FROM x WHERE pl IS NOT NULL AND label <> pl)
SELECT CAST(run AS INTEGER) AS run, label, count(*) AS n_rows, count(*) FILTER (WHERE NOT EXISTS (
         SELECT 1 FROM tr WHERE tr.user_id = x.user_id AND tr.run = x.run AND abs(x.t - tr.t) <= 3600.0)) AS n_kept
FROM x GROUP BY run, label""")
def q_merge_job(spark, sf):
    """The events of each week as a recorded run, merged; the coverage report."""
    week = F.extract(F.lit("YEAROFWEEK"), F.col("ts")) * 100 + F.weekofyear("ts")
    ev = events(spark, sf).select("event_id", "user_id", "ts", "t", "label", "value", "k", week.cast("int").alias("run"))
    first = ev.agg(F.min("run").alias("run")).first()["run"]
    return merge_rows(ev, EVENTS_TL.with_(run=("user_id", "run")), "run", ["value", "k"], 3600.0, first).reports["coverage"]

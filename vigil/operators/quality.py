"""Data-quality reports: coverage, drift, dead columns, signal quality,
range/domain/missing/duplicate checks, sampling, per-run summaries, rules.

Reports over many columns are built as one aggregation (or one unpivot), never
one job per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, label: str, run: str, label_name: Column | None = None) -> DataFrame:
    """Row counts per label and run in long form (A2): one map-side combined
    aggregation, any number of runs."""
    out = df.groupBy(label, run).agg(F.count(F.lit(1)).alias("n"))
    return out if label_name is None else out.withColumn("label_name", label_name)


def coverage_matrix(df: DataFrame, label: str, run: str, runs: list, label_name: Column | None = None,
                    fmt: str = "run_{:02d}") -> DataFrame:
    """Rows = labels, columns = runs, cells = row counts, 0 filled (A2).

    ``runs`` names the columns wanted; :func:`coverage` is the form that needs
    no list.  The pivot is a single aggregation with one conditional count per run.
    """
    out = (df.groupBy(label).pivot(run, runs).count().na.fill(0, subset=[str(r) for r in runs]))
    for r in runs:
        out = out.withColumnRenamed(str(r), fmt.format(r))
    if label_name is not None:
        out = out.withColumn("label_name", label_name)
    return out


def _unpivot_row(df: DataFrame, keep: list[str], fields: dict[str, dict[str, Column]],
                 name_col: str = "column") -> DataFrame:
    """Turn a (small) aggregated row set with per-column metrics into one row
    per column: ``fields = {column: {metric: expr}}``."""
    metrics = list(next(iter(fields.values())).keys())
    arr = F.array(*[F.struct(F.lit(c).alias(name_col),
                             *[m[k].alias(k) for k in metrics]) for c, m in fields.items()])
    return df.select(*keep, F.explode(arr).alias("_u")).select(*keep, "_u.*")


def class_distribution(df: DataFrame, label: str, label_name: Column | None = None,
                       digits: int = 2) -> DataFrame:
    """Count and percentage per label (A1)."""
    out = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = out.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits))
    if label_name is not None:
        out = out.withColumn("label_name", label_name)
    return out


def normal_attack_totals(df: DataFrame, label: str, normal=0) -> DataFrame:
    """Normal rows, attack rows and their ratio (A1)."""
    is_n = F.col(label) == normal
    return df.agg(F.count_if(is_n).alias("n_normal"), F.count_if(~is_n).alias("n_attack")).withColumn(
        "normal_to_attack", F.round(F.try_divide(F.col("n_normal").cast("double"), F.col("n_attack")), 6))


def baseline_drift(df: DataFrame, label: str, run: str, sensors: list[str], first_run,
                   normal=0, warn_factor: float = 0.5) -> DataFrame:
    """Per sensor x run mean of normal rows; flat runs (std 0) are flagged and
    left out of the drift; drift = max - min of the other means, WARN when it
    exceeds ``warn_factor`` x the first run's normal std (A3)."""
    nd = df.filter(F.col(label) == normal)
    per = nd.groupBy(run).agg(*[f for s in sensors for f in (
        F.avg(s).alias(f"m_{s}"), F.stddev_samp(s).alias(f"s_{s}"))])
    per = _unpivot_row(per, [run], {s: {"mean": F.col(f"m_{s}"), "std": F.col(f"s_{s}")}
                                    for s in sensors}, "sensor")
    per = per.withColumn("is_flat", F.coalesce(F.col("std") == 0, F.lit(False)))
    from pyspark.sql import Window
    ws = Window.partitionBy("sensor")
    live = F.when(~F.col("is_flat"), F.col("mean"))
    first_std = F.max(F.when(F.col(run) == first_run, F.col("std"))).over(ws)
    n_live = F.count(live).over(ws)
    drift = F.when(n_live > 1, F.max(live).over(ws) - F.min(live).over(ws))
    return (per.withColumn("max_drift", drift)
               .withColumn("drift_warn", F.when(drift.isNotNull(), drift > warn_factor * first_std)))


def dead_columns(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns with at most one distinct non-null value (A4), in one pass:
    ``min = max`` or no non-null value, per group if ``by`` is given."""
    by = by or []
    aggs = [((F.min(c) == F.max(c)) | (F.count(c) == 0)).alias(f"d_{c}") for c in columns]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return _unpivot_row(g, by, {c: {"is_dead": F.coalesce(F.col(f"d_{c}"), F.lit(True))} for c in columns})


def _moments(s: str) -> list[Column]:
    return [F.count(s).alias(f"n_{s}"), F.avg(s).alias(f"m_{s}"), F.stddev_samp(s).alias(f"s_{s}")]


def _pooled_std(s: str) -> Column:
    """Overall sample std of sensor ``s`` from per-group (n, mean, std) rows,
    over a window spanning all groups (Chan's combination; no second pass)."""
    g = Window.partitionBy()
    n = F.col(f"n_{s}").cast("double")
    m2 = F.coalesce(F.col(f"s_{s}") ** 2 * (n - 1), F.lit(0.0))
    tot = F.sum(n).over(g)
    mean = F.sum(n * F.col(f"m_{s}")).over(g) / tot
    ss = F.sum(m2 + n * (F.col(f"m_{s}") - mean) ** 2).over(g)
    return F.sqrt(ss / (tot - 1))


def signal_quality(df: DataFrame, label: str, run: str, sensors: list[str], normal=0,
                   label_name: Column | None = None, invisible_below: float = 0.5) -> DataFrame:
    """Per non-normal label: z = |mean_label - mean_normal| / std_normal per
    sensor (0 when std_normal is 0, sensors with overall std 0 skipped), the
    two best sensors, rows, runs present, invisible flag (A5).

    One grouped aggregation over the rows; the normal-class statistics and
    the overall std come from windows over that per-label table.
    """
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("total_rows"),
                                F.countDistinct(run).alias("runs_present"),
                                *[m for s in sensors for m in _moments(s)])
    g = Window.partitionBy()
    normal_of = lambda c: F.max(F.when(F.col(label) == normal, F.col(c))).over(g)
    per = per.select("*", *[normal_of(f"m_{s}").alias(f"nm_{s}") for s in sensors],
                     *[normal_of(f"s_{s}").alias(f"ns_{s}") for s in sensors],
                     *[_pooled_std(s).alias(f"o_{s}") for s in sensors])
    att = per.filter(F.col(label) != normal)
    fields = {}
    for i, s in enumerate(sensors):
        z = F.when(F.col(f"ns_{s}") > 0, F.abs(F.col(f"m_{s}") - F.col(f"nm_{s}")) / F.col(f"ns_{s}")).otherwise(0.0)
        fields[s] = {"z": F.round(z, 2), "idx": F.lit(i), "ok": F.coalesce(F.col(f"o_{s}") > 0, F.lit(False))}
    u = _unpivot_row(att, [label, "total_rows", "runs_present"], fields, "sensor").filter("ok")
    w = Window.partitionBy(label).orderBy(F.col("z").desc(), F.col("idx"))
    u = u.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 2)
    out = u.groupBy(label, "total_rows", "runs_present").agg(
        F.max(F.when(F.col("rk") == 1, F.col("sensor"))).alias("top_signal_1"),
        F.max(F.when(F.col("rk") == 1, F.col("z"))).alias("top_z_1"),
        F.max(F.when(F.col("rk") == 2, F.col("sensor"))).alias("top_signal_2"),
        F.max(F.when(F.col("rk") == 2, F.col("z"))).alias("top_z_2"))
    out = out.withColumn("invisible", F.col("top_z_1") < invisible_below)
    if label_name is not None:
        out = out.withColumn("label_name", label_name)
    return out


def range_report(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per limited column: rows below/above, actual min/max, expected."""
    cols = [c for c in limits if c in df.columns]
    aggs = []
    for c in cols:
        lo, hi = limits[c]
        aggs += [F.count_if(F.col(c) < lo).alias(f"b_{c}"), F.count_if(F.col(c) > hi).alias(f"a_{c}"),
                 F.min(c).cast("double").alias(f"mn_{c}"), F.max(c).cast("double").alias(f"mx_{c}")]
    g = df.agg(*aggs)
    return _unpivot_row(g, [], {c: {
        "lo": F.lit(float(limits[c][0])), "hi": F.lit(float(limits[c][1])),
        "n_below": F.col(f"b_{c}"), "n_above": F.col(f"a_{c}"),
        "n_violations": F.col(f"b_{c}") + F.col(f"a_{c}"),
        "actual_min": F.col(f"mn_{c}"), "actual_max": F.col(f"mx_{c}")} for c in cols})


def range_reasons(df: DataFrame, limits: dict[str, tuple[float, float]], keys: list[str]) -> DataFrame:
    """Row-level rule check: one row per (row, column) out of range with the
    reason text (P15)."""
    cols = [c for c in limits if c in df.columns]
    checks = []
    for c in cols:
        lo, hi = limits[c]
        reason = (F.when(F.col(c) < lo, F.format_string(f"{c} below min %s", F.lit(str(lo))))
                  .when(F.col(c) > hi, F.format_string(f"{c} above max %s", F.lit(str(hi)))))
        checks.append(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                               reason.alias("reason")))
    return (df.select(*keys, F.explode(F.array(*checks)).alias("_c"))
              .select(*keys, "_c.*").filter(F.col("reason").isNotNull()))


def clip_to_limits(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip columns to limits; adds ``<c>_clipped`` flags."""
    out = df
    for c, (lo, hi) in limits.items():
        if c in df.columns:
            out = out.withColumn(f"{c}_clipped", (F.col(c) < lo) | (F.col(c) > hi)) \
                     .withColumn(c, F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(c))))
    return out


def domain_check(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    """Every non-null value of each column within its allowed set (A10)."""
    aggs = []
    for c, allowed in domains.items():
        aggs += [F.coalesce(F.bool_and(F.col(c).isin(*allowed)), F.lit(True)).alias(f"ok_{c}"),
                 F.count_if(~F.col(c).isin(*allowed)).alias(f"bad_{c}"),
                 F.min(c).cast("double").alias(f"mn_{c}"), F.max(c).cast("double").alias(f"mx_{c}")]
    g = df.agg(*aggs)
    return _unpivot_row(g, [], {c: {"in_domain": F.col(f"ok_{c}"), "n_outside": F.col(f"bad_{c}"),
                                    "min": F.col(f"mn_{c}"), "max": F.col(f"mx_{c}")} for c in domains})


def missing_report(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Null (and NaN) count and percentage for every column, one pass."""
    columns = columns or df.columns
    types = dict(df.dtypes)

    def miss(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(c)
        return F.count_if(m)
    g = df.agg(F.count(F.lit(1)).alias("_n"), *[miss(c).alias(f"n_{c}") for c in columns])
    return _unpivot_row(g, [], {c: {"n_missing": F.col(f"n_{c}"),
                                    "pct_missing": F.round(F.col(f"n_{c}") * 100.0 / F.col("_n"), digits)}
                                for c in columns})


def duplicate_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row (on ``columns``), count and pct."""
    columns = columns or df.columns
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("n_duplicates")).withColumn(
        "pct_duplicates", F.round(F.col("n_duplicates") * 100.0 / F.col("n_rows"), 4))


def sampling_report(df: DataFrame, tl, ts: str, gap_s: float, ingest: str | None = None,
                    force_chunks: bool | None = None) -> DataFrame:
    """Per run: median / min / max / mean interval between consecutive rows,
    gaps longer than ``gap_s`` and rows out of order against the ingest
    sequence (A13).  Both look-backs are one row, so long runs are cut into
    chunks with a 1-row halo; the median comes from
    :func:`vigil.operators.quantiles.exact_quantiles` (bounded memory)."""
    from vigil.functions.columns import micros
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(df, tl, back=1, force=force_chunks)
    x = CH.finish(x.withColumn("_dt", (micros(ts) - F.lag(micros(ts)).over(t2.w())) / 1e6), ch)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("_dt").alias("min_dt"),
            F.max("_dt").alias("max_dt"), F.avg("_dt").alias("mean_dt"),
            F.count_if(F.col("_dt") > gap_s).alias("n_gaps")]
    if ingest:
        ti = tl.with_(order=(ingest,))
        y, t3, ch2 = CH.plan_chunks(x, ti, back=1, force=force_chunks)
        x = CH.finish(y.withColumn("_ooo", F.col(ts) < F.lag(ts).over(t3.w())), ch2)
        aggs.append(F.count_if("_ooo").alias("n_out_of_order"))
    from vigil.operators.quantiles import exact_quantiles
    med = exact_quantiles(x, ["_dt"], [0.5], group=tl.run_cols).select(
        *tl.run_cols, F.col("value").alias("median_dt"))
    return x.groupBy(*tl.run_cols).agg(*aggs).join(med, tl.run_cols, "left")


def label_durations(df: DataFrame, label: str, ts: str) -> DataFrame:
    """Rows and span (max ts - min ts, over repeats) per label."""
    from vigil.functions.columns import micros
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                                 F.max(ts).alias("last_ts"),
                                 ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("duration_s"))


def std_ratio(df: DataFrame, label: str, sensors: list[str], normal=0) -> DataFrame:
    """Attack std / normal std per label and sensor where normal std > 0
    (A16); one grouped pass, normal std by a window over the per-label rows."""
    per = df.groupBy(label).agg(*[F.stddev_samp(s).alias(f"s_{s}") for s in sensors])
    g = Window.partitionBy()
    per = per.select("*", *[F.max(F.when(F.col(label) == normal, F.col(f"s_{s}"))).over(g).alias(f"n_{s}")
                            for s in sensors])
    att = per.filter(F.col(label) != normal)
    u = _unpivot_row(att, [label], {s: {"normal_std": F.col(f"n_{s}"), "label_std": F.col(f"s_{s}")}
                                    for s in sensors}, "sensor")
    return u.filter(F.col("normal_std") > 0).withColumn("ratio", F.col("label_std") / F.col("normal_std"))


def run_summary(df: DataFrame, tl, ts: str, label: str) -> DataFrame:
    """Per run: rows, minutes covered, mean poll interval, labels present."""
    from vigil.functions.columns import micros
    span = (F.max(micros(ts)) - F.min(micros(ts))) / 1e6
    return df.groupBy(*tl.run_cols).agg(
        F.count(F.lit(1)).alias("n_rows"), (span / 60.0).alias("minutes"),
        F.try_divide(span, F.count(F.lit(1)) - 1).alias("mean_interval_s"),
        F.array_join(F.array_sort(F.collect_set(F.col(label))), ",").alias("labels_present"))


def expected_rows(df: DataFrame, run: str, expected: float | None = None,
                  warn_below: float = 0.95) -> DataFrame:
    """Row count per run against an expected count (default: the mean count
    per run); WARN under 95 % (A28).  The window runs over the per-run
    aggregate (one row per run), not over the rows."""
    g = df.groupBy(run).agg(F.count(F.lit(1)).alias("n_rows"))
    exp = F.lit(float(expected)) if expected is not None else F.avg("n_rows").over(Window.partitionBy())
    g = g.withColumn("expected", exp)
    return g.withColumn("ratio", F.round(F.col("n_rows") / F.col("expected"), 6)).withColumn(
        "warn", F.col("n_rows") < warn_below * F.col("expected"))


def step_size_check(df: DataFrame, tl, sensor: str, first_steps: int = 10, warn_above: float = 50.0,
                    force_chunks: bool | None = None) -> DataFrame:
    """Mean absolute step over the first ``first_steps`` steps of each run."""
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(df, tl, back=1, force=force_chunks)
    pos = F.col("_seq") if ch else F.row_number().over(t2.w()) - 1
    x = x.withColumn("_pos", pos).withColumn("_step", F.abs(F.col(sensor) - F.lag(sensor).over(t2.w())))
    x = CH.finish(x, ch)
    g = x.filter(F.col("_pos") <= first_steps).groupBy(*tl.run_cols).agg(
        F.count("_step").alias("n_steps"), F.avg("_step").alias("mean_abs_step"))
    return g.withColumn("warn", F.col("mean_abs_step") > warn_above)


def normal_range_sanity(df: DataFrame, label: str, ranges: dict[str, tuple[float, float]], normal=0) -> DataFrame:
    """Min / max of normal rows against the expected normal range."""
    nd = df.filter(F.col(label) == normal)
    g = nd.agg(*[f for c in ranges for f in (F.min(c).cast("double").alias(f"mn_{c}"),
                                              F.max(c).cast("double").alias(f"mx_{c}"))])
    u = _unpivot_row(g, [], {c: {"min": F.col(f"mn_{c}"), "max": F.col(f"mx_{c}"),
                                 "lo": F.lit(float(lo)), "hi": F.lit(float(hi))}
                             for c, (lo, hi) in ranges.items()}, "sensor")
    return u.withColumn("ok", (F.col("min") >= F.col("lo")) & (F.col("max") <= F.col("hi")))


def success_rate(df: DataFrame, run: str, ok: Column, ts: str) -> DataFrame:
    """Successful / total polls and polls per second per run."""
    from vigil.functions.columns import micros
    span = (F.max(micros(ts)) - F.min(micros(ts))) / 1e6
    g = df.groupBy(run).agg(F.count(F.lit(1)).alias("n_polls"), F.count_if(ok).alias("n_ok"),
                            span.alias("span_s"))
    return (g.withColumn("success_rate", F.round(F.col("n_ok") / F.col("n_polls"), 6))
             .withColumn("polls_per_s", F.try_divide(F.col("n_polls").cast("double"), F.col("span_s"))))


# Controller alarm thresholds (raw units) as default parameters.
PLANT_ALARMS = {
    "chemical_low_below": 15.0, "high_level_above": 950.0, "high_pressure_above": 200.0,
    "ph_high_above": 900.0, "ph_low_below": 550.0, "uf_dp_above": 55.0,
    "uf_backwash_age_above": 500.0, "ro_fouling_above": 80.0, "ro_cleaning_age_above": 1000.0,
}


def plant_alarm_rules(p: dict | None = None) -> dict[str, Column]:
    """Controller alarm logic as boolean columns over the sensor-run schema."""
    p = {**PLANT_ALARMS, **(p or {})}
    c = F.col
    chem = (c("Acid_Tank_Level") < p["chemical_low_below"]) | (c("Chlorine_Tank_Level") < p["chemical_low_below"]) \
        | (c("Coagulant_Tank_Level") < p["chemical_low_below"])
    level = (c("LIT_101") > p["high_level_above"]) | (c("LIT_301") > p["high_level_above"]) \
        | (c("LIT_401") > p["high_level_above"])
    press = c("PIT_501") > p["high_pressure_above"]
    return {
        "Chemical_Low": chem, "High_Level": level, "High_Pressure": press,
        "System_Run": ~(press | level),
        "pH_Interlock": (c("AIT_202") > p["ph_high_above"]) | (c("AIT_202") < p["ph_low_below"]),
        "UF_Fouling": (c("DPIT_301") > p["uf_dp_above"]) | (c("UF_Last_Backwash") > p["uf_backwash_age_above"]),
        "RO_Fouling": (c("RO_Fouling_Factor") > p["ro_fouling_above"])
        | (c("RO_Last_Cleaning") > p["ro_cleaning_age_above"]),
    }


def rule_flags(df: DataFrame, rules: dict[str, Column], recorded: dict[str, str] | None = None) -> DataFrame:
    """Add one boolean per rule and, where a recorded flag column exists,
    ``<rule>_mismatch`` = derived != recorded (P17)."""
    out = df.select("*", *[e.alias(f"rule_{n}") for n, e in rules.items()])
    for n, rec in (recorded or {}).items():
        out = out.withColumn(f"{n}_mismatch", F.col(f"rule_{n}") != F.col(rec).cast("boolean"))
    return out

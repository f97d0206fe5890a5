"""Label timeline: elapsed time, transitions, segments, leakage removal,
as-of and interval labelling, episode tables and before/after deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import micros
from vigil.operators.timeline import Timeline


def add_elapsed(df: DataFrame, tl: Timeline, ts: str, out: str = "elapsed_seconds") -> DataFrame:
    """Seconds since the first timestamp of the run, rounded half-up to ms.

    The run start is a grouped min joined back (map-side partial aggregation;
    AQE broadcasts the per-run table when it is small and splits skewed runs)
    rather than an unordered window that would put a whole run in one task.
    """
    us = micros(ts)
    starts = df.groupBy(*tl.run_cols).agg(F.min(us).alias("_us0"))
    ms = F.floor((micros(ts) - F.col("_us0") + 500) / 1000)  # exact: |values| < 2^53
    return (df.join(starts, tl.run_cols, "left")
              .withColumn(out, ms / 1000.0)
              .drop("_us0"))


def changed(label: str, tl: Timeline) -> Column:
    """True where the label differs from the previous row of the run; the first
    row and rows next to a null label are not transitions (W10)."""
    prev = F.lag(label).over(tl.w())
    return prev.isNotNull() & F.col(label).isNotNull() & (F.col(label) != prev)


def transitions(df: DataFrame, tl: Timeline, force_chunks: bool | None = None) -> DataFrame:
    """Rows where the label changes, with the previous label.
    Looks one row back, so long runs are cut into chunks with a 1-row halo."""
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(df, tl, back=1, force=force_chunks)
    out = (x.withColumn("prev_label", F.lag(tl.label).over(t2.w()))
             .filter(F.col("prev_label").isNotNull() & F.col(tl.label).isNotNull()
                     & (F.col(tl.label) != F.col("prev_label"))))
    return CH.finish(out, ch)


def add_segment_id(df: DataFrame, tl: Timeline, out: str = "segment",
                   force_chunks: bool | None = None) -> DataFrame:
    """Gaps-and-islands id: running count of label changes (W9).  On long
    runs: 1-row halo for the change flag, chunk-level totals for the count."""
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(df, tl, back=1, force=force_chunks)
    x = x.withColumn("_chg", changed(tl.label, t2).cast("int"))
    if ch:
        x = CH.carry_running_sum(x, t2, "_chg", out)
    else:
        x = x.withColumn(out, F.sum("_chg").over(tl.prefix()))
    return CH.finish(x.drop("_chg"), ch)


def episodes(df: DataFrame, tl: Timeline, ts: str) -> DataFrame:
    """One row per contiguous label segment: start, end, rows, duration."""
    seg = add_segment_id(df, tl)
    return (seg.groupBy(*tl.run_cols, "segment")
               .agg(F.min(tl.label).alias(tl.label),
                    F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
                    F.count(F.lit(1)).alias("n_rows"),
                    ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("duration_s")))


def episode_totals(ep: DataFrame, tl: Timeline, normal=0) -> DataFrame:
    """Count and total duration of non-normal episodes per label."""
    return (ep.filter(F.col(tl.label) != normal).groupBy(tl.label)
              .agg(F.count(F.lit(1)).alias("episodes"),
                   F.sum("duration_s").alias("total_duration_s"),
                   F.sum("n_rows").alias("total_rows")))


def remove_boundary_leakage(df: DataFrame, tl: Timeline, window_s: float,
                            force_chunks: bool | None = None) -> DataFrame:
    """Drop rows within ``window_s`` (inclusive) of any label transition of the
    same run (J3).

    Only the nearest transition on each side can be the closest one, so a
    running ``last``/``first`` of the transition time replaces the
    rows x transitions range anti-join; one sort per run serves all three
    window expressions.
    """
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(df, tl, back=1, force=force_chunks)
    t = F.col(tl.t)
    out = x.withColumn("_tt", F.when(changed(tl.label, t2), t))
    if ch:
        out = CH.carry_nearest(out, t2, [("_tt", "prev", "_prev_t"), ("_tt", "next", "_next_t")])
    else:
        out = out.withColumn("_prev_t", tl.prev_non_null("_tt")).withColumn("_next_t", tl.next_non_null("_tt"))
    near = ((t - F.col("_prev_t")) <= window_s) | ((F.col("_next_t") - t) <= window_s)
    out = out.filter(~F.coalesce(near, F.lit(False))).drop("_tt", "_prev_t", "_next_t")
    return CH.finish(out, ch)


def asof_join(left: DataFrame, right: DataFrame, tl: Timeline, right_cols: list[str],
              prefix: str = "asof_", force_chunks: bool | None = None) -> DataFrame:
    """Each left row takes the latest right row of the same run whose time is
    at or before its own (J4).

    Both sides are unioned and sorted once per run; the carried value is a
    struct, so a right row whose payload is null still counts as the latest.
    Of right rows at the same time the one with the largest payload (column by
    column) is the latest.
    """
    runs, order = tl.run_cols, list(tl.order)
    lcols = [c for c in left.columns]
    payload = F.struct(*[F.col(c).alias(c) for c in right_cols])
    r = right.select(*runs, *[F.col(o) for o in order[:1]],
                     F.lit(0).alias("_side"), payload.alias("_p"))
    l = left.withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(r.schema["_p"].dataType))
    u = l.unionByName(r, allowMissingColumns=True)
    # right rows sort before left rows at equal time ("at or before")
    w_order = [order[0], "_side", "_p"] + order[1:]
    tlu = tl.with_(order=tuple(w_order))
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(u, tlu, back=0, force=force_chunks)
    if ch:
        x = CH.carry_nearest(x, t2, [("_p", "prev", "_c")])
    else:
        x = x.withColumn("_c", F.last("_p", ignorenulls=True).over(tlu.prefix()))
    u = CH.finish(x, ch).filter(F.col("_side") == 1)
    return u.select(*lcols, *[F.col("_c")[c].alias(prefix + c) for c in right_cols])


def interval_label(readings: DataFrame, intervals: DataFrame, tl: Timeline,
                   start: str, end: str, id_col: str) -> DataFrame:
    """Label each reading with the interval of its run that covers it,
    [start, end) (J5); of several the one that starts last, then the largest id.

    Overlapping intervals form islands; inside an island every start and end is
    a boundary, and the interval in force from each boundary on is found among
    the island's own intervals.  An as-of carry of the boundaries then labels
    the readings without pairing them with intervals."""
    runs, t = tl.run_cols, tl.order[0]
    iv = (intervals.select(*runs, F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(id_col).alias("_iid"))
          .filter(F.col("_start") < F.col("_end")))
    w = Window.partitionBy(*runs).orderBy("_start", "_end", "_iid")
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    iv = iv.withColumn("_new", F.coalesce((reach <= F.col("_start")).cast("int"), F.lit(1)))
    iv = iv.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    from vigil.operators.chunking import join_on
    at = iv.select(*runs, "_isle", F.explode(F.array_distinct(F.array("_start", "_end"))).alias("_at")).distinct()
    cov = (join_on(at, iv, [*runs, "_isle"])
           .groupBy(*runs, "_isle", "_at").agg(F.max(F.when(
               (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end")),
               F.struct("_start", "_iid")))["_iid"].alias("_iid")))
    # at a time where one island ends and the next begins, the later one counts
    cov = cov.groupBy(*runs, F.col("_at").alias(t)).agg(F.max_by("_iid", "_isle").alias("_iid"))
    j = asof_join(readings, cov, tl, ["_iid"], prefix="")
    return j.withColumn("interval_id", F.col("_iid")).drop("_iid")


def episode_state_delta(df: DataFrame, tl: Timeline, sensors: list[str], normal=0,
                        force_chunks: bool | None = None) -> DataFrame:
    """For each non-normal episode: last sensor values before it and first
    values after it, one row per sensor whose value changed (A19).  Looks one
    row back and one forward (chunk halo of 1 each way on long runs)."""
    from vigil.operators import chunking as CH
    seg0 = add_segment_id(df, tl, force_chunks=force_chunks)
    seg, t2, ch = CH.plan_chunks(seg0, tl, back=1, fwd=1, force=force_chunks)
    w = t2.w()
    first_in = F.lag("segment").over(w).isNull() | (F.lag("segment").over(w) != F.col("segment"))
    last_in = F.lead("segment").over(w).isNull() | (F.lead("segment").over(w) != F.col("segment"))
    cols = []
    for s in sensors:
        cols.append(F.when(first_in, F.lag(s).over(w)).alias(f"_b_{s}"))
        cols.append(F.when(last_in, F.lead(s).over(w)).alias(f"_a_{s}"))
    seg = CH.finish(seg.select(*tl.run_cols, "segment", tl.label, *CH.ctx(seg), *cols), ch)
    aggs = []
    for s in sensors:
        aggs.append(F.max(f"_b_{s}").alias(f"_b_{s}"))
        aggs.append(F.max(f"_a_{s}").alias(f"_a_{s}"))
    ep = (seg.filter(F.col(tl.label) != normal)
             .groupBy(*tl.run_cols, "segment").agg(F.min(tl.label).alias(tl.label), *aggs))
    stack = F.explode(F.array(*[
        F.struct(F.lit(s).alias("sensor"), F.col(f"_b_{s}").cast("double").alias("before"),
                 F.col(f"_a_{s}").cast("double").alias("after")) for s in sensors]))
    out = ep.select(*tl.run_cols, "segment", tl.label, stack.alias("_s")).select(
        *tl.run_cols, "segment", tl.label, "_s.sensor", "_s.before", "_s.after")
    return (out.filter(F.col("before").isNotNull() & F.col("after").isNotNull()
                       & (F.col("before") != F.col("after")))
               .withColumn("delta", F.col("after") - F.col("before")))


def union_runs(dfs: list[DataFrame]) -> DataFrame:
    """UNION ALL by name over runs with drifting schemas; columns missing in a
    run become null, column order = first-seen union (O3 / P6)."""
    order: list[str] = []
    for d in dfs:
        order += [c for c in d.columns if c not in order]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.select(*order)


def schema_diff(columns_by_run: dict, reference=None) -> list[tuple]:
    """Extra / missing columns of each run against the reference run.
    Works on column lists only (driver-side metadata, no data is read)."""
    runs = list(columns_by_run)
    ref = reference if reference is not None else runs[0]
    base = set(columns_by_run[ref])
    out = []
    for r in runs:
        cols = set(columns_by_run[r])
        out.append((r, sorted(cols - base), sorted(base - cols)))
    return out


def episode_index(df: DataFrame, tl: Timeline, normal=0, out: str = "sample_index",
                  force_chunks: bool | None = None) -> DataFrame:
    """0-based position of each row inside its (non-normal) episode.
    Runs that fit a chunk use a window per (run, segment); on long runs the
    index is the run position minus the episode's first position, so one
    long episode is never gathered into a single window task."""
    from vigil.operators import chunking as CH
    from vigil.operators.chunking import add_sequence
    spark = df.sparkSession
    rows = CH._conf(spark, CH.CHUNK_ROWS_CONF, CH.DEFAULT_CHUNK_ROWS)
    use = CH.needs_chunking(df, tl, rows) if force_chunks is None else force_chunks
    seg = add_segment_id(df, tl, force_chunks=use)
    if not use:
        w = Window.partitionBy(*tl.run_cols, "segment").orderBy(*tl.order)
        return seg.filter(F.col(tl.label) != normal).withColumn(out, F.row_number().over(w) - 1)
    seg = add_sequence(seg, tl)
    start = seg.groupBy(*tl.run_cols, "segment").agg(F.min("_seq").alias("_s0"))
    return (seg.join(start, tl.run_cols + ["segment"]).filter(F.col(tl.label) != normal)
               .withColumn(out, F.col("_seq") - F.col("_s0")).drop("_seq", "_s0"))


def align_predictions(preds: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction <-> ground truth by key equality (J6), not by position: a
    suppressed alert can never shift the pairing."""
    return truth.join(preds, keys, "left")

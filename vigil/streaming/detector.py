"""Online detection as Structured Streaming queries.

Readings of a live source come in any order, so no operator trusts the order of
its input: rows wait in the state of their key until the event-time watermark
passes them and are then processed in event time (:mod:`vigil.streaming.state`).
``late`` is how much later than a newer one a row may come; rows later than that
are dropped by the watermark, as Structured Streaming defines it, and counted.
A recorded table is replayed in slices of ascending time, so a late limit of
hours holds there too whatever the order of its rows.  A replay is closed by a
few rows of a far future time, which move the watermark past everything that
still waits; they never reach an operator.

Features follow the definitions of the batch families A and B (see tests) except
where batch looks into the future (family B: back fill of a leading null, and
roc50 of runs that end before row 51, which batch zeroes).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.dims import ALERT_LEVELS, CLASS_NAMES, map_lookup
from vigil.operators.features import FamilyA
from vigil.session import ensure_checkpoint_dir
from vigil.streaming.state import CLOSING, EVENT_TS, in_event_time

FILE_ROWS = 1_000_000                # rows of a replayed file, about

# --- sources (S8, S9) --------------------------------------------------------------------

def replay_source(spark: SparkSession, path: str, ts: str, closing: DataFrame | None = None, slices: int = 3) -> DataFrame:
    """Replay a recorded table as a stream in slices of ascending ``ts``.

    The slices hold about as many rows each and are written one after the other;
    the file source reads the oldest files first, one slice a batch, so no row
    comes later than a newer one of an earlier slice.  ``closing`` rows (same
    columns) come with the last slice.  Rows without a time come first.
    """
    tab = spark.read.parquet(path)
    at = tab.schema[ts].dataType
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    size = tab.count()
    files = max(1, -(-size // (slices * FILE_ROWS)))
    cuts = sorted(set(tab.select(us.alias("us")).approxQuantile("us", [i / slices for i in range(1, slices)], 0.01))) if size else []
    folder = stream_folder(spark, "replay")
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        moment = lambda c: F.timestamp_micros(F.lit(int(c))).cast(at)
        part = tab
        if lo is not None:
            part = part.where(F.col(ts) > moment(lo))
        if hi is not None:
            part = part.where((F.col(ts) <= moment(hi)) | (F.col(ts).isNull() if lo is None else F.lit(False)))
        if closing is not None and hi is None:
            part = part.unionByName(closing.select(*tab.columns))
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(tab.schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one query."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


# --- online family-B features (T1, T2, T5) -------------------------------------------------

def _trailing(x: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the last ``n`` values up to each place (nan
    with fewer than ``least`` values; the deviation needs two)."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
    there = ~np.isnan(view)
    count = there.sum(1)
    total = np.where(there, view, 0.0).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total / count
        square = (np.where(there, view - mean[:, None], 0.0) ** 2).sum(1)
        dev = np.sqrt(square / (count - 1))
    return np.where(count >= least, mean, np.nan), np.where((count >= least) & (count > 1), dev, np.nan)


def _filled(x: np.ndarray, value: float = 0.0) -> np.ndarray:
    return np.where(np.isnan(x), value, x)


def _sensor_features(name: str, x: np.ndarray, dt: np.ndarray, lagged: np.ndarray, windows, lag: int) -> dict:
    """Family B of one sensor: derivative, trailing statistics, z-score, rate of change."""
    out = {f"d_{name}_dt": _filled(np.diff(x, prepend=np.nan)) / dt}
    for w in windows:
        mean, dev = _trailing(x, w, 1)
        out[f"{name}_rmean{w}"], out[f"{name}_rstd{w}"] = mean, _filled(dev)
    mean, dev = _trailing(x, 50, 10)
    out[f"{name}_zscore50"] = _filled((x - mean) / np.where(dev < 0.001, 0.001, dev))
    out[f"{name}_roc{lag}"] = _filled((x - lagged) / lag)
    return out


def online_features(stream: DataFrame, run: str, order: list[str], t: str, sensors: list[str],
                    keep: list[str], warmup: int = 25, buffer_rows: int = 60, seq_len: int = 25,
                    late: str | None = "1 day", windows=(10, 25, 50), lag: int = 50) -> DataFrame:
    """Family-B features of every row once its run has ``warmup`` rows (T1, T2);
    ``seq_ready`` marks rows where the sequence model has ``seq_len`` vectors (T5)."""
    names = [n for s in sensors for n in _sensor_features(s, np.zeros(1), np.ones(1), np.zeros(1), windows, lag)]
    fields = {f.name: f for f in stream.schema.fields}
    out_schema = T.StructType([fields[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names]
                              + [T.StructField("row_index", T.LongType()), T.StructField("seq_ready", T.BooleanType())])

    def fold(memory, rows):
        past = memory or {"n": 0, "tail": [], "first": None}
        old, n = np.array(past["tail"], float).reshape(-1, 1 + len(sensors)), past["n"]
        new = np.stack([rows[c].astype(float) for c in (t, *sensors)], 1)
        first = past["first"] or [None if np.isnan(v) else v for v in new[0, 1:]]
        both, k = np.concatenate([old, new]), len(old)
        index = np.arange(n - k, n + len(new))
        dt = np.diff(both[:, 0], prepend=np.nan)
        dt = np.maximum(_filled(dt, 0.2), 0.01)
        out = {c: rows[c] for c in keep}
        for i, s in enumerate(sensors):
            x = both[:, 1 + i]
            start = np.nan if first[i] is None else first[i]
            lagged = np.where(index >= lag, np.concatenate([np.full(lag, np.nan), x])[:len(x)], start)
            for name, v in _sensor_features(s, x, dt, lagged, windows, lag).items():
                out[name] = v[k:]
        out["row_index"] = index[k:]
        out["seq_ready"] = out["row_index"] + 1 >= seq_len
        tail = [[None if np.isnan(v) else float(v) for v in r] for r in both[-buffer_rows:]]
        warm = out["row_index"] + 1 >= warmup
        return {c: v[warm] for c, v in out.items()}, {"n": int(n + len(new)), "tail": tail, "first": first}

    return in_event_time(stream, [run], order, late, [*keep, t, *sensors], fold, out_schema)


# --- online family-A features (T4) ----------------------------------------------------------

def _full(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Trailing mean, deviation, maximum and minimum where the last n values are all there."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
    with np.errstate(invalid="ignore"):
        return {"mean": view.mean(1), "std": view.std(1, ddof=1), "max": view.max(1), "min": view.min(1)}


def _prior_quantiles(x: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Quartiles of the n values before each place (nan with fewer than ``least`` values)."""
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n, np.nan), x[:-1]]), n)
    seen, count = np.sort(seen, axis=1), (~np.isnan(seen)).sum(1)          # nan sorts last
    row = np.arange(len(x))

    def quartile(p):
        at = p * (count - 1)
        low = np.clip(np.floor(at).astype(int), 0, n - 1)
        high = np.clip(low + 1, 0, np.maximum(count - 1, 0))
        q = seen[row, low] + (at - low) * (seen[row, high] - seen[row, low])
        return np.where(count >= max(least, 1), q, np.nan)
    return quartile(0.25), quartile(0.75)


def online_family_a(stream: DataFrame, run: str, order: list[str], spec: FamilyA, keep: list[str],
                    late: str | None = "1 day") -> DataFrame:
    """Family A of every row as it passes the watermark (T4), by the definitions
    of ``spec``.  A run's memory is the last ``spec.back`` values of each sensor and
    the count, mean and squared deviations of all its values, which merge with
    those of the rows that come, so it does not grow with the run."""
    fields = {f.name: f for f in stream.schema.fields}
    out_schema = T.StructType([fields[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in spec.names()])

    def fold(memory, rows):
        out, kept = {c: rows[c] for c in keep}, {}
        made: dict[str, np.ndarray] = {}
        x_of = {}
        for s in spec.sensors:
            past = (memory or {}).get(s, {"tail": [], "n": 0, "mean": 0.0, "dev": 0.0})
            tail = np.array(past["tail"], float)
            x = np.concatenate([tail, rows[s].astype(float)])
            new = slice(len(tail), len(x))
            step = np.diff(x, prepend=np.nan)
            made[f"{s}_rate"], made[f"{s}_accel"] = step[new], (step - np.concatenate([[np.nan], step[:-1]]))[new]
            for n in spec.windows:
                for k, v in _full(x, n).items():
                    made[f"{s}_{k}_{n}s"] = v[new]
            q25, q75 = _prior_quantiles(x, spec.prior, spec.least)
            low, high = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
            made[f"{s}_outlier_dist"] = np.maximum(np.maximum(low - x, x - high), 0.0)[new]
            # moments of all values before each row: those of the past and running sums about their mean
            v = x[new]
            there = ~np.isnan(v)
            d = np.where(there, v - past["mean"], 0.0)
            count, first, second = (np.concatenate([[0], np.cumsum(c)]) for c in (there, d, d * d))
            count = count + past["n"]
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = past["mean"] + np.where(count > 0, first / count, 0.0)
                dev = past["dev"] + second - np.where(count > 0, first * first / count, 0.0)
                std = np.sqrt(np.maximum(dev, 0.0) / (count - 1))
                z = (v - mean[:-1]) / (std[:-1] + spec.eps)
                made[f"{s}_zscore"] = np.where(count[:-1] >= max(spec.least, 2), z, np.nan)
                before = np.concatenate([[np.nan], x[:-1]])
                made[f"{s}_pct_change"] = np.where(before == 0, np.nan, x / before - 1)[new]
            made[f"{s}_spike"] = (np.nan_to_num(made[f"{s}_pct_change"]) > spec.spike).astype(float)
            x_of[s] = v
            kept[s] = {"tail": [None if np.isnan(t) else float(t) for t in x[-spec.back:]], "n": int(count[-1]),
                       "mean": float(mean[-1]), "dev": float(dev[-1])}
        if spec.balance:
            inflow, level = spec.balance
            made["mass_balance_violation"] = np.abs(x_of[inflow] * spec.factor - made[f"{level}_rate"])
        if spec.ratio:
            a, b = spec.ratio
            with np.errstate(invalid="ignore", divide="ignore"):
                made["ratio"] = np.where(x_of[b] == -1, np.nan, x_of[a] / (x_of[b] + 1))
        for n in spec.names():
            out[n] = made[n]
        return out, kept

    return in_event_time(stream, [run], order, late, [*keep, *spec.sensors], fold, out_schema)


# --- carry-forward of partial readings (T3) -----------------------------------------------

def carry_forward(stream: DataFrame, run: str, order: list[str], sensors: list[str], defaults: dict,
                  keep: list[str], late: str | None = "1 day") -> DataFrame:
    """Each reading is completed from the last known value of every sensor of
    its run, then from ``defaults`` (T3).  Batch twin: ``last(ignorenulls)``
    over the run prefix + ``coalesce(default)``."""
    fields = {f.name: f for f in stream.schema.fields}
    out_schema = T.StructType([fields[c] for c in keep] + [T.StructField(s, T.DoubleType()) for s in sensors])

    def fold(memory, rows):
        last, out = memory or {}, {c: rows[c] for c in keep}
        for s in sensors:
            x = np.concatenate([np.array([last.get(s)], float), rows[s].astype(float)])
            x = x[np.maximum.accumulate(np.where(np.isnan(x), 0, np.arange(len(x))))]
            last[s] = None if np.isnan(x[-1]) else float(x[-1])
            out[s] = np.where(np.isnan(x[1:]), defaults.get(s, np.nan), x[1:])
        return out, last

    return in_event_time(stream, [run], order, late, [*keep, *sensors], fold, out_schema)


# --- de-duplicated alerts (T6, T7, P14) ---------------------------------------------------

def dedup_alerts(stream: DataFrame, keys: list[str], order: list[str], t: str, cooldown: float,
                 keep: list[str], late: str | None = "1 day", suppressed: bool = False) -> DataFrame:
    """Greedy cooldown per (run, class) with the time of the last alert fired in
    state, event time (T6).  Emits fired alerts; with ``suppressed`` every row and
    a column ``fired``.  Times are compared in whole microseconds."""
    fields = {f.name: f for f in stream.schema.fields}
    out_schema = T.StructType([fields[c] for c in keep] + ([T.StructField("fired", T.BooleanType())] if suppressed else []))
    wait = round(cooldown * 1e6)

    def fold(memory, rows):
        us = np.rint(rows[t].astype(float) * 1e6).astype(np.int64)
        fired, i = [], 0 if memory is None else int(np.searchsorted(us, memory + wait))
        while i < len(us):
            fired.append(i)
            memory = int(us[i])
            i = max(i + 1, int(np.searchsorted(us, memory + wait)))
        if suppressed:
            return {c: rows[c] for c in keep} | {"fired": np.isin(np.arange(len(us)), fired)}, memory
        return {c: rows[c][np.array(fired, int)] for c in keep}, memory

    return in_event_time(stream, keys, order, late, [*keep, t], fold, out_schema)


def alert_record(alerts: DataFrame, class_id: str = "class_id") -> DataFrame:
    """The alert log's record (K5, T7): the fired row with the name and the
    alert level of its class."""
    return (alerts.withColumn("class_name", map_lookup(CLASS_NAMES, class_id, "Unknown"))
            .withColumn("alert_level", map_lookup(ALERT_LEVELS, class_id, "INFO")))


def alert_counts(alerts: DataFrame, ts: str, window: str = "1 hour", watermark: str = "2 hours",
                 by: list[str] = ()) -> DataFrame:
    """Tumbling-window alert counts with a watermark; rows later than the
    watermark are dropped (T9)."""
    return (alerts.withWatermark(ts, watermark).filter(F.col(ts) < F.lit(CLOSING).cast("timestamp"))
            .groupBy(F.window(ts, window).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n")))


def sliding_counts(stream: DataFrame, ts: str, window: str, slide: str, watermark: str, by: list[str] = ()) -> DataFrame:
    """Counts of overlapping windows (T9); append mode: a window comes once the watermark has passed it."""
    return (stream.withWatermark(ts, watermark).filter(F.col(ts) < F.lit(CLOSING).cast("timestamp"))
            .groupBy(F.window(ts, window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")))


def session_counts(stream: DataFrame, ts: str, gap: str, watermark: str, by: list[str], **aggs: Column) -> DataFrame:
    """Sessions of each key: rows less than ``gap`` apart are one session.
    State is one row per open session; sessions merge as late rows join them."""
    return (stream.withWatermark(ts, watermark).filter(F.col(ts) < F.lit(CLOSING).cast("timestamp"))
            .groupBy(F.session_window(ts, gap).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), *(a.alias(k) for k, a in aggs.items())))


def without_resends(stream: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """Rows whose key has not come within the watermark before (T9): a reading
    sent again is dropped, its key leaves the state once the watermark passes."""
    return (stream.withWatermark(ts, watermark).filter(F.col(ts) < F.lit(CLOSING).cast("timestamp"))
            .dropDuplicatesWithinWatermark(keys))


def with_truth(predictions: DataFrame, truth: DataFrame, keys: list[str], within: str, late: str) -> DataFrame:
    """Each prediction with the true class of its reading (J6): an outer join of
    two streams on the keys, where the truth comes at most ``within`` before or
    after the prediction.  A prediction whose truth has not come when the
    watermark passes its interval is given with a null truth.  Predictions have
    EVENT_TS, the truth has ``truth_ts``; both streams hold only what may still match."""
    p = predictions.withWatermark(EVENT_TS, late).filter(F.col(EVENT_TS) < F.lit(CLOSING).cast("timestamp")).alias("p")
    t = truth.withWatermark("truth_ts", late).filter(F.col("truth_ts") < F.lit(CLOSING).cast("timestamp")).alias("t")
    gap = F.expr(f"INTERVAL {within}")
    on = [F.col(f"p.{k}") == F.col(f"t.{k}") for k in keys]
    on += [F.col("t.truth_ts") >= F.col(f"p.{EVENT_TS}") - gap, F.col("t.truth_ts") <= F.col(f"p.{EVENT_TS}") + gap]
    return p.join(t, on, "left_outer").select("p.*", *(F.col(f"t.{c}") for c in truth.columns if c not in keys))


def observed(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Count rows as they pass this place of a stream: {name: condition}; the
    counts arrive with the progress of each batch (A31, :func:`run_to_table`)."""
    return df.observe(name, *(F.count(F.when(c, 1)).alias(k) for k, c in counts.items()))


def run_to_table(df: DataFrame, name: str, mode: str = "append", key: list[str] | None = None,
                 counters: dict | None = None, duration_s: float | None = None, until_idle: bool = False) -> DataFrame:
    """Run a streaming frame into a table in the shared checkpoint folder and
    return it as a batch frame (T7, T8): over everything there is
    (``availableNow``), for ``duration_s`` seconds of a source that goes on, or
    ``until_idle``: until a source without an end of its own brings nothing new.
    ``counters`` receives the detector's counters (A31).

    ``update`` mode upserts: every micro-batch is appended with its batch id
    and the latest row per ``key`` wins when read back.
    """
    spark = df.sparkSession
    base = stream_folder(spark, name)
    out, ck = os.path.join(base, "table"), os.path.join(base, "checkpoint")

    def upsert(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    w = df.writeStream.option("checkpointLocation", ck).outputMode(mode)
    w = w.trigger(processingTime="0 seconds") if duration_s is not None or until_idle else w.trigger(availableNow=True)
    q = w.format("parquet").start(out) if mode == "append" else w.foreachBatch(upsert).start()
    if until_idle:
        q.processAllAvailable()
        q.stop()
    elif duration_s is None:
        q.awaitTermination()                      # raises what the query raised
    elif not q.awaitTermination(duration_s):
        q.stop()                                  # the table holds whole batches only
    if counters is not None:
        for k, v in progress_counters(q).items():
            counters[k] = counters.get(k, 0) + v
    res = spark.read.schema(df.schema if mode == "append" else df.schema.add("_batch", "long")).parquet(out)
    if mode != "append" and key:
        from pyspark.sql import Window
        w = Window.partitionBy(*key).orderBy(F.col("_batch").desc())
        res = res.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch")
    return res


def progress_counters(query) -> dict:
    """Detector counters from the progress of the batches (A31): batches, rows
    read, rows dropped as too late, and everything :func:`observed`.  Spark keeps
    the last ``spark.sql.streaming.numRecentProgressUpdates`` reports."""
    out = {"batches": 0, "input_rows": 0, "late_rows": 0}
    for p in query.recentProgress or []:
        out["batches"] += 1
        out["input_rows"] += p["numInputRows"]
        out["late_rows"] += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
        for counts in p["observedMetrics"].values():
            for k, v in (counts.asDict() if hasattr(counts, "asDict") else counts).items():
                out[k] = out.get(k, 0) + v
    return out

"""Time-series features per run, as Column builders.

Each builder returns ``{feature_name: Column}``; :func:`build` puts all of them
into a single ``select`` so that every window expression with the same
``partitionBy/orderBy`` lands in one Window operator (one exchange, one sort)
instead of a deep ``withColumn`` chain.

Family A: rate/accel, rolling n-row stats (pandas ``rolling(n)`` semantics:
null until n non-null values), expanding prior z-score, prior rolling IQR
distance, pct change, physics and correlation features, ffill->0.
Family B: derivative over dt, min_periods=1 rolling mean/std, zscore50, roc50,
per-run ffill->bfill->0, tank depletion against the run baseline.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import is_finite, row_mean
from vigil.operators.timeline import Timeline, last_n

Feats = dict[str, Column]


def build(df: DataFrame, keep: list[str], *feature_sets: Feats) -> DataFrame:
    cols = [F.col(c) for c in keep]
    for fs in feature_sets:
        cols += [e.alias(n) for n, e in fs.items()]
    return df.select(*cols)


# --- family A ---------------------------------------------------------------

def rate_accel(x: str, tl: Timeline) -> Feats:
    """First and second difference within the run."""
    w = tl.w()
    l1, l2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
    return {f"{x}_rate": F.col(x) - l1, f"{x}_accel": (F.col(x) - l1) - (l1 - l2)}


def rolling_full(x: str, tl: Timeline, n: int, stats=("mean", "std", "max", "min"),
                 suffix: str = "s") -> Feats:
    """n-row rolling stats, null until the frame holds n non-null values."""
    fr = last_n(tl, n)
    full = F.count(x).over(fr) == n
    fn = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    return {f"{x}_{s}_{n}{suffix}": F.when(full, fn[s](x).over(fr)) for s in stats}


def expanding_prior_z(x: str, tl: Timeline, min_periods: int = 5, eps: float = 1e-6) -> Feats:
    """(x - mean) / (std + eps) over all earlier rows of the run."""
    fr = tl.prefix(inclusive=False)
    ok = F.count(x).over(fr) >= min_periods
    z = (F.col(x) - F.avg(x).over(fr)) / (F.stddev_samp(x).over(fr) + eps)
    return {f"{x}_zscore": F.when(ok, z)}


def prior_iqr_distance(x: str, tl: Timeline, n: int = 30, min_periods: int = 5) -> Feats:
    """Distance outside the Tukey fences of the previous ``n`` rows."""
    # the frame as one sorted array: quartiles are lookups in it
    seen = F.array_sort(F.collect_list(F.col(x).cast("double")).over(tl.rows(-n, -1)))

    def quartile(a: Column, p: float) -> Column:
        at = p * (F.size(a) - 1)
        low = F.floor(at).cast("int")
        left, right = F.get(a, low), F.get(a, F.least(low + 1, F.size(a) - 1))
        return left + (at - low) * (right - left)

    def beyond(a: Column) -> Column:
        q25, q75 = quartile(a, 0.25), quartile(a, 0.75)
        lo, hi = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
        return F.when((F.size(a) >= min_periods) & F.col(x).isNotNull(),
                      F.greatest(F.lit(0.0), lo - F.col(x), F.col(x) - hi))

    return {f"{x}_outlier_dist": F.element_at(F.transform(F.array(seen), beyond), 1)}


def pct_change(x: str, tl: Timeline, spike: float = 0.05, name: str | None = None) -> Feats:
    """x / prev - 1 (null where prev is 0) and a spike flag."""
    name = name or x
    prev = F.lag(x).over(tl.w())
    pc = F.try_divide(F.col(x), prev) - 1
    return {f"{name}_pct_change": pc, f"{name}_spike": F.coalesce((pc > spike).cast("int"), F.lit(0))}


def mass_balance(inflow: str, level: str, tl: Timeline, factor: float = 100 / 3600,
                 name: str = "mass_balance_violation") -> Feats:
    """|inflow * factor - d level| (F1)."""
    d = F.col(level) - F.lag(level).over(tl.w())
    return {name: F.abs(F.col(inflow) * factor - d)}


def rising_while_off(x: str, switch: str, tl: Timeline, name: str = "ph_pump_anomaly") -> Feats:
    """1 where x rose and the switch is off (null switch = off) (F2)."""
    rising = F.coalesce(F.col(x) - F.lag(x).over(tl.w()) > 0, F.lit(False))
    off = F.coalesce(F.col(switch).cast("int"), F.lit(0)) == 0
    return {name: (rising & off).cast("int")}


def ratio_plus_one(a: str, b: str, name: str) -> Feats:
    """a / (b + 1) (F3, F6); null where b = -1."""
    return {name: F.try_divide(F.col(a), F.col(b) + 1)}


def stage_average(cols: list[str], name: str = "stage1_avg") -> Feats:
    """Row mean of the non-null values."""
    return {name: row_mean(cols)}


PUMP_RE = re.compile(r"^P_\d+$")


def pumps_on(df: DataFrame, name: str = "total_pumps_on", pattern=PUMP_RE) -> Feats:
    """Sum of the ``P_<digits>`` columns, null as 0."""
    cols = [c for c in df.columns if pattern.match(c)]
    return {name: sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols), F.lit(0))}


@dataclass(frozen=True)
class FamilyA:
    """Which family-A columns to build; the batch plan (:func:`family_a`) and the
    online operator take the same one."""
    sensors: tuple[str, ...]
    windows: tuple[int, ...] = (5, 10, 30)
    prior: int = 30                     # rows of the prior quartiles
    least: int = 5                      # values before the prior statistics count
    spike: float = 0.05
    eps: float = 1e-6
    balance: tuple[str, str] | None = None          # (inflow, level)
    factor: float = 100 / 3600
    ratio: tuple[str, str] | None = None            # a / (b + 1)

    @property
    def back(self) -> int:
        return max(*self.windows, self.prior, 2)

    def names(self) -> list[str]:
        out = []
        for s in self.sensors:
            out += [f"{s}_rate", f"{s}_accel", *(f"{s}_{k}_{n}s" for n in self.windows for k in ("mean", "std", "max", "min")),
                    f"{s}_zscore", f"{s}_outlier_dist", f"{s}_pct_change", f"{s}_spike"]
        return out + ["mass_balance_violation"] * bool(self.balance) + ["ratio"] * bool(self.ratio)


def family_a(df: DataFrame, tl: Timeline, spec: FamilyA, keep: list[str]) -> DataFrame:
    """All columns of ``spec`` (W1-W5, F1, F3): bounded frames over chunks of long
    runs, the prior z-score with moments carried across them."""
    from vigil.operators import chunking as CH
    seen = add_expanding_prior_z(df, tl, list(spec.sensors), spec.least, spec.eps)

    def bounded(d, t):
        feats: list[Feats] = []
        for s in spec.sensors:
            feats += [rate_accel(s, t), *(rolling_full(s, t, n) for n in spec.windows),
                      prior_iqr_distance(s, t, spec.prior, spec.least),
                      {n: c.cast("double") for n, c in pct_change(s, t, spec.spike).items()}]
        if spec.balance:
            feats.append(mass_balance(*spec.balance, t, spec.factor))
        if spec.ratio:
            feats.append(ratio_plus_one(*spec.ratio, "ratio"))
        zs = [f"{s}_zscore" for s in spec.sensors]
        return build(d, list(dict.fromkeys([*keep, *zs, *CH.ctx(d)])), *feats)

    return CH.chunked(seen, tl, bounded, back=spec.back).select(*keep, *spec.names())


def ffill_zero(x, tl: Timeline) -> Column:
    """Forward fill within the run, then 0 (family A fill, W11)."""
    return F.coalesce(tl.prev_non_null(x), F.lit(0.0))


def ffill_bfill_zero(x, tl: Timeline) -> Column:
    """Forward fill, then back fill, then 0, within the run (family B, W11)."""
    return F.coalesce(tl.prev_non_null(x), tl.next_non_null(x), F.lit(0.0))


# --- family B ---------------------------------------------------------------

def derivative_dt(x: str, tl: Timeline, default_dt: float = 0.2, min_dt: float = 0.01) -> Feats:
    """diff(x).fillna(0) / clip(diff(t).fillna(default), min_dt)."""
    w = tl.w()
    dt = F.greatest(F.coalesce(F.col(tl.t) - F.lag(tl.t).over(w), F.lit(default_dt)), F.lit(min_dt))
    dx = F.coalesce(F.col(x).cast("double") - F.lag(x).over(w), F.lit(0.0))
    return {f"d_{x}_dt": dx / dt}


def rolling_partial(x: str, tl: Timeline, n: int) -> Feats:
    """n-row rolling mean and std with min_periods=1; single-value std = 0."""
    fr = last_n(tl, n)
    return {f"{x}_rmean{n}": F.avg(x).over(fr),
            f"{x}_rstd{n}": F.coalesce(F.stddev_samp(x).over(fr), F.lit(0.0))}


def zscore_n(x: str, tl: Timeline, n: int = 50, min_periods: int = 10, floor: float = 0.001) -> Feats:
    """(x - mean) / max(std, floor) over the last n rows incl. current,
    at least ``min_periods`` values, else 0 (W8a)."""
    fr = last_n(tl, n)
    z = (F.col(x) - F.avg(x).over(fr)) / F.greatest(F.stddev_samp(x).over(fr), F.lit(floor))
    ok = F.count(x).over(fr) >= min_periods
    return {f"{x}_zscore{n}": F.coalesce(F.when(ok, z), F.lit(0.0))}


def roc_n(x: str, tl: Timeline, n: int = 50, shifted: str | None = None) -> Feats:
    """(x - x[i-n]) / n with the shifted series back-filled within the run
    (W8b).  ``shifted`` names a column already holding ``lag(x, n)`` (window
    functions do not nest); runs with no row n+1 give null, which the
    family-B sweep turns into 0."""
    if shifted is None:
        raise ValueError("roc_n needs the lag(x, n) column: use add_shifted first")
    return {f"{x}_roc{n}": (F.col(x) - tl.next_non_null(shifted)) / n}


def add_shifted(df: DataFrame, tl: Timeline, sensors: list[str], n: int = 50) -> DataFrame:
    return df.select("*", *[F.lag(s, n).over(tl.w()).alias(f"_sh{n}_{s}") for s in sensors])


def family_b(df: DataFrame, tl: Timeline, sensors: list[str], windows=(10, 25, 50),
             keep: list[str] | None = None, roc: int = 50, chunk_rows: int | None = None,
             force_chunks: bool | None = None) -> DataFrame:
    """All family-B features, then the per-run ffill->bfill->0 sweep.

    The windows look back at most max(windows, roc) rows; when a run is longer
    than a chunk (checked) the run is cut into halo'd chunks and the sweep
    carries values across chunks (see :mod:`vigil.operators.chunking`).
    """
    from vigil.operators import chunking as CH
    keep = keep or df.columns
    back = max(max(windows), roc)
    spark = df.sparkSession
    chunk_rows = max(chunk_rows or CH._conf(spark, CH.CHUNK_ROWS_CONF, CH.DEFAULT_CHUNK_ROWS), 2 * back)
    use = CH.needs_chunking(df, tl, chunk_rows) if force_chunks is None else force_chunks
    if use:
        seqd = CH.add_sequence(df, tl, CH._conf(spark, CH.BUCKET_S_CONF, CH.DEFAULT_BUCKET_S))
        df, tl = CH.with_halo(seqd, tl, chunk_rows, back, 0)
    df = add_shifted(df, tl, sensors, roc)
    feats: Feats = {}
    raw_feats: Feats = {}
    for s in sensors:
        feats.update(derivative_dt(s, tl))
        for n in windows:
            feats.update(rolling_partial(s, tl, n))
        feats.update(zscore_n(s, tl))
        raw_feats[f"{s}_roc{roc}"] = F.col(s)
    ctx = list(dict.fromkeys(keep + tl.run_cols + list(tl.order) + list(sensors)
                             + [f"_sh{roc}_{s}" for s in sensors]
                             + (["_halo"] if use else [])))
    raw = build(df, ctx, feats)
    names = list(feats) + [f"{s}_roc{roc}" for s in sensors]
    if use:
        # back fill of the shifted series across chunks, then roc and the sweep
        raw = CH.fill_across_chunks(raw, tl, [f"_sh{roc}_{s}" for s in sensors], forward=False,
                                    backward=True, default=None)
        raw = raw.select("*", *[((F.col(s) - F.col(f"_sh{roc}_{s}")) / roc).alias(f"{s}_roc{roc}")
                                for s in sensors])
        swept = CH.fill_across_chunks(raw, tl, names)
        return swept.filter(~F.col("_halo")).select(*keep, *names)
    raw = raw.select("*", *[e.alias(n) for s in sensors for n, e in
                            roc_n(s, tl, roc, shifted=f"_sh{roc}_{s}").items()])
    return raw.select(*keep, *[ffill_bfill_zero(n, tl).alias(n) for n in names])


def baseline_first_normal(df: DataFrame, tl: Timeline, x: str, normal=0) -> DataFrame:
    """Per run: first non-null ``x`` among normal rows (J2) as a small table."""
    key = F.struct(*[F.col(o) for o in tl.order])
    cand = F.when((F.col(tl.label) == normal) & F.col(x).isNotNull(), key)
    return df.groupBy(*tl.run_cols).agg(
        F.min_by(F.col(x), cand).alias(f"{x}_baseline"))


def depletion_pct(df: DataFrame, tl: Timeline, x: str, normal=0) -> DataFrame:
    """(s - x) / max(s, 1) clipped to 0..1, s = run baseline."""
    base = baseline_first_normal(df, tl, x, normal)
    s = F.col(f"{x}_baseline")
    pct = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - F.col(x)) / F.greatest(s, F.lit(1.0))))
    return df.join(base, tl.run_cols, "left").withColumn(f"{x}_pct", pct)


# --- generic statistics ------------------------------------------------------

def rolling_z_anomalies(df: DataFrame, x: str, tl: Timeline, window: int = 100,
                        threshold: float = 3.0) -> DataFrame:
    """Rows whose |z| over the full last-``window`` frame exceeds ``threshold``
    (W13).  Frames with fewer than ``window`` rows and zero std never flag."""
    fr = last_n(tl, window)
    z = (F.col(x) - F.avg(x).over(fr)) / F.stddev_samp(x).over(fr)
    full = F.count(x).over(fr) == window
    return df.withColumn("z", F.when(full & (F.stddev_samp(x).over(fr) > 0), z)).filter(
        F.abs(F.col("z")) > threshold)


def rolling_corr(a: str, b: str, tl: Timeline, n: int, name: str | None = None) -> Feats:
    """Pearson correlation of two sensors over the last n rows."""
    fr = last_n(tl, n)
    full = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(fr) == n
    # covariance over the product of standard deviations; ``corr`` itself
    # raises under ANSI mode when a frame holds a constant series
    r = F.try_divide(F.covar_samp(a, b).over(fr), F.stddev_samp(a).over(fr) * F.stddev_samp(b).over(fr))
    return {name or f"corr_{a}_{b}_{n}": F.when(full, r)}


def duty_cycle(switch: str, tl: Timeline, n: int, name: str | None = None) -> Feats:
    """Share of the last n rows with the switch on."""
    fr = last_n(tl, n)
    return {name or f"{switch}_duty_{n}": F.avg(F.col(switch).cast("int").cast("double")).over(fr)}


def linear_ramp(x: str, tl: Timeline, n: int = 10, tol: float = 0.01, name: str | None = None) -> Feats:
    """True where each of the last n steps is within ``tol`` of their mean
    step (a constant-rate ramp, W18)."""
    w = tl.w()
    step = F.col(x) - F.lag(x).over(w)
    # the steps of the last n rows: step[i-k] = x[i-k] - x[i-k-1]
    steps = [F.lag(x, k).over(w) - F.lag(x, k + 1).over(w) for k in range(n)]
    mean = sum(steps, F.lit(0.0)) / n
    dev = F.greatest(*[F.abs(s - mean) for s in steps])
    del step
    return {name or f"{x}_ramp{n}": dev <= tol}


def first_order_balance(level: str, inflow: str, outflow: str, tl: Timeline,
                        name: str | None = None) -> Feats:
    """d level - (inflow - outflow): tank mass balance residual."""
    d = F.col(level) - F.lag(level).over(tl.w())
    return {name or f"{level}_balance": d - (F.col(inflow) - F.col(outflow))}


def finite_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace +-inf by the median of the finite values of the column (W12),
    medians from one aggregation."""
    from vigil.operators.quantiles import exact_quantiles
    fin = df.select(*[F.when(is_finite(c), F.col(c)).alias(c) for c in cols])
    q = exact_quantiles(fin, cols, [0.5])
    med = q.groupBy().pivot("column", cols).agg(F.first("value"))
    med = med.select(*[F.col(c).alias(f"_m_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(med))  # one row
    for c in cols:
        inf = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) == float("inf"))
        out = out.withColumn(c, F.when(inf, F.col(f"_m_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_m_{c}" for c in cols])


def mahalanobis_fit(df: DataFrame, cols: list[str], label: str | None = None, normal=0):
    """Mean vector and inverse covariance of the normal rows (W19).  The f x f
    moments come from one aggregation; only the tiny matrix is inverted on
    the driver."""
    import numpy as np
    d = df.filter(F.col(label) == normal) if label else df
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols)
             for j, b in enumerate(cols) if j >= i]
    r = d.agg(*aggs).first()
    f = len(cols)
    mu = np.array([r[f"m{i}"] for i in range(f)], dtype=float)
    cov = np.zeros((f, f))
    for i in range(f):
        for j in range(i, f):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return mu, np.linalg.pinv(cov)


def mahalanobis(cols: list[str], mu, inv) -> Column:
    """sqrt((x - mu)^T S^-1 (x - mu)) as a plain arithmetic expression."""
    f = len(cols)
    dx = [F.col(c) - float(mu[i]) for i, c in enumerate(cols)]
    q = sum((dx[i] * dx[j] * float(inv[i, j]) for i in range(f) for j in range(f)), F.lit(0.0))
    return F.sqrt(F.greatest(q, F.lit(0.0)))


def sequence_windows(df: DataFrame, tl: Timeline, cols: list[str], length: int = 25, step: int = 5,
                     label: str | None = None, force_chunks: bool | None = None) -> DataFrame:
    """Per run, windows of ``length`` rows starting every ``step`` rows at
    positions ``range(0, n - length, step)``; label = label of the last row
    (W16 b).  Each window is a bounded forward frame; long runs are cut into
    chunks with a forward halo of ``length - 1`` rows."""
    from vigil.operators import chunking as CH
    label = label or tl.label
    x, t2, ch = CH.plan_chunks(df, tl, back=0, fwd=length - 1, force=force_chunks)
    w = t2.w()
    pos = F.col("_seq") if ch else F.row_number().over(w) - 1
    seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(t2.rows(0, length - 1))
    keep = CH.ctx(x)
    extra = [] if ch else [F.count(F.lit(1)).over(tl.whole()).alias("_n")]
    y = x.select(*tl.run_cols, *keep, pos.alias("seq_start"), seq.alias("seq"),
                 F.lead(label, length - 1).over(w).alias("seq_label"), *extra)
    y = CH.finish(y, ch)
    if ch:
        y = y.join(df.groupBy(*tl.run_cols).agg(F.count(F.lit(1)).alias("_n")), tl.run_cols)
    return y.filter((F.col("seq_start") % step == 0) & (F.col("seq_start") < F.col("_n") - length)).drop("_n")


def lookback_windows(df: DataFrame, tl: Timeline, cols: list[str], length: int = 10,
                     label: str | None = None) -> DataFrame:
    """Every row with the ``length`` rows ending at it (stride 1, W16 a)."""
    fr = last_n(tl, length)
    label = label or tl.label
    seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(fr)
    rn = F.row_number().over(tl.w())
    return df.select(*tl.run_cols, *tl.order, seq.alias("seq"), F.col(label).alias("seq_label"),
                     rn.alias("_rn")).filter(F.col("_rn") >= length).drop("_rn")


def feature_columns(df: DataFrame, exclude=(), prefix: str | None = None, suffix: str | None = None,
                    numeric_only: bool = True) -> list[str]:
    """Dynamic column selection by name pattern and type."""
    num = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    out = []
    for c, t in df.dtypes:
        if c in exclude or (numeric_only and t not in num and not t.startswith("decimal")):
            continue
        if prefix and not c.startswith(prefix):
            continue
        if suffix and not c.endswith(suffix):
            continue
        out.append(c)
    return out


def align_features(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """Training column order; absent -> 0, null / NaN / inf -> 0."""
    have = set(df.columns)
    cols = []
    for c in feature_names:
        if c in have:
            x = F.col(c).cast("double")
            cols.append(F.when(is_finite(x), x).otherwise(F.lit(0.0)).alias(c))
        else:
            cols.append(F.lit(0.0).alias(c))
    return df.select(*cols)




def add_expanding_prior_z(df: DataFrame, tl: Timeline, cols: list[str], min_periods: int = 5,
                          eps: float = 1e-6, force_chunks: bool | None = None) -> DataFrame:
    """W3 as a frame operation that also works on runs cut into chunks: the
    prior count / sum / sum of squares of earlier chunks are carried from a
    one-row-per-chunk summary and combined with the in-chunk prefix.  Values
    are shifted by the run's first value first, which keeps the sum of
    squares well conditioned."""
    from vigil.operators import chunking as CH
    x, t2, ch = CH.plan_chunks(df, tl, back=0, force=force_chunks)
    if not ch:
        return build(df, df.columns, *[expanding_prior_z(c, tl, min_periods, eps) for c in cols])
    runs = [c for c in t2.run_cols if c != "_chunk"]
    first = x.groupBy(*runs).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(f"_c_{c}")
                                   for c in cols])
    x = x.join(first, runs, "left")
    for c in cols:
        y = F.col(c) - F.col(f"_c_{c}")
        x = x.withColumn(f"_y_{c}", F.when(~F.col("_halo"), y)).withColumn(f"_q_{c}", F.col(f"_y_{c}") ** 2)
    summ = x.groupBy(*runs, "_chunk").agg(*[f for c in cols for f in (
        F.count(f"_y_{c}").alias(f"_n_{c}"), F.sum(f"_y_{c}").alias(f"_s_{c}"), F.sum(f"_q_{c}").alias(f"_ss_{c}"))])
    wf = Window.partitionBy(*runs).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*runs, "_chunk", *[F.coalesce(F.sum(f"_{k}_{c}").over(wf), F.lit(0)).alias(f"_C{k}_{c}")
                                           for c in cols for k in ("n", "s", "ss")])
    x = x.join(carry, runs + ["_chunk"], "left")
    fr = t2.prefix(inclusive=False)
    outs = []
    for c in cols:
        n = F.col(f"_Cn_{c}") + F.count(f"_y_{c}").over(fr)
        s = F.col(f"_Cs_{c}") + F.coalesce(F.sum(f"_y_{c}").over(fr), F.lit(0.0))
        q = F.col(f"_Css_{c}") + F.coalesce(F.sum(f"_q_{c}").over(fr), F.lit(0.0))
        mean = s / n
        var = F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))
        z = (F.col(c) - F.col(f"_c_{c}") - mean) / (F.sqrt(var) + eps)
        outs.append(F.when(n >= min_periods, z).alias(f"{c}_zscore"))
    helpers = [h for c in cols for h in (f"_c_{c}", f"_y_{c}", f"_q_{c}", f"_Cn_{c}", f"_Cs_{c}", f"_Css_{c}")]
    out = x.select(*[F.col(k) for k in x.columns if k not in helpers], *outs)
    return CH.finish(out, True)

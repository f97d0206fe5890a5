"""Column profiles, correlations, histograms and the per-episode exponential fit."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.quality import _unpivot_row


def corrected_skew(g1: Column, n: Column) -> Column:
    """Sample skewness from Spark's population skewness."""
    return g1 * F.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurt(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from Spark's population excess kurtosis."""
    return ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def numeric_profile(df: DataFrame, cols: list[str], approx: bool = False,
                    accuracy: int = 100_000) -> DataFrame:
    """count, missing, mean, sample std, min, quartiles, max, sample skew and
    excess kurtosis for every column (A6).

    Moments come from one aggregation over all columns.  Quartiles are exact
    via :func:`vigil.operators.quantiles.exact_quantiles` (a value -> count
    map when the distinct count is checked to be bounded, range refinement
    otherwise); ``approx=True`` uses ``percentile_approx`` instead.
    """
    from vigil.operators.quantiles import exact_quantiles
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{c}"), F.count_if(x.isNull()).alias(f"na_{c}"),
                 F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"),
                 F.min(x).alias(f"mn_{c}"), F.max(x).alias(f"mx_{c}"),
                 F.skewness(x).alias(f"sk_{c}"), F.kurtosis(x).alias(f"ku_{c}")]
        if approx:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"q_{c}"))
    g = df.agg(*aggs)
    if not approx:
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        qrow = q.groupBy().pivot("column", cols).agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("q"))
        g = g.crossJoin(qrow.select(*[F.transform(F.col(c), lambda e: e["value"]).alias(f"q_{c}") for c in cols]))
    fields = {}
    for c in cols:
        n = F.col(f"n_{c}").cast("double")
        fields[c] = {"count": F.col(f"n_{c}"), "missing": F.col(f"na_{c}"), "mean": F.col(f"m_{c}"),
                     "std": F.col(f"s_{c}"), "min": F.col(f"mn_{c}"), "q25": F.col(f"q_{c}")[0],
                     "median": F.col(f"q_{c}")[1], "q75": F.col(f"q_{c}")[2], "max": F.col(f"mx_{c}"),
                     "skew": F.when(n > 2, corrected_skew(F.col(f"sk_{c}"), n)),
                     "kurtosis": F.when(n > 3, corrected_kurt(F.col(f"ku_{c}"), n))}
    return _unpivot_row(g, [], fields)


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Rows outside [q25 - k iqr, q75 + k iqr] per column, count and pct.
    Exact quartiles (one row per column) are broadcast back for the count."""
    from vigil.operators.quantiles import exact_quantiles
    q = exact_quantiles(df, cols, [0.25, 0.75])
    qrow = q.groupBy().pivot("column", cols).agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("q"))
    qrow = qrow.select(*[F.transform(F.col(c), lambda e: e["value"]).alias(f"q_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(qrow))  # one row
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        q25, q75 = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        iqr = q75 - q25
        out = (F.col(c) < q25 - k * iqr) | (F.col(c) > q75 + k * iqr)
        aggs += [F.count_if(out).alias(f"o_{c}"), F.first(q25).alias(f"l_{c}"), F.first(q75).alias(f"u_{c}")]
    g = j.agg(*aggs)
    return _unpivot_row(g, [], {c: {
        "q25": F.col(f"l_{c}"), "q75": F.col(f"u_{c}"),
        "lower": F.col(f"l_{c}") - k * (F.col(f"u_{c}") - F.col(f"l_{c}")),
        "upper": F.col(f"u_{c}") + k * (F.col(f"u_{c}") - F.col(f"l_{c}")),
        "n_outliers": F.col(f"o_{c}"),
        "pct_outliers": F.round(F.col(f"o_{c}") * 100.0 / F.col("_n"), 4)} for c in cols})


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, missing, distinct values, mode (ties -> smallest), top count and
    the value counts as a JSON object with sorted keys (A8).

    Values of all columns are counted in one grouped aggregation (partial
    aggregation map-side); a second aggregation over the distinct values
    (per column) derives everything else, so the rows are read once.
    """
    u = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                       for c in cols])).alias("_u")).select("_u.*")
    vc = u.groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    nn = F.col("v").isNotNull()
    entries = F.array_sort(F.collect_list(F.when(nn, F.struct("v", "cnt"))))
    js = F.to_json(F.map_from_entries(entries))
    return vc.groupBy("column").agg(
        F.coalesce(F.sum(F.when(nn, F.col("cnt"))), F.lit(0)).alias("count"),
        F.count(F.when(nn, F.lit(1))).alias("nunique"), js.alias("value_counts"),
        F.coalesce(F.sum(F.when(~nn, F.col("cnt"))), F.lit(0)).alias("missing"),
        F.min_by(F.col("v"), F.when(nn, F.struct((-F.col("cnt")).alias("c"), F.col("v")))).alias("mode"),
        F.max(F.when(nn, F.col("cnt"))).alias("top_count"))


def corr_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every pair i < j (upper triangle), one aggregation.
    Constant columns give null (covariance over a zero product)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs.append(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"r{i}"))
    g = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"))
                    for i, (a, b) in enumerate(pairs)])
    return g.select(F.explode(arr).alias("_p")).select("_p.*")


def label_corr_topk(df: DataFrame, features: list[str], label: Column, k: int = 25) -> DataFrame:
    """|Pearson r| of every feature with the binary label, ranked, top k with
    the feature name as tie-breaker (A21, O2)."""
    y = label.cast("double")
    aggs = [F.abs(F.try_divide(F.covar_samp(F.col(c).cast("double"), y),
                               F.stddev_samp(F.col(c).cast("double")) * F.stddev_samp(y))).alias(f"r_{c}")
            for c in features]
    g = df.agg(*aggs)
    u = _unpivot_row(g, [], {c: {"abs_corr": F.col(f"r_{c}")} for c in features}, "feature")
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature"))
    return u.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def histogram(df: DataFrame, x: str, group: Column, bins: int = 50) -> DataFrame:
    """Equal-width histogram of ``x`` per group, each group over its own
    min/max; the upper edge falls into the last bin (A22)."""
    d = df.select(group.alias("grp"), F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull())
    mm = d.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = d.join(F.broadcast(mm), "grp")
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1))).cast("int")
    return j.groupBy("grp", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).select(
        "grp", "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_lo"), "n")


DEFAULT_TAUS = tuple(float(round(10 ** (i / 4), 4)) for i in range(0, 13))  # 1 .. 1000, log grid


def exp_fit(df: DataFrame, group: list[str], t: str, x: str, taus=DEFAULT_TAUS,
            min_points: int = 30) -> DataFrame:
    """Fit x ~ target + (start - target) * exp(-t / tau) per group.

    For a fixed tau the model is linear in u = exp(-t / tau), so every tau of
    the grid is a least-squares fit from moments of (x, u); all of them come from
    one aggregation.  The tau with the smallest residual sum of squares wins.
    Groups with ``min_points`` points or fewer are skipped.
    """
    x_, t_ = F.col("_x"), F.col("_t")
    e = df.select(*group, F.col(t).cast("double").alias("_t"), F.col(x).cast("double").alias("_x")).where(
        t_.isNotNull() & x_.isNotNull())
    e = e.select("*", *(F.exp(-t_ / F.lit(float(v))).alias(f"_u{i}") for i, v in enumerate(taus)))
    g = e.groupBy(*group).agg(F.count("_x").alias("n"), F.avg("_x").alias("mx"), F.var_pop("_x").alias("vx"), *(
        c for i in range(len(taus)) for c in (F.avg(f"_u{i}").alias(f"m{i}"), F.var_pop(f"_u{i}").alias(f"v{i}"),
                                              F.covar_pop("_x", f"_u{i}").alias(f"c{i}"))))
    fits = F.explode(F.array(*(F.struct(F.lit(float(v)).alias("tau"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"),
                                        F.col(f"c{i}").alias("c")) for i, v in enumerate(taus))))
    g = g.where(F.col("n") > min_points).select(*group, "n", "mx", "vx", fits.alias("f")).select(*group, "n", "mx", "vx", "f.*")
    b = F.try_divide(F.col("c"), F.col("v"))
    sse = F.col("n") * (F.col("vx") - b * F.col("c"))
    # a tau whose exponential is flat over the data has no slope: no fit
    g = g.select(*group, "tau", b.alias("b"), (F.col("mx") - b * F.col("m")).alias("a"),
                 F.greatest(sse, F.lit(0.0)).alias("sse")).where(F.col("b").isNotNull() & F.col("sse").isNotNull())
    best = g.groupBy(*group).agg(F.min_by(F.struct("tau", "a", "b", "sse"), F.struct("sse", "tau")).alias("_b"))
    return best.select(*group, F.col("_b.tau").alias("tau"), (F.col("_b.a") + F.col("_b.b")).alias("start"),
                       F.col("_b.a").alias("target"), F.col("_b.sse").alias("sse"))

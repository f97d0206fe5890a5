"""Skew-proof execution of per-run window features.

``Window.partitionBy(run)`` puts a whole run in one task; if one run holds a
third of the table, that task is a third of the job (AQE splits skewed
*joins*, not windows).  Bounded row frames only look a fixed number of rows
back (and forward), so a run can be cut into equal chunks of consecutive rows
with a *halo*: the last ``back`` rows of the previous chunk and the first
``fwd`` rows of the next one are copied in, the features are computed per
(run, chunk), and halo rows are dropped.  The result equals the plain window
for every frame no wider than the halo.

Row positions come from a two-phase prefix count that never gathers a run:
1. rows are counted per (run, time bucket) -- a map-side combined aggregate;
2. bucket offsets are running sums over that small table;
3. position = bucket offset + row_number within (run, bucket).

Unbounded look-backs (forward fill, expanding statistics) are carried across
chunks the same way: a per-chunk summary, a running combine over the summary
table, and a join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators.timeline import Timeline

CHUNK_ROWS_CONF = "vigil.window.chunkRows"
CHUNK_MODE_CONF = "vigil.window.chunkMode"   # auto (size check) | always | never
BUCKET_S_CONF = "vigil.window.bucketSeconds"
DEFAULT_CHUNK_ROWS = 2_000_000
DEFAULT_BUCKET_S = 3600.0


def _conf(spark: SparkSession, key: str, default):
    v = spark.conf.get(key, None)
    return type(default)(v) if v not in (None, "") else default


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets null keys meet (a run, class or time may be null):
    still a hash / sort-merge join, and no row is lost."""
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    test = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_on_{k}"))
        test = one if test is None else test & one
    return left.join(other, test, how).drop(*[f"_on_{k}" for k in keys])


def ctx(df: DataFrame) -> list[str]:
    """Chunk bookkeeping columns present in ``df`` (to keep through a select)."""
    return [c for c in ("_halo", "_chunk", "_seq") if c in df.columns]


def needs_chunking(df: DataFrame, tl: Timeline, chunk_rows: int) -> bool:
    """Size check: is any run longer than ``chunk_rows``?  One aggregation
    that reads only the run columns (pruned scan, map-side combined).
    ``vigil.window.chunkMode`` = always / never skips the check (a cluster
    that knows its runs are skewed saves the extra pass)."""
    mode = (df.sparkSession.conf.get(CHUNK_MODE_CONF, "auto") or "auto").lower()
    if mode == "always":
        return True
    if mode == "never":
        return False
    m = df.groupBy(*tl.run_cols).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return m is not None and m > chunk_rows


def add_sequence(df: DataFrame, tl: Timeline, bucket_s: float = DEFAULT_BUCKET_S, out: str = "_seq",
                 bucket=None, total: str | None = None, grand_total: str | None = None) -> DataFrame:
    """0-based position of each row within its run, in ``tl.order``.  Time
    buckets come from the leading order column (timestamp -> epoch seconds,
    numeric as is), which is non-decreasing along the order by definition; rows
    without a time form the first bucket, as nulls sort first."""
    runs = tl.run_cols
    lead = tl.order[0]
    typ = dict(df.dtypes)[lead]
    from vigil.functions.columns import micros
    secs = micros(lead) / 1e6 if typ.startswith("timestamp") or typ == "date" \
        else F.col(lead).cast("double")
    b = bucket if bucket is not None else F.floor(secs / F.lit(bucket_s)).cast("long")
    x = df.withColumn("_b", b)
    cnt = x.groupBy(*runs, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*runs).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(wb), F.lit(0)))
    need_total = total or grand_total
    if need_total:  # rows per run, from the same small table (no extra pass)
        wl = Window.partitionBy(*runs).orderBy("_b").rowsBetween(Window.unboundedPreceding,
                                                                 Window.unboundedFollowing)
        off = off.withColumn("_tot", F.sum("_c").over(wl))
    if grand_total:
        # the first bucket of every run (offset 0) carries the run total once
        off = off.withColumn(grand_total, F.sum(F.when(F.col("_off") == 0, F.col("_tot")))
                             .over(Window.partitionBy(F.lit(0))))
    if total:
        off = off.withColumnRenamed("_tot", total)
    off = off.drop("_c", "_tot")
    x = join_on(x, off, runs + ["_b"])
    wr = Window.partitionBy(*runs, "_b").orderBy(*tl.order)
    return x.withColumn(out, F.col("_off") + F.row_number().over(wr) - 1).drop("_b", "_off")


def with_halo(df: DataFrame, tl: Timeline, chunk_rows: int, back: int, fwd: int = 0,
              seq: str = "_seq") -> tuple[DataFrame, Timeline]:
    """Cut runs into chunks of ``chunk_rows`` positions and copy halos.
    Returns the widened frame (with ``_chunk``/``_halo``) and the timeline to
    compute on: partition (run, chunk), order by position."""
    if back > chunk_rows or fwd > chunk_rows:
        raise ValueError("halo wider than a chunk")
    ch = F.floor(F.col(seq) / chunk_rows).cast("long")
    pos = F.col(seq) % chunk_rows
    parts = [df.withColumn("_chunk", ch).withColumn("_halo", F.lit(False))]
    if back:
        parts.append(df.filter(pos >= chunk_rows - back).withColumn("_chunk", ch + 1)
                       .withColumn("_halo", F.lit(True)))
    if fwd:
        parts.append(df.filter((pos < fwd) & (F.col(seq) >= chunk_rows)).withColumn("_chunk", ch - 1)
                       .withColumn("_halo", F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    tl2 = tl.with_(run=tuple(tl.run_cols) + ("_chunk",), order=(seq,))
    return out, tl2


def chunked(df: DataFrame, tl: Timeline, fn, back: int, fwd: int = 0, chunk_rows: int | None = None,
            bucket_s: float | None = None, force: bool | None = None) -> DataFrame:
    """Apply ``fn(df, timeline) -> df`` whose windows look at most ``back``
    rows back and ``fwd`` rows forward.  Plain per-run windows when every run
    fits in a chunk (checked), chunk + halo otherwise."""
    spark = df.sparkSession
    chunk_rows = chunk_rows or _conf(spark, CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS)
    bucket_s = bucket_s or _conf(spark, BUCKET_S_CONF, DEFAULT_BUCKET_S)
    chunk_rows = max(chunk_rows, 2 * max(back, fwd, 1))  # a halo never spans more than one chunk
    use = needs_chunking(df, tl, chunk_rows) if force is None else force
    if not use:
        return fn(df, tl)
    seqd = add_sequence(df, tl, bucket_s)
    wide, tl2 = with_halo(seqd, tl, chunk_rows, back, fwd)
    res = fn(wide, tl2)
    return res.filter(~F.col("_halo")).drop("_halo", "_chunk", "_seq")


def fill_across_chunks(df: DataFrame, tl2: Timeline, cols: list[str], forward: bool = True,
                       backward: bool = True, default=0.0) -> DataFrame:
    """Per-run ffill -> bfill -> default of ``cols`` on a chunked frame.

    Inside a chunk (halo included) the nearest non-null value comes from the
    usual ``last(ignorenulls)`` frames; across chunks it comes from a
    one-row-per-chunk summary (last / first non-null value of each chunk's own
    rows) combined by a running ``last(ignorenulls)`` over the chunk order.
    All columns share one summary aggregation and one join.
    """
    runs = [c for c in tl2.run_cols if c != "_chunk"]
    core = df.filter(~F.col("_halo")) if "_halo" in df.columns else df
    nn = lambda c: F.when(F.col(c).isNotNull(), F.col("_seq"))
    aggs = []
    for c in cols:
        if forward:
            aggs.append(F.max_by(F.col(c), nn(c)).alias(f"_l_{c}"))
        if backward:
            aggs.append(F.min_by(F.col(c), nn(c)).alias(f"_f_{c}"))
    summ = core.groupBy(*runs, "_chunk").agg(*aggs)
    wf = Window.partitionBy(*runs).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    wb = Window.partitionBy(*runs).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sel = [*runs, "_chunk"]
    for c in cols:
        if forward:
            sel.append(F.last(f"_l_{c}", ignorenulls=True).over(wf).alias(f"_cf_{c}"))
        if backward:
            sel.append(F.last(f"_f_{c}", ignorenulls=True).over(wb).alias(f"_cb_{c}"))
    carry = summ.select(*sel)
    out = join_on(df, carry, runs + ["_chunk"], "left")
    exprs = []
    for c in cols:
        # halo rows carry values computed without their own context: only a
        # chunk's own rows may feed the fill
        own = F.when(~F.col("_halo"), F.col(c)) if "_halo" in df.columns else F.col(c)
        parts = []
        if forward:
            parts += [tl2.prev_non_null(own), F.col(f"_cf_{c}")]
        if backward:
            parts += [tl2.next_non_null(own), F.col(f"_cb_{c}")]
        exprs.append(F.coalesce(*parts, F.lit(default)).alias(c))
    keep = [c for c in df.columns if c not in cols]
    return out.select(*keep, *exprs)


def carry_nearest(df: DataFrame, tl2: Timeline, specs: list[tuple[str, str, str]]) -> DataFrame:
    """Nearest non-null value across chunks.  ``specs`` = (source column,
    "prev" | "next", output column); "prev" = at or before the row, "next" =
    at or after.  Values of halo rows are never used."""
    runs = [c for c in tl2.run_cols if c != "_chunk"]
    has_halo = "_halo" in df.columns
    core = df.filter(~F.col("_halo")) if has_halo else df
    nn = lambda c: F.when(F.col(c).isNotNull(), F.col("_seq"))
    aggs = []
    for src, d, out in specs:
        f = F.max_by if d == "prev" else F.min_by
        aggs.append(f(F.col(src), nn(src)).alias(f"_s_{out}"))
    summ = core.groupBy(*runs, "_chunk").agg(*aggs)
    wf = Window.partitionBy(*runs).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    wb = Window.partitionBy(*runs).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*runs, "_chunk", *[
        F.last(f"_s_{out}", ignorenulls=True).over(wf if d == "prev" else wb).alias(f"_c_{out}")
        for src, d, out in specs])
    x = join_on(df, carry, runs + ["_chunk"], "left")
    for src, d, out in specs:
        own = F.when(~F.col("_halo"), F.col(src)) if has_halo else F.col(src)
        local = tl2.prev_non_null(own) if d == "prev" else tl2.next_non_null(own)
        x = x.withColumn(out, F.coalesce(local, F.col(f"_c_{out}")))
    return x.drop(*[f"_c_{out}" for _, _, out in specs])


def carry_running_sum(df: DataFrame, tl2: Timeline, src: str, out: str) -> DataFrame:
    """Running sum of ``src`` over the whole run on a chunked frame: local
    running sum over the chunk's own rows plus the total of earlier chunks."""
    runs = [c for c in tl2.run_cols if c != "_chunk"]
    has_halo = "_halo" in df.columns
    own = F.when(~F.col("_halo"), F.col(src)).otherwise(F.lit(0)) if has_halo else F.col(src)
    x = df.withColumn("_own", own)
    summ = x.groupBy(*runs, "_chunk").agg(F.sum("_own").alias("_tot"))
    wf = Window.partitionBy(*runs).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*runs, "_chunk", F.coalesce(F.sum("_tot").over(wf), F.lit(0)).alias("_carry"))
    x = join_on(x, carry, runs + ["_chunk"], "left")
    return x.withColumn(out, F.sum("_own").over(tl2.prefix()) + F.col("_carry")).drop("_own", "_carry")


def plan_chunks(df: DataFrame, tl: Timeline, back: int, fwd: int = 0, chunk_rows: int | None = None,
                force: bool | None = None):
    """Decide and prepare: returns (frame, timeline, chunked?)."""
    spark = df.sparkSession
    chunk_rows = max(chunk_rows or _conf(spark, CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS), 2 * max(back, fwd, 1))
    use = needs_chunking(df, tl, chunk_rows) if force is None else force
    if not use:
        return df, tl, False
    seqd = add_sequence(df, tl, _conf(spark, BUCKET_S_CONF, DEFAULT_BUCKET_S))
    wide, tl2 = with_halo(seqd, tl, chunk_rows, back, fwd)
    return wide, tl2, True


def finish(df: DataFrame, chunked_: bool) -> DataFrame:
    if not chunked_:
        return df
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk", "_seq")

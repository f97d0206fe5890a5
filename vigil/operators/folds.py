"""Order-dependent folds that no window function expresses.

Alert de-duplication (T6): per key, an alert fires when at least ``cooldown``
seconds passed since the last alert that *fired* (greedy).  A row whose gap
to the previous row of the key is >= cooldown always fires, so the timeline
splits into independent "bursts" at those gaps; bursts are hashed over
partitions and scanned once per partition.  A burst longer than a segment
(an alert storm) is cut into segments that are summarised, chained through
their small summaries and marked in parallel, so no storm is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def alert_dedup(df: DataFrame, keys: list[str], order: list[str], t: str, cooldown: float,
                out: str = "fired", force_chunks: bool | None = None,
                long_burst_rows: int | None = None) -> DataFrame:
    """Adds boolean ``out``: greedy cooldown per ``keys`` in ``order``.

    Bursts (split at gaps >= cooldown) are independent, so they are hashed
    across partitions by (keys, burst), sorted inside each partition and
    scanned by one Arrow-batched ``mapInPandas`` call per partition: no
    per-group Python call, and a hot key's bursts spread over many tasks.
    """
    from vigil.operators import chunking as CH
    from vigil.operators.timeline import Timeline
    # one predicate everywhere: times and the cooldown in whole microseconds
    wait = round(cooldown * 1e6)
    df = df.withColumn("_us", F.round(F.col(t).cast("double") * 1_000_000).cast("long"))
    t, cooldown = "_us", wait
    tl = Timeline(run=tuple(keys), order=tuple(order), t=t)
    # burst ids: a one-row look-back and a running count, both chunk-safe, so
    # a key holding a large share of the rows is not one window task
    x, t2, ch = CH.plan_chunks(df, tl, back=1, force=force_chunks)
    gap = F.col(t) - F.lag(t).over(t2.w())
    x = x.withColumn("_start", (gap.isNull() | (gap >= cooldown)).cast("int"))
    if ch:
        x = CH.carry_running_sum(x, t2, "_start", "_burst")
    else:
        x = x.withColumn("_burst", F.sum("_start").over(t2.prefix()))
    x = CH.finish(x, ch)
    long_rows = long_burst_rows or int(CH._conf(df.sparkSession, CH.CHUNK_ROWS_CONF, CH.DEFAULT_CHUNK_ROWS))
    if ch or long_burst_rows:      # else no key, so no burst, is longer than a chunk
        biggest = x.groupBy(*keys, "_burst").agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
        if biggest > long_rows:
            return _dedup_with_long_bursts(x, keys, order, t, cooldown, out, long_rows).drop("_us")
    return _scan_bursts(x, keys, order, t, cooldown, out).drop("_start", "_burst", "_us")


def _fires(tv: np.ndarray, start: np.ndarray, wait: int, last: int | None) -> tuple[np.ndarray, int]:
    """Which of the rows fire, and the time of the last that did.  ``start`` marks
    the first row of a burst; rows before the first mark go on with the burst
    whose last alert fired at ``last``.

    All bursts step on together: their times are laid end to end on one line, so
    one search finds the next alert of each."""
    if wait <= 0:
        return np.ones(len(tv), bool), int(tv[-1])
    fired = start.copy()
    heads = np.flatnonzero(start)
    if not start[0]:
        heads = np.concatenate([[0], heads])
    origin = tv[heads]
    if not start[0]:
        origin[0] = last
    burst = np.searchsorted(heads, np.arange(len(tv)), "right") - 1
    since = tv - origin[burst]
    base = np.cumsum(np.maximum.reduceat(since, heads) + wait + 1)
    base = np.concatenate([[0], base[:-1]])
    line, ends = base[burst] + since, np.append(heads[1:], len(tv))
    now, live = np.zeros(len(heads), np.int64), np.arange(len(heads))
    while len(live):
        at = np.searchsorted(line, base[live] + now[live] + wait)
        ok = at < ends[live]
        live, at = live[ok], at[ok]
        fired[at] = True
        now[live] = since[at]
    return fired, int(origin[-1] + now[-1])


def _scan_bursts(x: DataFrame, keys, order, t, cooldown, out) -> DataFrame:
    """Hash bursts over partitions, sort, one sequential scan per partition."""
    x = x.repartition(*[F.col(k) for k in keys], F.col("_burst")).sortWithinPartitions(*keys, "_burst", *order)
    schema = T.StructType(x.schema.fields + [T.StructField(out, T.BooleanType(), False)])

    def scan(batches):
        last = None
        for pdf in batches:
            if len(pdf):
                fired, last = _fires(pdf[t].to_numpy(dtype=np.int64), pdf["_start"].to_numpy() == 1, cooldown, last)
                yield pdf.assign(**{out: fired})

    return x.mapInPandas(scan, schema)


def _dedup_with_long_bursts(x: DataFrame, keys, order, t, cooldown, out, seg_rows: int) -> DataFrame:
    """Exact greedy cooldown when a burst is longer than ``seg_rows`` rows.

    1. positions inside each burst (two-phase count) and the successor of
       every alert: the first alert at or after t + cooldown (a forward as-of
       lookup, chunk-safe);
    2. bursts are cut into segments of ``seg_rows`` positions; for each
       segment, in parallel, the last alert fired inside it is tabulated for
       every possible entry alert -- entries can only be the alerts of its
       first 2 x cooldown seconds, because consecutive fires inside a burst
       are less than 2 x cooldown apart;
    3. per burst, only those small tables are chained segment by segment to
       find each segment's entry alert;
    4. each segment then marks its fires from its entry, in parallel.
    Short bursts keep the single-scan path.
    """
    from vigil.operators import chunking as CH
    from vigil.operators.timeline import Timeline
    bk = list(keys) + ["_burst"]
    tlb = Timeline(run=tuple(bk), order=tuple(order), t=t)
    x = CH.add_sequence(x, tlb, total="_bn").withColumnRenamed("_seq", "_pos")
    short = x.filter(F.col("_bn") <= seg_rows).drop("_pos", "_bn")
    lg = x.filter(F.col("_bn") > seg_rows)
    # 1. successor positions via probes at t + cooldown (probe sorts before an
    #    alert at the same time, so "at or after" holds)
    ev = lg.select(*bk, F.col(t).alias("_time"), F.lit(1).alias("_side"),
                   F.col("_pos").alias("_epos"), F.lit(None).cast("long").alias("_opos"))
    pr = lg.select(*bk, (F.col(t) + cooldown).alias("_time"), F.lit(0).alias("_side"),
                   F.lit(None).cast("long").alias("_epos"), F.col("_pos").alias("_opos"))
    u = ev.unionByName(pr)
    tlu = Timeline(run=tuple(bk), order=("_time", "_side", "_epos"), t="_time")
    uu, t2, ch = CH.plan_chunks(u, tlu, back=0)
    if ch:
        uu = CH.carry_nearest(uu, t2, [("_epos", "next", "_succ")])
    else:
        uu = uu.withColumn("_succ", tlu.next_non_null("_epos", inclusive=True))
    succ = CH.finish(uu, ch).filter(F.col("_side") == 0).select(*bk, F.col("_opos").alias("_pos"), "_succ")
    lg = lg.join(succ, bk + ["_pos"], "left").withColumn("_seg", F.floor(F.col("_pos") / seg_rows).cast("long"))
    base_cols = lg.columns

    # 2. per segment: exit fire for every possible entry
    cand_schema = T.StructType([lg.schema[c] for c in bk] + [
        T.StructField("_seg", T.LongType()), T.StructField("_cpos", T.LongType()),
        T.StructField("_ct", T.LongType()), T.StructField("_xpos", T.LongType()),
        T.StructField("_xt", T.LongType())])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        pos = pdf["_pos"].to_numpy(dtype=np.int64)
        tv = pdf[t].to_numpy(dtype=np.int64)
        sc = pdf["_succ"].to_numpy(dtype=float)
        p0, n = pos[0], len(pos)
        end = np.arange(n)
        for i in range(n - 1, -1, -1):
            s_ = sc[i]
            if not np.isnan(s_) and int(s_) - p0 < n:
                end[i] = end[int(s_) - p0]
        cand = np.nonzero(tv < tv[0] + 2 * cooldown)[0]
        res = pdf.iloc[cand][bk].copy()
        res["_seg"] = pdf["_seg"].iloc[0]
        res["_cpos"] = pos[cand]
        res["_ct"] = tv[cand]
        res["_xpos"] = pos[end[cand]]
        res["_xt"] = tv[end[cand]]
        return res[[f.name for f in cand_schema.fields]]

    cands = lg.groupBy(*bk, "_seg").applyInPandas(summarise, cand_schema)

    # 3. chain the small per-segment tables inside each burst
    entry_schema = T.StructType([lg.schema[c] for c in bk] + [
        T.StructField("_seg", T.LongType()), T.StructField("_entry", T.LongType(), True)])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_seg", "_ct", "_cpos"])
        rows = []
        exit_t = None
        for seg, g in pdf.groupby("_seg", sort=True):
            if exit_t is None:
                i = 0
            else:
                # the next fire is the first alert >= exit + cooldown; it lies
                # within 2 x cooldown of the segment start, or, when no
                # candidate qualifies, the whole segment is inside the
                # cooldown and fires nothing
                ok = np.nonzero(g["_ct"].to_numpy() >= exit_t + cooldown)[0]
                if len(ok) == 0:
                    continue
                i = int(ok[0])
            rows.append((seg, int(g["_cpos"].iloc[i])))
            exit_t = int(g["_xt"].iloc[i])
        out_ = pd.DataFrame(rows, columns=["_seg", "_entry"])
        for c in bk:
            out_[c] = pdf[c].iloc[0]
        return out_[[f.name for f in entry_schema.fields]]

    entries = cands.groupBy(*bk).applyInPandas(chain, entry_schema)

    # 4. mark fires inside each segment from its entry
    lg2 = lg.join(entries, bk + ["_seg"], "left")  # no entry: the segment fires nothing
    mark_schema = T.StructType([lg2.schema[c] for c in base_cols + ["_entry"]] +
                               [T.StructField(out, T.BooleanType(), False)])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        pos = pdf["_pos"].to_numpy(dtype=np.int64)
        sc = pdf["_succ"].to_numpy(dtype=float)
        p0, n = pos[0], len(pos)
        fired = np.zeros(n, dtype=bool)
        e0 = pdf["_entry"].iloc[0]
        i = -1 if pd.isna(e0) else int(e0) - p0
        while 0 <= i < n:
            fired[i] = True
            s_ = sc[i]
            if np.isnan(s_):
                break
            i = int(s_) - p0
        pdf[out] = fired
        return pdf[[f.name for f in mark_schema.fields]]

    long_out = lg2.groupBy(*bk, "_seg").applyInPandas(mark, mark_schema)
    long_out = long_out.drop("_pos", "_bn", "_succ", "_seg", "_entry")
    short_out = _scan_bursts(short, keys, order, t, cooldown, out)
    return short_out.unionByName(long_out).drop("_start", "_burst")


RULE_SEGMENT = 100_000          # readings of a segment of a long run


def _next_near(val: np.ndarray, at: int, ref: float, limit: float) -> int:
    """The first place from ``at`` on whose value is within ``limit`` of ``ref`` (or the end)."""
    width = 64
    while at < len(val):
        near = np.abs(val[at:at + width] - ref) <= limit
        if near.any():
            return at + int(np.argmax(near))
        at, width = at + width, 2 * width
    return len(val)


def _valid_places(val: np.ndarray, limit: float, first: int, stop: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The runs [a, b) of places the rule accepts once it has accepted ``first``,
    leaping from jump to jump; up to a place that ``stop`` marks."""
    calm = np.append(np.abs(np.diff(val)) <= limit, False)
    out, i = [], first
    while i < len(val):
        end, width = i, 64
        while calm[end]:                                     # the end of the calm run from i
            part = calm[end:end + width]
            end += len(part) if part.all() else int(np.argmin(part))
            width *= 2
        if stop is not None and (seen := stop[i:end + 1]).any():
            out.append((i, i + int(np.argmax(seen)) + 1))
            break
        out.append((i, end + 1))
        i = _next_near(val, end + 1, val[end], limit)
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    i = x.view(np.int64)
    return np.where(i >= 0, i, -(i & np.int64((1 << 63) - 1)))


def _unordered(k: np.ndarray) -> np.ndarray:
    return np.where(k >= 0, k, -k | np.int64(-1 << 63)).view(np.float64)


def neighbourhoods(val: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest double L with abs(value - L) <= limit, as the
    scan tests it: found by halving between doubles, so no rounding is left out."""
    ends = []
    for sign in (-1.0, 1.0):
        far, near = _ordered(val + sign * (2 * limit + np.abs(val) + 1)), _ordered(val.copy())
        while (np.abs(far // 2 - near // 2) > 1).any() or (np.abs(far - near) > 1).any():
            mid = far // 2 + near // 2 + (far % 2 + near % 2) // 2
            ok = np.abs(val - _unordered(mid)) <= limit
            moved = (mid != far) & (mid != near)
            near, far = np.where(moved & ok, mid, near), np.where(moved & ~ok, mid, far)
            if not moved.any():
                break
        ends.append(_unordered(near))
    return ends[0], ends[1]


def rule_summary(val: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float | None]:
    """What a segment of readings makes of the last valid value L before it:
    (low, high, exit): an L within [low, high] leaves as ``exit``, any other
    unchanged; and the exit where nothing was valid before.

    The first reading near L is accepted and what follows depends on it alone.
    Only readings whose neighbourhood holds an L that no earlier one is near
    start a piece, and chains that meet go on together, so each place is walked once."""
    exit_of, done = np.full(len(val), np.nan), np.zeros(len(val), bool)

    def leave(i: int) -> float:
        if not done[i]:
            runs = _valid_places(val, limit, i, done)
            last = runs[-1][1] - 1
            value = exit_of[last] if done[last] else val[last]
            for a, b in runs:
                exit_of[a:b], done[a:b] = value, True
        return float(exit_of[i])

    below, above = neighbourhoods(val, limit)
    low, high = np.zeros(0), np.zeros(0)                     # the union of the neighbourhoods so far, as parts
    pieces: list[tuple[float, float, float]] = []
    for at in range(0, len(val), 256):
        a, b = below[at:at + 256], above[at:at + 256]
        k = np.searchsorted(low, a, "right") - 1
        inside = (k >= 0) & (high[np.maximum(k, 0)] >= b) if len(low) else np.zeros(len(a), bool)
        for i in at + np.flatnonzero(~inside):
            a, b = below[i], above[i]
            k, m = int(np.searchsorted(high, a, "left")), int(np.searchsorted(low, b, "right"))      # parts k .. m - 1 meet [a, b]
            if k < m and low[k] <= a and high[k] >= b:
                continue
            begin = a
            for x, y in [*zip(low[k:m], high[k:m], strict=True), (np.inf, np.inf)]:
                end = min(np.nextafter(x, -np.inf), b)
                if begin <= end:
                    pieces.append((float(begin), float(end), leave(int(i))))
                begin = np.nextafter(y, np.inf)
            first, last = (min(a, low[k]), max(b, high[m - 1])) if k < m else (a, b)
            low, high = np.concatenate([low[:k], [first], low[m:]]), np.concatenate([high[:k], [last], high[m:]])
    out: list[list[float]] = []
    for x, y, v in sorted(pieces):
        if out and out[-1][2] == v and np.nextafter(out[-1][1], np.inf) == x:
            out[-1][1] = y
        else:
            out.append([x, y, v])
    cols = np.array(out).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2], leave(0) if len(val) else None


def _through(entry: float | None, low, high, leave, fresh: float | None) -> float | None:
    """The last valid value after a segment that ``entry`` comes into."""
    if entry is None or entry != entry:
        return fresh
    k = int(np.searchsorted(low, entry, "right")) - 1
    return float(leave[k]) if k >= 0 and high[k] >= entry else entry


def _rule_scan(pdf: pd.DataFrame, x: str, limit: float, entry: float | None) -> pd.DataFrame:
    """Rows in order with ``reason``; ``entry`` is the last valid value before them."""
    reason = pdf["reason"].to_numpy(dtype=object)
    at = np.flatnonzero(pdf["reason"].isna().to_numpy())
    val = pdf[x].to_numpy(dtype=float)[at]
    if len(val):
        first = 0 if entry is None or entry != entry else _next_near(val, 0, entry, limit)
        jump = np.ones(len(val), bool)
        for a, b in _valid_places(val, limit, first):
            jump[a:b] = False
        reason[at[jump]] = "jump"
    return pdf.assign(reason=reason, valid=pd.isna(reason))


def last_valid_rule_check(df: DataFrame, keys: list[str], order: list[str], x: str,
                          lo: float | None = None, hi: float | None = None,
                          max_change: float | None = None, segment: int | None = None) -> DataFrame:
    """Range and rate-of-change check against the last *valid* value.

    Adds ``valid`` and ``reason`` ("null", "low", "high", "jump" or null).
    Null and range are columns; only the jump rule is a fold, since a value that
    jumped is no reference for the next.  A run of more than ``segment`` readings
    is cut: each segment is summed up as what it makes of any last valid value
    (:func:`rule_summary`), the summaries of a run are chained, and each segment
    is scanned from its own entry, so no task holds a run.
    """
    from vigil.operators import chunking as CH
    from vigil.operators.timeline import Timeline
    v = F.col(x).cast("double")
    early = (F.when(v.isNull() | F.isnan(v), "null").when(F.lit(lo is not None) & (v < F.lit(lo)), "low")
             .when(F.lit(hi is not None) & (v > F.lit(hi)), "high"))
    rows = df.withColumn("reason", early)
    if max_change is None:
        return rows.withColumn("valid", F.col("reason").isNull()).select(*df.columns, "valid", "reason")
    schema = T.StructType(df.schema.fields + [T.StructField("valid", T.BooleanType(), False),
                                              T.StructField("reason", T.StringType(), True)])
    names = [f.name for f in schema.fields]
    tl = Timeline(run=tuple(keys), order=tuple(order))
    segment = segment or CH._conf(df.sparkSession, CH.CHUNK_ROWS_CONF, RULE_SEGMENT)
    if not CH.needs_chunking(rows, tl, segment):
        return rows.groupBy(*keys).applyInPandas(
            lambda pdf: _rule_scan(pdf.sort_values(order, kind="mergesort"), x, max_change, None)[names], schema)

    cut = CH.add_sequence(rows, tl).withColumn("_seg", F.floor(F.col("_seq") / segment).cast("long"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        val = pdf.sort_values("_seq").loc[lambda d: d["reason"].isna(), x].to_numpy(dtype=float)
        low, high, leave, fresh = rule_summary(val, max_change)
        return pdf[[*keys, "_seg"]].iloc[:1].assign(low=[low], high=[high], leave=[leave], fresh=fresh)

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, entry, out = pdf.sort_values("_seg"), None, []
        for r in pdf.itertuples():
            out.append(entry)
            entry = _through(entry, r.low, r.high, r.leave, None if r.fresh is None or r.fresh != r.fresh else r.fresh)
        return pdf[[*keys, "_seg"]].assign(_entry=np.array(out, float))

    sums = cut.groupBy(*keys, "_seg").applyInPandas(
        summed, f"{kinds}, _seg long, low array<double>, high array<double>, leave array<double>, fresh double")
    entries = sums.groupBy(*keys).applyInPandas(chained, f"{kinds}, _seg long, _entry double")
    both = CH.join_on(cut, entries, [*keys, "_seg"])
    return both.groupBy(*keys, "_seg").applyInPandas(
        lambda pdf: _rule_scan(pdf.sort_values("_seq"), x, max_change, pdf["_entry"].iloc[0])[names], schema)

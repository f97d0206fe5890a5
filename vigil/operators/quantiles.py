"""Exact quantiles without gathering a group's values.

``percentile`` is exact but keeps a value -> count map per group, so its
memory follows the number of distinct values; that is bounded for quantised
sensor readings, not for arbitrary doubles.  :func:`exact_quantiles` checks
that first (one aggregation with ``approx_count_distinct``) and otherwise
selects the order statistics by range refinement:

1. per (group, column): n, min, max; target ranks floor/ceil(p * (n - 1));
2. each round buckets the rows inside every unresolved target's current
   value range into ``bins`` equal-width buckets (count, min, max per
   bucket, map-side combined) and keeps the bucket holding the target rank;
   bucket index is monotone in the value, so no row of another bucket lies in
   the kept [min, max];
3. a target is resolved once its range holds one distinct value or at most
   ``small`` rows, which are then ranked exactly.

Every round is a pass over the rows with a tiny target table; nothing is
collected to the driver.  Linear interpolation between the two order
statistics matches numpy / pandas / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _long(df: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    return (df.select(*group, F.explode(arr).alias("_u")).select(*group, "_u.column", "_u.v")
              .filter(F.col("v").isNotNull() & ~F.isnan("v")))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], group: list[str] | None = None,
                    bins: int = 1024, small: int = 100_000, max_distinct: int = 1_000_000,
                    max_rounds: int = 8, force_refine: bool = False) -> DataFrame:
    """Rows (*group, column, p, value) with the linear-interpolated quantile."""
    group = list(group or [])
    base = _long(df, cols, group)
    keys = group + ["column"]
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                    F.max("v").alias("hi"), F.approx_count_distinct("v").alias("nd"))
    parr = F.array(*[F.lit(float(p)) for p in probs])
    if not force_refine and (stats.agg(F.max("nd")).first()[0] or 0) <= max_distinct:
        q = base.groupBy(*keys).agg(F.percentile("v", parr).alias("_q"))
        return q.select(*keys, F.explode(F.arrays_zip(parr.alias("p"), F.col("_q").alias("value"))).alias("_z")) \
                .select(*keys, "_z.p", "_z.value")
    spark = df.sparkSession
    from vigil.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # targets: one row per (group, column, rank) still to resolve
    t = stats.select(*keys, "n", "lo", "hi", F.explode(parr).alias("p"))
    pos = F.col("p") * (F.col("n") - 1)
    t = t.select(*keys, "lo", "hi", F.explode(F.array_distinct(F.array(
        F.floor(pos).cast("long"), F.ceil(pos).cast("long")))).alias("rank")).distinct()
    t = t.withColumn("rin", F.col("rank")).withColumn("cnt", F.lit(None).cast("long"))
    done = None
    for _ in range(max_rounds):
        resolved = (F.col("lo") == F.col("hi")) | F.coalesce(F.col("cnt") <= small, F.lit(False))
        fin = t.filter(resolved)
        done = fin if done is None else done.unionByName(fin)
        t = t.filter(~resolved)
        t = t.checkpoint()          # small table; cuts the growing lineage of the loop
        if t.isEmpty():
            break
        j = base.join(t, keys).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                    F.lit(bins - 1)).cast("int")
        g = j.groupBy(*keys, "rank", "rin", b.alias("_bk")).agg(
            F.count(F.lit(1)).alias("bc"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
        w = Window.partitionBy(*keys, "rank").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumn("before", F.coalesce(F.sum("bc").over(w), F.lit(0)))
        g = g.filter((F.col("rin") >= F.col("before")) & (F.col("rin") < F.col("before") + F.col("bc")))
        t = g.select(*keys, "rank", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"),
                     (F.col("rin") - F.col("before")).alias("rin"), F.col("bc").alias("cnt"))
    if t is not None and not t.isEmpty():
        done = t if done is None else done.unionByName(t)
    # final exact ranking inside the (small) resolved ranges
    single = done.filter(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("value"))
    rest = done.filter(F.col("lo") != F.col("hi"))
    cand = base.join(rest, keys).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    wr = Window.partitionBy(*keys, "rank").orderBy("v")
    picked = (cand.withColumn("_r", F.row_number().over(wr) - 1).filter(F.col("_r") == F.col("rin"))
              .select(*keys, "rank", F.col("v").alias("value")))
    vals = single.unionByName(picked)
    # interpolate between the floor and ceil order statistics
    q = stats.select(*keys, "n", F.explode(parr).alias("p"))
    pos = F.col("p") * (F.col("n") - 1)
    q = q.withColumn("_lo", F.floor(pos).cast("long")).withColumn("_hi", F.ceil(pos).cast("long")) \
         .withColumn("_f", pos - F.floor(pos))
    vl = vals.select(*keys, F.col("rank").alias("_lo"), F.col("value").alias("_vlo"))
    vh = vals.select(*keys, F.col("rank").alias("_hi"), F.col("value").alias("_vhi"))
    q = q.join(vl, keys + ["_lo"]).join(vh, keys + ["_hi"])
    return q.select(*keys, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias("value"))

"""K-nearest neighbours, exact or by hashing, neighbour votes and SMOTE.

Exact kNN in tens of dimensions cannot be pruned much (distances concentrate),
so :func:`knn` is all-pairs work, organised so that no pair is ever a row: query
and reference rows are dealt to blocks (of one class, where only rows of a class
meet), each pair of blocks meets in one task (a cogroup), which gives the k best
of its block for each query; the lists are merged by a window.  A task holds two
blocks and measures a bounded number of pairs at once, whatever the tables hold.
A row is sent once for each block of the other side, so both sides are cut alike
and no finer than size or free cores ask for.

Above a size limit :func:`lsh_knn` compares only rows that share a bucket of
random projections, and measures what that loses: a hashed sample of the queries
is also compared with every reference row, and the number of tables grows until
the sample's recall is reached; if it never is, the exact result is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, REF_BLOCK = 32_768, 32_768     # rows of a block at most, about
PAIRS = 1 << 21                             # distances a task holds at once
LEAST_BLOCK = 256                           # and at least, where that keeps all cores busy

_FOUND = "qid long, qh long, dist double, rid long, rlabel long"


def _nearest(qv: np.ndarray, qid: np.ndarray, rv: np.ndarray, rid: np.ndarray, k: int, exclude_self: bool,
             mid: np.ndarray, rc: np.ndarray, rn: np.ndarray, r_most: float):
    """(query place, distance, reference place) of the k nearest of a block,
    ties by id.  Candidates come from the BLAS form |q|^2 + |r|^2 - 2 q.r on
    centred vectors (``mid`` the centre, ``rc``, ``rn`` the centred references and
    their squared lengths, ``r_most`` the largest as they came): every row whose
    rounded distance is within the rounding bound of the k-th one is kept, ties
    included, and measured again by direct differences, so ranks and distances are exact."""
    qc = qv - mid
    qn = (qc * qc).sum(1)
    d2 = -2.0 * qc @ rc.T
    d2 += qn[:, None]
    d2 += rn
    if exclude_self:
        d2[qid[:, None] == rid[None, :]] = np.inf
    kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
    slack = 8 * (qv.shape[1] + 4) * np.finfo(np.float64).eps * (qn + rn.max() + (qv * qv).sum(1) + r_most)
    row, col = np.nonzero((d2 <= (kth + slack)[:, None]) & np.isfinite(d2))
    dist = np.concatenate([np.sqrt(((qv[row[i:i + 65536]] - rv[col[i:i + 65536]]) ** 2).sum(-1))
                           for i in range(0, len(row), 65536)] or [np.zeros(0)])
    order = np.lexsort((rid[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], dist[keep], col[keep]


def _block_nearest(qv: np.ndarray, qid: np.ndarray, rv: np.ndarray, rid: np.ndarray, k: int, exclude_self: bool):
    """:func:`_nearest` over a block of queries, about PAIRS distances at a time."""
    mid = rv.mean(0)
    rc = rv - mid
    known = mid, rc, (rc * rc).sum(1), (rv * rv).sum(1).max()
    tile = max(1, min(512, PAIRS // len(rv)))
    for i in range(0, len(qv), tile):
        row, dist, col = _nearest(qv[i:i + tile], qid[i:i + tile], rv, rid, k, exclude_self, *known)
        yield i + row, dist, col


def _meet(q: DataFrame, r: DataFrame, on: list[str], k: int, exclude_self: bool) -> DataFrame:
    """(qid, qh, dist, rid, rlabel): for each query its k nearest in every group
    of ``on``.  Repeated query rows (equal qid and qh) are asked once."""
    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a = a[~a.duplicated(["qid", "qh"])]
            vec = lambda c: np.stack(c.map(lambda x: np.asarray(x, np.float64)).to_numpy())
            qv, rv, qid, rid = vec(a["qv"]), vec(b["rv"]), a["qid"].to_numpy(np.int64), b["rid"].to_numpy(np.int64)
            for row, dist, col in _block_nearest(qv, qid, rv, rid, k, exclude_self):
                out.append(pd.DataFrame({"qid": qid[row], "qh": a["qh"].to_numpy()[row], "dist": dist, "rid": rid[col], "rlabel": b["rlabel"].to_numpy()[col]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("qid", "qh", "dist", "rid", "rlabel")})

    other = r.withColumnsRenamed({c: f"_r{c}" for c in on})
    return q.groupBy(*on).cogroup(other.groupBy(*(f"_r{c}" for c in on))).applyInPandas(run, _FOUND)


def _sides(queries: DataFrame, refs: DataFrame, id_col: str, vec_col: str, ref_label: str | None, within: str | None):
    group = [F.col(within).alias("_in")] if within else []
    label = F.col(ref_label).cast("long") if ref_label else F.lit(None).cast("long")
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).alias("qv"),
                                                         F.xxhash64(vec_col, *([within] if within else [])).alias("qh"), *group)
    r = refs.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("rid"), F.col(vec_col).alias("rv"),
                                                      label.alias("rlabel"), *group)
    return q, r


def _merged(queries: DataFrame, found: DataFrame, k: int, id_col: str, ref_label: str | None, apart: bool) -> DataFrame:
    """Every query with its k best of ``found`` as arrays.  ``apart``: no reference
    row came from two blocks, so the k nearest rows of each query row are taken first,
    repeated ones counted, whatever the number of blocks."""
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    # one shuffle serves the distinct pairs, the ranks and the lists
    found = found.repartition("qid")
    if apart:
        own = Window.partitionBy("qid", "qh").orderBy("dist", "rid")
        found = found.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= k)
    best = found.dropDuplicates(["qid", "rid"]).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    best = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_rank", "rid", "dist", "rlabel"))).alias("_nn"))
    nn = F.coalesce("_nn", F.array().cast(best.schema["_nn"].dataType))
    out = [nn["rid"].alias("nn_ids"), nn["dist"].alias("nn_dist")] + ([nn["rlabel"].alias("nn_labels")] if ref_label else [])
    return queries.join(best, F.col(id_col).cast("long") == F.col("qid"), "left").select(id_col, *out)


def _most(df: DataFrame, within: str | None) -> tuple[int, int]:
    """Rows of the largest class, and the classes (one without ``within``)."""
    if not within:
        return df.count(), 1
    n = df.groupBy("_in").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    return n[0] or 0, n[1] or 1


def _grid(q_rows: int, r_rows: int, block: int, wanted: int) -> tuple[int, int]:
    """Query and reference blocks: as many as their largest sizes ask for, then
    the larger blocks are cut on until ``wanted`` pairs of blocks meet."""
    q, r = max(1, math.ceil(q_rows / QUERY_BLOCK)), max(1, math.ceil(r_rows / block))
    while q * r < wanted and max(q_rows / q, r_rows / r) > LEAST_BLOCK:
        if q_rows / q >= r_rows / r:
            q += 1
        else:
            r += 1
    return q, r


def knn(queries: DataFrame, refs: DataFrame, k: int, id_col: str, vec_col: str, ref_label: str | None = None,
        within: str | None = None, exclude_self: bool = True, block: int = REF_BLOCK) -> DataFrame:
    """Exact Euclidean kNN: for each query row, arrays ``nn_ids``, ``nn_dist``
    (ascending, ties by id) and ``nn_labels`` of its k nearest reference rows, of
    its own class only with ``within`` (J8, J9).  Ids tell rows apart; rows without
    a vector have no neighbours and are none."""
    q, r = _sides(queries, refs, id_col, vec_col, ref_label, within)
    (q_rows, classes), (r_rows, _) = _most(q, within), _most(r, within)
    cores = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks, r_blocks = _grid(q_rows, r_rows, block, math.ceil(cores / classes))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("_qb", deal("qid", q_blocks)).withColumn("_rb", every(r_blocks))
    r = r.withColumn("_rb", deal("rid", r_blocks)).withColumn("_qb", every(q_blocks))
    found = _meet(q, r, ["_qb", "_rb", *(["_in"] if within else [])], k, exclude_self)
    return _merged(queries, found, k, id_col, ref_label, apart=True)


def lsh_knn(queries: DataFrame, refs: DataFrame, k: int, id_col: str, vec_col: str, dim: int, ref_label: str | None = None,
            exclude_self: bool = True, limit: int = 1_000_000, recall: float = 0.9, planes: int | None = None,
            tables: int = 4, most_tables: int = 32, audit: int = 200, seed: int = 42, report: dict | None = None) -> DataFrame:
    """kNN by random projections where the pairs would be too many.

    Below ``limit`` reference rows the result is exact.  Above it a row has one
    bucket a table, the signs of ``planes`` random projections of the centred
    vector, and a query also looks into the buckets of its least certain signs.
    Large buckets are cut into blocks.  About ``audit`` hashed queries are
    measured against every row; ``tables`` doubles until their recall is reached,
    beyond ``most_tables`` the exact result is returned.  ``report`` receives
    recall and tables."""
    n = refs.count()
    report = {} if report is None else report
    if n <= limit:
        report.update(recall=1.0, tables=0)
        return knn(queries, refs, k, id_col, vec_col, ref_label, None, exclude_self)
    planes = planes or max(4, int(math.log2(max(n / 2_000, 2))))
    q, r = _sides(queries, refs, id_col, vec_col, ref_label, None)
    n_queries = q.count()
    centre = np.array(r.agg(*(F.avg(F.col("rv")[i]) for i in range(dim))).first(), float)
    tested = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), F.lit(max(1, n_queries // audit))) == 0
    sample = queries.where(tested)
    truth = knn(sample, refs, k, id_col, vec_col, None, None, exclude_self).select(id_col, F.col("nn_ids").alias("_true"))
    truth = truth.checkpoint()
    while tables <= most_tables:
        w = np.random.default_rng(seed).normal(size=(tables, planes, dim))

        def places(vecs: pd.Series, probes: int, w=w, tables=tables) -> pd.Series:
            x = np.stack(vecs.map(lambda v: np.asarray(v, np.float64)).to_numpy()) - centre
            out = [[] for _ in range(len(x))]
            for t in range(tables):
                p = x @ w[t].T
                code = (p > 0) @ (1 << np.arange(planes))
                weak = np.argsort(np.abs(p), axis=1)[:, :probes]
                for i in range(len(x)):
                    out[i] += [t << 32 | int(code[i]), *(t << 32 | int(code[i] ^ (1 << b)) for b in weak[i])]
            return pd.Series(out)

        @F.pandas_udf("array<long>")
        def own(v: pd.Series) -> pd.Series:
            return places(v, 0)

        @F.pandas_udf("array<long>")
        def wide(v: pd.Series) -> pd.Series:
            return places(v, planes)

        held = r.withColumn("_b", F.explode(own("rv")))
        sizes = held.groupBy("_b").agg(F.ceil(F.count("*") / REF_BLOCK).cast("int").alias("_cuts"))
        held = held.join(sizes, "_b").withColumn("_cut", F.pmod(F.xxhash64("rid"), F.col("_cuts")).cast("int")).drop("_cuts")
        asked = q.withColumn("_b", F.explode(wide("qv"))).join(sizes, "_b").withColumn(
            "_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")
        asked = asked.withColumn("_part", F.pmod(F.xxhash64("qid"), F.lit(max(1, math.ceil(n_queries / QUERY_BLOCK)))).cast("int"))
        parts = max(1, math.ceil(n_queries / QUERY_BLOCK))
        held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else held.withColumn("_part", F.lit(0))
        got = _merged(queries, _meet(asked, held, ["_b", "_cut", "_part"], k, exclude_self), k, id_col, ref_label, apart=False).checkpoint()
        seen = got.join(truth, id_col).agg(
            F.sum(F.size(F.array_intersect("nn_ids", "_true"))).alias("found"), F.sum(F.size("_true")).alias("all")).first()
        report.update(recall=1.0 if not seen["all"] else seen["found"] / seen["all"], tables=tables)
        if report["recall"] >= recall:
            return got
        tables *= 2
    report.update(recall=1.0, tables=0)
    return knn(queries, refs, k, id_col, vec_col, ref_label, None, exclude_self)


def neighbour_vote(nn: DataFrame) -> DataFrame:
    """Distance-weighted vote of the neighbour labels (weight 1/d; when some
    neighbours are at distance 0 only they vote), ties -> smallest label (J9)."""
    z = F.exists("nn_dist", lambda d: d == 0)
    pairs = F.arrays_zip(F.col("nn_labels").alias("l"), F.col("nn_dist").alias("d"))
    x = nn.select("*", F.explode(pairs).alias("_p"))
    wt = F.when(z, F.when(F.col("_p.d") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("_p.d"))
    keys = [c for c in nn.columns if c not in ("nn_ids", "nn_dist", "nn_labels")]
    g = x.groupBy(*keys, F.col("_p.l").alias("cand")).agg(F.sum(wt).alias("w"))
    w = Window.partitionBy(*keys).orderBy(F.col("w").desc(), F.col("cand"))
    return g.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        *keys, F.col("cand").alias("pred_label"), F.col("w").alias("vote_weight"))


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, targets: dict, k: int = 3,
          seed: int = 42) -> DataFrame:
    """Oversample classes up to ``targets[label]`` rows with SMOTE (O9):
    synthetic = base + u * (neighbour - base), base uniform over the class,
    neighbour uniform over its k nearest in-class rows, u ~ U(0, 1); all
    random draws are seeded hashes, so the result is repeatable.  Returns the
    original rows plus synthetic rows (``synthetic`` = true)."""
    spark = df.sparkSession
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    need = {c: int(t) - counts.get(c, 0) for c, t in targets.items() if int(t) > counts.get(c, 0) and counts.get(c, 0) > 1}
    base = df.select(id_col, vec_col, label).withColumn("synthetic", F.lit(False))
    if not need:
        return base
    minority = df.filter(F.col(label).isin(*need.keys())).select(id_col, vec_col, label)
    nn = knn(minority, minority, k, id_col, vec_col, within=label)
    from vigil.operators.chunking import add_sequence
    from vigil.operators.timeline import Timeline
    ranked = add_sequence(minority, Timeline(run=label, order=(id_col,)), bucket_s=65536.0, out="_rank").join(nn, id_col)
    from vigil.functions.dims import literal_table
    plan = literal_table(spark, [(int(c), int(n), int(counts[c])) for c, n in need.items()],
                         "cls long, n_new long, n_c long")
    gen = plan.select("cls", "n_c", F.explode(F.sequence(F.lit(0), F.col("n_new") - 1)).alias("sid"))
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("cls"), F.col("sid"))
    gen = gen.select(F.col("cls").cast(df.schema[label].dataType).alias(label), "sid",
                     F.pmod(h("base"), F.col("n_c")).alias("_rank"),
                     F.pmod(h("nn"), F.lit(k)).cast("int").alias("_nn"),
                     (F.pmod(h("u"), F.lit(1 << 30)).cast("double") / float(1 << 30)).alias("_u"))
    g = gen.join(ranked, [label, "_rank"])
    nid = F.element_at("nn_ids", (F.pmod(F.col("_nn"), F.size("nn_ids")) + 1).cast("int"))
    g = g.withColumn("_nid", nid)
    nb = minority.select(F.col(id_col).alias("_nid"), F.col(vec_col).alias("_nv"))
    g = g.join(nb, "_nid")
    new_vec = F.zip_with(vec_col, "_nv", lambda a, b: (a + F.col("_u") * (b - a)).cast("float"))
    syn = g.select((-(F.col("sid") + 1) - F.col(label).cast("long") * 1_000_000_000).alias(id_col),
                   new_vec.alias(vec_col), label, F.lit(True).alias("synthetic"))
    return base.unionByName(syn.select(base.columns))

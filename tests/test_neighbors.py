"""Exact kNN against numpy brute force; SMOTE counts and convexity."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators.neighbors import knn, lsh_knn, smote
from vigil.session import ensure_checkpoint_dir
from vigil.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_knn_within_class_matches_brute_force(spark):
    emb = table(spark, SF, "embeddings")
    rows = emb.collect()
    nn = {r.vec_id: r.nn_ids for r in knn(emb, emb, 3, "vec_id", "embedding", within="label", block=64).collect()}
    X = {r.vec_id: np.asarray(r.embedding, dtype=np.float64) for r in rows}
    lab = {r.vec_id: r.label for r in rows}
    for q in list(X)[:60]:
        cands = sorted((float(np.sqrt(((X[q] - X[o]) ** 2).sum())), o) for o in X if o != q and lab[o] == lab[q])
        assert nn[q] == [o for _, o in cands[:3]]


def test_smote_counts_and_hull(spark):
    emb = table(spark, SF, "embeddings")
    counts = {r.label: r.n for r in emb.groupBy("label").agg(F.count("*").alias("n")).collect()}
    target = max(counts.values()) + 5
    out = smote(emb, "vec_id", "embedding", "label", {c: target for c in counts}, k=3)
    got = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(v == target for v in got.values())
    lo = {r.label: np.asarray(r.lo) for r in emb.groupBy("label").agg(
        F.array(*[F.min(F.col("embedding")[i]) for i in range(64)]).alias("lo")).collect()}
    hi = {r.label: np.asarray(r.hi) for r in emb.groupBy("label").agg(
        F.array(*[F.max(F.col("embedding")[i]) for i in range(64)]).alias("hi")).collect()}
    for r in out.filter("synthetic").collect():
        v = np.asarray(r.embedding)
        assert (v >= lo[r.label] - 1e-6).all() and (v <= hi[r.label] + 1e-6).all()


def _clouds(spark, n=1500, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, dim))[rng.integers(0, 30, n)] * 3 + rng.normal(size=(n, dim)) * 0.4
    x[700:800] = x[5]                                    # a group of copies
    return x, spark.createDataFrame([(i, [float(v) for v in x[i]], int(i % 3)) for i in range(n)] + [(n, None, 1)],
                                    "vec_id long, embedding array<double>, label int")


def test_blocks_and_rows_without_vector(spark, monkeypatch):
    import vigil.operators.neighbors as N
    x, df = _clouds(spark, 400)
    monkeypatch.setattr(N, "QUERY_BLOCK", 90)
    got = {r.vec_id: (r.nn_ids, r.nn_labels) for r in knn(df.where("vec_id >= 395"), df, 4, "vec_id", "embedding", ref_label="label",
                                                          block=70).collect()}
    assert got[400] == ([], [])
    for q in range(395, 400):
        order = sorted((float(np.sqrt(((x[q] - x[o]) ** 2).sum())), o) for o in range(400) if o != q)[:4]
        assert got[q] == ([o for _, o in order], [o % 3 for _, o in order])


def test_lsh_reaches_its_recall_or_is_exact(spark):
    ensure_checkpoint_dir(spark)
    x, df = _clouds(spark)
    report = {}
    got = {r.vec_id: r.nn_ids for r in lsh_knn(df, df, 5, "vec_id", "embedding", 12, limit=100, planes=5, audit=60, report=report).collect()}
    assert len(got) == 1501 and report["recall"] >= 0.9 and report["tables"] >= 4
    hits = 0
    for q in range(0, 1500, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), d))[:5].tolist()) & set(got[q]))
    assert hits >= 0.85 * 5 * 150
    exact = {r.vec_id: r.nn_ids for r in lsh_knn(df.limit(300), df, 5, "vec_id", "embedding", 12, limit=100, planes=14, tables=1,
                                                 most_tables=1, recall=1.01, report=report).collect()}
    assert report["tables"] == 0 and len(exact) == 300


def test_a_task_holds_few_distances():
    import tracemalloc

    import vigil.operators.neighbors as N
    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(600, 8)), rng.normal(size=(N.REF_BLOCK, 8))
    ids = np.arange(N.REF_BLOCK)
    tracemalloc.start()
    found = list(N._block_nearest(q, ids[:600], r, ids, 3, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6                                  # the block of all distances alone would be 157 MB
    row, col = (np.concatenate([f[i] for f in found]) for i in (0, 2))
    assert row.tolist() == np.repeat(np.arange(600), 3).tolist()
    for i in range(0, 600, 97):
        assert col[row == i].tolist() == np.argsort(((r - q[i]) ** 2).sum(1))[:3].tolist()


def test_blocks_send_rows_few_times():
    import vigil.operators.neighbors as N
    for n in (20_000, 120_000, 300_000):
        q, r = N._grid(n, n, N.REF_BLOCK, 200)
        assert q * r >= 200 and q + r <= 30              # one side cut for all cores: 200 times the other
    assert N._grid(30_000, 30_000, N.REF_BLOCK, 20) == (5, 4)
    assert N._grid(100, 40, N.REF_BLOCK, 200) == (1, 1)
    q, r = N._grid(10_000_000, 50_000, N.REF_BLOCK, 200)
    assert 10_000_000 / q <= N.QUERY_BLOCK and 50_000 / r <= N.REF_BLOCK


def test_repeated_rows_do_not_depend_on_blocks(spark):
    """The k nearest rows count, repeated ones too, however many blocks there are."""
    x, df = _clouds(spark, 300)
    twice = df.unionByName(df.where("vec_id % 3 = 0"))
    got = [{r.vec_id: r.nn_ids for r in knn(twice.where("vec_id < 40"), twice, 4, "vec_id", "embedding", block=b).collect()} for b in (1000, 30)]
    assert got[0] == got[1] and len(got[0]) == 40
    for q in range(40):
        d = sorted((float(np.sqrt(((x[q] - x[o]) ** 2).sum())), o) for o in range(300) for _ in range(2 if o % 3 == 0 else 1) if o != q)[:4]
        assert got[0][q] == list(dict.fromkeys(o for _, o in d))

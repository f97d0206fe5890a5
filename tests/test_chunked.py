"""Chunk + halo execution equals the plain per-run windows."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import chunking as CH
from vigil.operators import features as X
from vigil.operators.timeline import Timeline

TL = Timeline(run="run", order=("t", "i"), t="t", label="y")


@pytest.fixture(scope="module")
def runs(spark):
    rnd = random.Random(3)
    rows = []
    for run, n in [(1, 700), (2, 45), (3, 260)]:
        t = 0.0
        for i in range(n):
            t += rnd.choice([0.0, 0.2, 0.2, 0.4, 7.0])
            x = None if rnd.random() < 0.05 else round(rnd.gauss(50, 10), 2)
            rows.append((run, i, t, x, rnd.choice([0, 0, 1])))
    return spark.createDataFrame(rows, "run int, i int, t double, x double, y int")


def same(a, b, cols):
    ka = sorted(tuple(r) for r in a.select("run", "i", *cols).collect())
    kb = sorted(tuple(r) for r in b.select("run", "i", *cols).collect())
    assert len(ka) == len(kb)
    for ra, rb in zip(ka, kb):
        for u, v in zip(ra, rb):
            if u is None or v is None:
                assert u is None and v is None, (ra, rb)
            else:
                assert u == pytest.approx(v, rel=1e-9, abs=1e-9), (ra, rb)


def test_sequence_positions(spark, runs):
    seqd = CH.add_sequence(runs, TL, bucket_s=5.0)
    got = sorted((r.run, r.i, r._seq) for r in seqd.collect())
    assert all(i == s for _, i, s in got)


def test_bounded_features_chunked(spark, runs):
    def fn(df, tl):
        return X.build(df, [c for c in df.columns], X.rate_accel("x", tl), X.rolling_full("x", tl, 30),
                       X.prior_iqr_distance("x", tl), X.pct_change("x", tl))
    plain = fn(runs, TL)
    ch = CH.chunked(runs, TL, fn, back=30, chunk_rows=64, bucket_s=3.0, force=True)
    cols = ["x_rate", "x_accel", "x_mean_30s", "x_std_30s", "x_outlier_dist", "x_pct_change"]
    same(plain, ch, cols)


def test_family_b_chunked(spark, runs):
    plain = X.family_b(runs, TL, ["x"], keep=["run", "i"], force_chunks=False)
    ch = X.family_b(runs, TL, ["x"], keep=["run", "i"], chunk_rows=64, force_chunks=True)
    same(plain, ch, [c for c in plain.columns if c not in ("run", "i")])


def test_needs_chunking(spark, runs):
    assert CH.needs_chunking(runs, TL, 500)
    assert not CH.needs_chunking(runs, TL, 1000)
    _ = F


def test_chunk_mode_setting(spark, runs):
    try:
        spark.conf.set("vigil.window.chunkMode", "never")
        assert not CH.needs_chunking(runs, TL, 10)
        spark.conf.set("vigil.window.chunkMode", "always")
        assert CH.needs_chunking(runs, TL, 10_000)
    finally:
        spark.conf.unset("vigil.window.chunkMode")
    assert CH.needs_chunking(runs, TL, 10) and not CH.needs_chunking(runs, TL, 10_000)


def test_ship_package_idempotent(spark):
    from vigil.session import _SHIPPED, ship_package
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext.applicationId in _SHIPPED


NULLS = [(None, 1, 5.0, 1.0, 0), (None, 2, 6.0, 2.0, 1), (None, 3, None, 3.0, 1), (7, 4, None, 4.0, 0), (7, 5, 2.0, 5.0, 0),
         (7, 6, 3.0, None, 1), (7, 7, 9000.0, 6.0, 1), (8, 8, 1.0, 7.0, None), (8, 9, 4.0, 8.0, None)]


@pytest.mark.parametrize("force", [False, True])
def test_rows_without_run_time_or_class_stay(spark, force):
    """Null runs, times and classes are groups like any other, cut or whole."""
    from vigil.operators import labels as L
    from vigil.operators import splits as SP
    df = spark.createDataFrame(NULLS, "run int, i int, t double, x double, y int")
    spark.conf.set(CH.CHUNK_ROWS_CONF, "2")
    try:
        seg = L.add_segment_id(df, TL, force_chunks=force)
        assert sorted(r.i for r in seg.collect()) == list(range(1, 10))
        got = {r.i: r.segment for r in seg.collect()}
        want = {r.i: r.segment for r in L.add_segment_id(df, TL, force_chunks=False).collect()}
        assert got == want
    finally:
        spark.conf.unset(CH.CHUNK_ROWS_CONF)
    assert SP.chrono_split(df, TL).count() == 9
    assert SP.stratified_split(df, "y", ["i"]).count() == 9
    assert SP.stratified_sample(df, "y", ["i"], 9).count() == 9

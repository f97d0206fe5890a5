"""Cases that once gave wrong or short answers."""

import json
import random

import numpy as np

from vigil.operators import folds as FD
from vigil.operators import labels as L
from vigil.operators import neighbors as NB
from vigil.operators import profile as PR
from vigil.operators.timeline import Timeline


def test_cooldown_paths_agree_on_tenths(spark):
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 1, 1, 2, 3])
        rows.append((None if i % 2 else 1, i, t / 10))
    df = spark.createDataFrame(rows, "k int, i int, t double")
    want = set()
    for key in (None, 1):
        last = None
        for k, i, s in rows:
            if k == key and (last is None or round(s * 10) - last >= 7):
                want.add(i)
                last = round(s * 10)
    for long_rows in (10_000, 6):
        got = FD.alert_dedup(df, ["k"], ["t", "i"], "t", 0.7, long_burst_rows=long_rows)
        assert got.columns == ["k", "i", "t", "fired"] and got.count() == 400
        if long_rows == 10_000:
            assert {r.i for r in got.filter("fired").collect()} == want
        else:
            keyed = FD.alert_dedup(df.na.fill(0, ["k"]), ["k"], ["t", "i"], "t", 0.7, long_burst_rows=long_rows)
            assert {r.i for r in keyed.filter("fired").collect()} == want


def test_rule_check_equals_fold(spark):
    rng = random.Random(2)
    vals = [rng.choice([None, -5.0, 500.0, 10.0, 11.0, 12.5, 30.0, 31.0, 50.0]) for _ in range(300)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k int, i int, x double")
    got = {r.i: r.reason for r in FD.last_valid_rule_check(df, ["k"], ["i"], "x", 0.0, 100.0, 5.0).collect()}
    last = None
    for i, v in enumerate(vals):
        why = ("null" if v is None else "low" if v < 0 else "high" if v > 100
               else "jump" if last is not None and abs(v - last) > 5 else None)
        last = v if why is None else last
        assert got[i] == why, i


def test_overlapping_intervals(spark):
    iv = [(1, 0, 100, 1), (1, 10, 20, 2), (1, 15, 18, 3), (1, 100, 110, 4), (1, 200, 210, 5), (None, 0, 5, 6), (1, 10, 20, 7)]
    rd = [(1, t, t) for t in range(0, 220, 3)] + [(None, 3, 900), (None, 7, 901)]
    got = L.interval_label(spark.createDataFrame(rd, "run int, t int, i int"), spark.createDataFrame(
        iv, "run int, s int, e int, id int"), Timeline(run="run", order=("t", "i"), t="t"), "s", "e", "id").collect()
    assert len(got) == len(rd)
    for r in got:
        cover = [(s, i) for k, s, e, i in iv if k == r.run and s <= r.t < e]
        assert r.interval_id == (max(cover)[1] if cover else None), r


def test_knn_ties_and_offsets(spark):
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 2, (300, 4)).astype(float), 1e7 + rng.normal(size=(200, 8))):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for r in NB.knn(df, df, 5, "id", "v", block=64).collect():
            assert list(r.nn_ids) == sorted(range(len(x)), key=lambda j: (d[r.id, j], j))[:5]


def test_profile_json_and_degenerate_fit(spark):
    df = spark.createDataFrame([('a"b',), ("c",), ("c",), (None,)], "v string")
    assert json.loads(PR.categorical_profile(df, ["v"]).first().value_counts) == {'a"b': 1, "c": 2}
    pts = [(1, 800.0 + i, 5 + 3 * np.exp(-(800.0 + i) / 300)) for i in range(60)]
    fit = PR.exp_fit(spark.createDataFrame([(g, float(t), float(x)) for g, t, x in pts], "g int, t double, x double"),
                     ["g"], "t", "x").first()
    assert fit.start is not None and fit.target is not None and fit.tau > 1

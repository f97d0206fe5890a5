"""The last-valid rule on runs cut into segments equals the plain scan."""

import numpy as np
import pytest

from vigil.operators import folds as FD


def _plain(values, limit):
    last, out = None, []
    for v in values:
        ok = last is None or abs(v - last) <= limit
        last = v if ok else last
        out.append(ok)
    return out, last


def _series(kind, rng, n):
    if kind == "walk":
        return np.cumsum(rng.normal(0, 1, n))
    if kind == "shift":                                   # a sensor that settles elsewhere: all jumps from there on
        return np.where(np.arange(n) < n // 3, 10.0, 50.0) + rng.normal(0, 0.3, n)
    if kind == "grid":                                    # differences on the limit itself
        return np.round(rng.integers(0, 80, n) * 0.1, 1)
    return rng.uniform(-100, 100, n)


@pytest.mark.parametrize("kind", ["walk", "shift", "grid", "wild"])
def test_summary_is_the_scan(kind):
    rng = np.random.default_rng(8)
    for limit in (0.0, 0.5, 2.0):
        val = _series(kind, rng, 700)
        low, high, leave, fresh = FD.rule_summary(val, limit)
        assert fresh == _plain(val, limit)[1]
        assert (low[1:] > high[:-1]).all()
        tries = np.concatenate([val, val + limit, val - limit, rng.uniform(val.min() - 3, val.max() + 3, 200), low, high])
        for entry in tries[:: max(1, len(tries) // 300)]:
            near = [v for v in val if abs(v - entry) <= limit]
            want = entry
            if near:
                i = next(i for i, v in enumerate(val) if abs(v - entry) <= limit)
                want = _plain(val[i:], limit)[1]
            assert FD._through(float(entry), low, high, leave, fresh) == want


@pytest.mark.parametrize("kind", ["walk", "shift", "grid"])
def test_cut_runs_equal_whole_runs(spark, kind):
    rng = np.random.default_rng(9)
    rows = [(r, i, None if i % 41 == 7 else float(v)) for r in (1, 2, None) for i, v in enumerate(_series(kind, rng, 400))]
    df = spark.createDataFrame(rows, "run int, i long, x double")
    args = (["run"], ["i"], "x", -40.0, 60.0, 0.5)
    whole = FD.last_valid_rule_check(df, *args)
    cut = FD.last_valid_rule_check(df, *args, segment=17)
    key = lambda r: (r.run is None, r.run or 0, r.i)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
    for run in (1, 2, None):
        mine = sorted((r for r in cut.collect() if r.run == run), key=key)
        fine = [r for r in mine if r.reason in (None, "jump")]
        assert [r.valid for r in fine] == _plain([r.x for r in fine], 0.5)[0]

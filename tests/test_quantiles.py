"""Range-refinement quantiles equal numpy's linear quantiles."""

import numpy as np
import pytest

from vigil.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("force", [False, True])
def test_exact_quantiles(spark, force):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in [(1, 3000), (2, 7), (3, 1)]:
        vals = np.concatenate([rng.lognormal(0, 2, n - n // 3), np.full(n // 3, 4.25)])
        rows += [(g, float(v), float(np.round(v, 1))) for v in vals]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = exact_quantiles(df, ["x", "y"], probs, ["g"], bins=8, small=50, force_refine=force)
    got = {(r.g, r.column, r.p): r.value for r in out.collect()}
    for g in (1, 2, 3):
        for c, i in (("x", 1), ("y", 2)):
            v = np.array([r[i] for r in rows if r[0] == g])
            for p in probs:
                assert got[(g, c, p)] == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-12)

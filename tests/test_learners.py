"""Boosting, kernel machine and isolation forest against SQL from their written models."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import boosting as BO
from vigil.operators import isolation as ISO
from vigil.operators import kernel as KE
from vigil.operators import models as MD
from vigil.operators import passes


@pytest.fixture(scope="module")
def rings(spark):
    """Three classes by distance from the origin: no plane parts them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    y = np.digitize(np.linalg.norm(x[:, :2], axis=1), [0.8, 1.6])
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").checkpoint()


def _tree_sql(table: str, n: int) -> str:
    return f"""WITH RECURSIVE w AS (
      SELECT id, t.round, t.class, 0 AS node, a, b, c FROM x, (SELECT DISTINCT round, class FROM {table} WHERE round >= 0) t
      UNION ALL SELECT id, w.round, w.class, 2 * w.node + 1 + CAST(CASE n.feature WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END > n.threshold AS INT), a, b, c
      FROM w JOIN {table} n ON n.round = w.round AND n.class = w.class AND n.node = w.node WHERE n.feature IS NOT NULL),
    m AS (SELECT id, w.class, sum(n.value) AS m FROM w JOIN {table} n ON n.round = w.round AND n.class = w.class AND n.node = w.node
          WHERE n.feature IS NULL GROUP BY id, w.class),
    z AS (SELECT id, m.class, exp(m + b.value) AS e FROM m JOIN {table} b ON b.round = -1 AND b.class = m.class)
    SELECT id, list(e / s ORDER BY class) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY id) AS s FROM z) GROUP BY id ORDER BY id"""


def test_boosting_scores_by_sql(spark, rings):
    model = BO.fit(rings, ["a", "b", "c"], "label", 3, rounds=12, depth=3, keep_every=5)
    got = BO.predict(rings, model).select("id", "label", "probabilities").orderBy("id").toPandas()
    p = np.stack(got["probabilities"].to_numpy())
    assert np.allclose(p.sum(1), 1)
    assert (p.argmax(1) == got["label"]).mean() > 0.9
    x, trees = rings.toPandas(), model.table(spark).toPandas()
    con = duckdb.connect()
    con.register("x", x)
    con.register("trees", trees)
    want = np.array([r[1] for r in con.execute(_tree_sql("trees", 3)).fetchall()])
    assert np.allclose(p, want, atol=1e-9)


def test_boosting_weights_nulls_and_one_class(spark, rings):
    df = rings.withColumn("w", F.when(F.col("label") == 0, 5.0).otherwise(1.0)).withColumn(
        "label", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("label")))
    model = BO.fit(df, ["a", "b"], "label", 3, rounds=3, depth=2, weight="w")
    assert BO.predict(df, model).where(F.size("probabilities") == 3).count() == 1500
    one = BO.fit(rings.where("label = 1"), ["a"], "label", 3, rounds=2, depth=2)
    assert BO.predict(rings.limit(5), one).where(F.col("probabilities")[1] > 0.99).count() == 5
    with pytest.raises(ValueError):
        BO.fit(rings.limit(0), ["a"], "label", 2)


def test_kernel_machine(spark, rings):
    binary = rings.withColumn("label", (F.col("label") > 0).cast("int"))
    model = KE.fit(binary, ["a", "b", "c"], "label", 2, columns=200, steps=25)
    got = KE.predict(binary, model).select("id", "label", "scores").orderBy("id").toPandas()
    s = np.stack(got["scores"].to_numpy())
    right = (s.argmax(1) == got["label"]).mean()
    svm = MD.linear_svm(["a", "b", "c"]).fit(MD.with_weights(MD.prepare(binary, ["a", "b", "c"], "label", ["id"])))
    plain = svm.transform(MD.prepare(binary, ["a", "b", "c"], "label", ["id"])).where("prediction = label").count() / 1500
    assert right > 0.93 > plain + 0.1
    con = duckdb.connect()
    con.register("x", rings.toPandas())
    con.execute("CREATE TABLE col (j INT, wa DOUBLE, wb DOUBLE, wc DOUBLE, b DOUBLE, c0 DOUBLE, c1 DOUBLE)")
    scaled = model.w / model.scale[:, None]
    offset = model.b - model.mean @ scaled
    con.executemany("INSERT INTO col VALUES (?, ?, ?, ?, ?, ?, ?)", [
        (j, *map(float, scaled[:, j]), float(offset[j]), *map(float, model.weights[j])) for j in range(200)])
    want = np.array(con.execute(f"""SELECT sum(z * c0) + {model.weights[-1, 0]}, sum(z * c1) + {model.weights[-1, 1]} FROM (
        SELECT id, sqrt(2 / 200.0) * cos(a * wa + x.b * wb + x.c * wc + col.b) AS z, c0, c1 FROM x, col) GROUP BY id ORDER BY id""").fetchall())
    assert np.allclose(s, want, atol=1e-9)


def test_forest_paths_by_sql(spark, rings):
    odd = spark.createDataFrame([(9000, 9.0, -9.0, 9.0, 0)], rings.schema)
    df = rings.unionByName(odd)
    forest = ISO.grow(df, ["a", "b", "c"], "id", trees=40, rows=64, seed=7)
    got = ISO.score(df, forest, ["a", "b", "c"], rows=64).select("id", "anomaly").orderBy("id").toPandas()
    assert got.iloc[-1]["id"] == 9000 and got["anomaly"].idxmax() == len(got) - 1 and got["anomaly"].iloc[-1] > 0.6
    con = duckdb.connect()
    con.register("x", df.toPandas())
    con.register("n", forest.toPandas())
    c = lambda v: f"(CASE WHEN {v} > 2 THEN 2 * (ln({v} - 1) + {ISO.EULER}) - 2 * ({v} - 1) / {v} WHEN {v} = 2 THEN 1.0 ELSE 0.0 END)"
    want = con.execute(f"""WITH RECURSIVE w AS (SELECT id, tree, CAST(1 AS BIGINT) AS node, 0 AS d, [a, b, c] AS f FROM x, (SELECT DISTINCT tree FROM n)
      UNION ALL SELECT id, w.tree, 2 * w.node + CAST(w.f[CAST(n.feature AS BIGINT) + 1] >= n.threshold AS INT), d + 1, w.f
      FROM w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE n.feature IS NOT NULL)
      SELECT pow(2, -avg(d + {c('n.size')}) / {c('64.0')}) FROM w JOIN n ON n.tree = w.tree AND n.node = w.node
      WHERE n.feature IS NULL GROUP BY id ORDER BY id""").fetchall()
    assert np.allclose(got["anomaly"], [r[0] for r in want], atol=1e-9)
    sizes = forest.where("node = 1").select("size").distinct().collect()
    assert [r[0] for r in sizes] == [64]
    few = ISO.grow(df.limit(1), ["a", "b", "c"], "id", trees=3, rows=64)
    assert few.count() == 3 and ISO.score(df, few, ["a", "b", "c"]).where("anomaly = 1").count() == df.count()


def test_totals_add_up_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(passes, "FAN_IN", 3)
    df = spark.range(1000).repartition(23).checkpoint()
    got = passes.total(df, lambda pdf: np.array([len(pdf), pdf["id"].sum()], float), 2)
    assert got.tolist() == [1000, 499500]


def test_a_pass_is_one_job(spark):
    """All tasks of a pass run together, not a partition at a time."""
    df, sc = spark.range(1000).repartition(23).checkpoint(), spark.sparkContext
    sc.setJobGroup("one-pass", "a pass")
    try:
        got = passes.total(df, lambda pdf: np.array([len(pdf)], float), 1)
        jobs = sc.statusTracker().getJobIdsForGroup("one-pass")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got.tolist() == [1000] and len(jobs) == 1


def test_boosting_leaves_without_a_pass(spark, rings, monkeypatch):
    """A round takes one pass a level; its leaves hold the sums of the rows they got."""
    calls = []
    monkeypatch.setattr(BO, "total", lambda *a: calls.append(1) or passes.total(*a))
    model = BO.fit(rings, ["a", "b", "c"], "label", 3, rounds=2, depth=3, keep_every=1, rate=0.3, smooth=1.5)
    assert len(calls) == 2 * 3
    pdf = rings.toPandas()
    x, y = model.binned(pdf[["a", "b", "c"]].to_numpy()), pdf["label"].to_numpy()
    margin = model.margins(x)
    for r in (0, 1):
        before = BO.Booster(model.features, model.cuts, 3, 3, model.base, model.feature[:r], model.bin[:r], model.value[:r]).margins(x)
        p = BO.softmax(before)
        node = model.places(x, model.feature[r], model.bin[r])
        for k in range(3):
            for leaf in np.unique(node[k]):
                at = node[k] == leaf
                want = -0.3 * (p[k] - (y == k))[at].sum() / ((p[k] * (1 - p[k]))[at].sum() + 1.5)
                assert abs(model.value[r][k, leaf] - want) < 1e-9
    assert (margin.argmax(0) == y).mean() > 0.6

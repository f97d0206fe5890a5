"""MLlib fit/score paths on a small feature table."""

import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.operators import models as MD
from vigil.plans.q_models import FEATURES, feature_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ft(spark):
    return feature_table(spark, SF).cache()


def test_rf_and_importance(spark, ft):
    m = MD.random_forest(FEATURES, num_trees=5, max_depth=4).fit(MD.with_weights(ft.filter("is_train")))
    rep = MD.evaluate(m.transform(ft.filter("NOT is_train")))
    assert rep.filter("row = 'accuracy'").count() == 1
    imp = MD.feature_importance(m, FEATURES, top=3)
    assert imp.count() == 3


def test_gbt_ovr_mlp_svm(spark, ft):
    ovr = MD.boosted_trees(FEATURES, 4, max_iter=3, max_depth=2).fit(ft.filter("is_train"))
    s = ovr.transform(ft).withColumn("p", MD.ovr_probabilities(F.col("rawPrediction")))
    r = s.select(F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("s")).first().s
    assert r == pytest.approx(1.0)
    net = MD.mlp(FEATURES, 4, hidden=(8,), max_iter=10).fit(ft.filter("is_train"))
    assert net.transform(ft).count() == ft.count()
    binary = ft.withColumn("label", (F.col("label") > 0).cast("double"))
    svm = MD.linear_svm(FEATURES, weighted=True).fit(MD.with_weights(binary.filter("is_train")))
    assert svm.transform(binary).select("prediction").distinct().count() >= 1


def test_stacking_best_cascade_pca_bundle(spark, ft):
    base = {"rf": lambda f: MD.random_forest(f, num_trees=3, max_depth=3, weighted=False),
            "lr": lambda f: MD.random_forest(f, num_trees=2, max_depth=2, weighted=False)}
    train = ft.filter("is_train")
    models, meta, cols = MD.stacking(train, FEATURES, ["event_id"], base, n_classes=4, k=2)
    pred = MD.stack_predict(ft, models, meta, ["event_id"], 4)
    assert pred.count() == ft.count()
    reps = {n: MD.evaluate(m.transform(ft)) for n, m in models.items()}
    assert MD.best_model(reps) in reps
    casc = MD.cascade(ft, models["lr"], models["rf"])
    assert casc.count() == ft.count()
    pm = MD.pca_anomaly(ft.filter("label = 0"), FEATURES, k=2)
    sc = MD.pca_score(pm, ft)
    assert sc.filter(F.col("anomaly_score") < 0).count() == 0
    d = tempfile.mkdtemp(prefix="vigil-model-")
    MD.save_bundle(models["rf"], d, FEATURES, {"classes": 4})
    m2, feats, meta2 = MD.load_bundle(d)
    assert feats == FEATURES and meta2["classes"] == 4
    assert m2.transform(ft).count() == ft.count()

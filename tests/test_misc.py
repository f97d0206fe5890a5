"""Library operators without a registered driver-table query."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.functions import columns as C
from vigil.operators import features as X
from vigil.operators import labels as L
from vigil.operators import metrics as M
from vigil.operators import quality as Q
from vigil.operators.timeline import Timeline
from vigil.sources import runs as R
from vigil.sources import sinks as K

TL = Timeline(run="run", order=("i",), t="t", label="y")


def test_drop_and_dynamic_selection(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 1, 0)], "P_101 int, LIT_101 double, s string, P_2x int, y int")
    assert R.drop_if_present(df, ["s", "nope"]).columns == ["P_101", "LIT_101", "P_2x", "y"]
    assert X.feature_columns(df, exclude=("y",)) == ["P_101", "LIT_101", "P_2x"]
    assert X.feature_columns(df, prefix="P_") == ["P_101", "P_2x"]
    pumps = df.select(*[e.alias(n) for n, e in X.pumps_on(df).items()]).first()
    assert pumps.total_pumps_on == 1


def test_schema_diff():
    d = L.schema_diff({1: ["a", "b", "c"], 2: ["a", "c", "d"]})
    assert d == [(1, [], []), (2, ["d"], ["b"])]


def test_infinite_replacement(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (3.0,), (float("-inf"),), (5.0,)], "x double")
    out = [r.x for r in X.finite_features(df, ["x"]).collect()]
    assert sorted(out) == [1.0, 3.0, 3.0, 3.0, 5.0]


def test_lookback_windows_and_balance(spark):
    rows = [(1, i, float(i), float(i * i), 0, 1.0, 0.5) for i in range(12)]
    df = spark.createDataFrame(rows, "run int, i int, t double, x double, y int, fin double, fout double")
    lb = X.lookback_windows(df, TL, ["x"], length=10)
    assert lb.count() == 3 and len(lb.first().seq) == 10
    bal = X.build(df, ["i"], X.first_order_balance("x", "fin", "fout", TL)).orderBy("i").collect()
    assert bal[2].x_balance == pytest.approx((4 - 1) - 0.5)


def test_response_curves_and_checksum(spark):
    df = spark.createDataFrame([(0.0, 10.0, 2.0, 5.0), (5.0, 10.0, 2.0, 5.0)], "t double, s double, g double, tau double")
    r = df.select(C.exp_response("t", "s", "g", "tau").alias("e"),
                  C.logistic_response("t", "s", "g", "tau").alias("l")).collect()
    assert r[0].e == pytest.approx(10.0) and r[1].e == pytest.approx(2 + 8 * math.exp(-1))
    assert r[1].l == pytest.approx(10 + (2 - 10) / (1 + math.exp(-5)))
    b = spark.createDataFrame([(bytearray([200, 100, 10]),)], "b binary")
    assert b.select(C.checksum8("b").alias("c")).first().c == (310 % 256)


def test_plant_alarm_rules(spark):
    cols = ["Acid_Tank_Level", "Chlorine_Tank_Level", "Coagulant_Tank_Level", "LIT_101", "LIT_301", "LIT_401",
            "PIT_501", "AIT_202", "DPIT_301", "UF_Last_Backwash", "RO_Fouling_Factor", "RO_Last_Cleaning"]
    df = spark.createDataFrame([(10.0, 50.0, 50.0, 960.0, 500.0, 500.0, 100.0, 720.0, 10.0, 10.0, 10.0, 10.0)],
                               ", ".join(f"{c} double" for c in cols)).withColumn("High_Level_Alarm", F.lit(False))
    out = Q.rule_flags(df, Q.plant_alarm_rules(), {"High_Level": "High_Level_Alarm"}).first()
    assert out.rule_Chemical_Low and out.rule_High_Level and not out.rule_High_Pressure
    assert out.rule_System_Run is False and out.High_Level_mismatch


def test_report_writers(spark):
    d = tempfile.mkdtemp(prefix="vigil-reports-")
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    K.write_reports({"r1": df}, d)
    assert spark.read.json(os.path.join(d, "r1")).count() == 1
    K.write_features(df, os.path.join(d, "feat"), ["b"])
    assert json.loads(K.read_text(spark, os.path.join(d, "feat", "_feature_columns"))) == ["b"]
    K.write_episode_report(df, df, os.path.join(d, "ep"))
    assert spark.read.json(os.path.join(d, "ep", "totals")).count() == 1


def test_one_vs_rest_and_alignment(spark):
    df = spark.createDataFrame([([0.9, 0.1], 0), ([0.2, 0.8], 1), ([0.6, 0.4], 1), ([0.3, 0.7], 0)],
                               "p array<double>, y int")
    r = {x.cls: x.auc for x in M.one_vs_rest(df, "p", "y", [0, 1]).collect()}
    assert r[0] == pytest.approx(0.75) and r[1] == pytest.approx(0.75)
    truth = spark.createDataFrame([(1, 0), (2, 8)], "id int, y int")
    preds = spark.createDataFrame([(2, 8)], "id int, p int")
    al = {x.id: x.p for x in L.align_predictions(preds, truth, ["id"]).collect()}
    assert al == {1: None, 2: 8}


def test_batch_scoring_with_advice(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml import Pipeline
    from vigil.functions.dims import remediation_table
    from vigil.operators.models import batch_score
    df = spark.createDataFrame([(float(i), float(i % 2) * 8) for i in range(20)], "x double, label double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                         LogisticRegression()]).fit(df)
    s = batch_score(m, df, remediation=remediation_table(spark))
    assert {"class_id", "confidence", "severity"} <= set(s.columns) and s.count() == 20

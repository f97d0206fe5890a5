"""Distributed fit / score with pyspark.ml.

Features go through :func:`vigil.operators.features.align_features` (training
column order, absent/null/inf -> 0) and a ``VectorAssembler``; class weights
come from :func:`vigil.operators.metrics.add_weight_col`.  Models are
``pyspark.ml`` estimators, so training is distributed by MLlib and scoring is
a plain ``transform`` (no per-row Python).
"""

from __future__ import annotations

import json
import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.columns import is_finite
from vigil.operators.metrics import add_weight_col, class_report, confusion
from vigil.sources.sinks import read_text, write_text


def prepare(df: DataFrame, features: list[str], label: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Aligned, finite feature columns + label, ready for an assembler."""
    have = set(df.columns)
    cols = [F.col(k) for k in keep]
    for c in features:
        x = F.col(c).cast("double") if c in have else F.lit(0.0)
        cols.append(F.when(is_finite(x), x).otherwise(F.lit(0.0)).alias(c))
    if label:
        cols.append(F.col(label).cast("double").alias("label"))
    return df.select(*cols)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def random_forest(features: list[str], num_trees: int = 200, max_depth: int = 30, weighted: bool = True,
                  seed: int = 42) -> Pipeline:
    """M1: sqrt feature subsets, balanced class weights, depth capped at 30
    (MLlib's limit)."""
    kw = {"weightCol": "weight"} if weighted else {}
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=num_trees,
                                maxDepth=min(max_depth, 30), featureSubsetStrategy="sqrt", seed=seed, **kw)
    return Pipeline(stages=[assembler(features), rf])


def boosted_trees(features: list[str], n_classes: int, max_iter: int = 50, max_depth: int = 6,
                  seed: int = 42) -> Pipeline:
    """M2: gradient boosted trees; multiclass as one-vs-rest (MLlib's GBT is
    binary).  One-vs-rest gives no probability column: use
    :func:`ovr_probabilities`."""
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    est = gbt if n_classes <= 2 else OneVsRest(classifier=gbt, featuresCol="features", labelCol="label")
    return Pipeline(stages=[assembler(features), est])


def ovr_probabilities(raw: Column) -> Column:
    """Softmax of a rawPrediction vector -> array<double> of class scores."""
    a = vector_to_array(raw)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def mlp(features: list[str], n_classes: int, hidden=(64, 32), max_iter: int = 100, seed: int = 42) -> Pipeline:
    """M4: feed-forward net (sigmoid hidden layers, softmax output)."""
    m = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                       layers=[len(features), *hidden, n_classes], maxIter=max_iter, seed=seed)
    return Pipeline(stages=[assembler(features), m])


def linear_svm(features: list[str], weighted: bool = True) -> Pipeline:
    """M5: linear SVM (binary; MLlib has no kernel SVM)."""
    kw = {"weightCol": "weight"} if weighted else {}
    return Pipeline(stages=[assembler(features), LinearSVC(featuresCol="features", labelCol="label", **kw)])


def probabilities(scored: DataFrame, col: str = "probability") -> Column:
    return vector_to_array(F.col(col))


def fold_of(keys: list[str], k: int = 5, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in keys]), F.lit(k)).cast("int")


def stacking(train: DataFrame, features: list[str], keys: list[str], base: dict, n_classes: int,
             k: int = 5) -> tuple[dict, PipelineModel, list[str]]:
    """M3: out-of-fold base predictions (fold = seeded hash of the key mod k)
    feed a logistic-regression meta learner.  ``base`` maps a name to a
    factory ``f(features) -> Pipeline`` whose model has a probability column.
    Returns the base models fitted on all rows, the meta model and its input
    columns."""
    t = train.withColumn("_fold", fold_of(keys, k))
    oof = None
    meta_cols: list[str] = []
    for name in base:
        meta_cols += [f"{name}_p{i}" for i in range(n_classes)]
    for f in range(k):
        fit_part, pred_part = t.filter(F.col("_fold") != f), t.filter(F.col("_fold") == f)
        part = pred_part.select(*keys, "label")
        for name, make in base.items():
            m = make(features).fit(fit_part)
            p = m.transform(pred_part).select(*keys, probabilities(None).alias("_p"))
            part = part.join(p.select(*keys, *[F.col("_p")[i].alias(f"{name}_p{i}") for i in range(n_classes)]), keys)
        oof = part if oof is None else oof.unionByName(part)
    meta = Pipeline(stages=[VectorAssembler(inputCols=meta_cols, outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol="label")]).fit(oof)
    full = {name: make(features).fit(train) for name, make in base.items()}
    return full, meta, meta_cols


def stack_predict(df: DataFrame, base_models: dict, meta: PipelineModel, keys: list[str], n_classes: int) -> DataFrame:
    out = df.select(*keys)
    for name, m in base_models.items():
        p = m.transform(df).select(*keys, probabilities(None).alias("_p"))
        out = out.join(p.select(*keys, *[F.col("_p")[i].alias(f"{name}_p{i}") for i in range(n_classes)]), keys)
    return meta.transform(out)


def feature_importance(model: PipelineModel, features: list[str], top: int = 20) -> DataFrame:
    """M6: tree ensemble importances ranked (name as tie-breaker), top n."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(v) for v in imp])), "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def evaluate(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Classification report of a scored frame (A23 -> A24)."""
    d = scored.select(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p"))
    return class_report(confusion(d, "y", "p"))


def best_model(reports: dict[str, DataFrame], metric: str = "f1", row: str = "macro avg") -> str:
    """M7: highest metric on the given report row; the first listed wins ties."""
    best, best_v = None, None
    for name, rep in reports.items():
        v = rep.filter(F.col("row") == row).select(metric).first()[0]
        if best_v is None or v > best_v:
            best, best_v = name, v
    return best


def cascade(df: DataFrame, fast: PipelineModel, slow: PipelineModel, flag: Column | None = None) -> DataFrame:
    """M8: a cheap model flags rows; only flagged rows go to the expensive one."""
    s1 = fast.transform(df)
    flag = flag if flag is not None else (F.col("prediction") > 0)
    flagged = s1.filter(flag).drop("features", "rawPrediction", "probability", "prediction")
    rest = s1.filter(~flag).withColumn("verdict", F.lit(0.0))
    s2 = slow.transform(flagged).withColumn("verdict", F.col("prediction"))
    keep = [c for c in df.columns] + ["verdict"]
    return rest.select(*keep).unionByName(s2.select(*keep))


def pca_anomaly(normal: DataFrame, features: list[str], k: int = 3) -> PipelineModel:
    """M9: PCA fitted on normal rows (standardised by the normal mean / std);
    the reconstruction error is the anomaly score."""
    from pyspark.ml.feature import StandardScaler
    pipe = Pipeline(stages=[assembler(features),
                            StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True),
                            PCA(k=k, inputCol="z", outputCol="pc")])
    return pipe.fit(normal)


def pca_score(model: PipelineModel, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
    """Squared distance between the standardised row and its projection
    back from the principal subspace, plus per-feature residuals."""
    pca = model.stages[-1]
    basis = pca.pc.toArray()  # f x k
    t = model.transform(df)
    z = vector_to_array(F.col("z"))
    pc = vector_to_array(F.col("pc"))
    f, k = basis.shape
    recon = [sum((pc[j] * float(basis[i, j]) for j in range(k)), F.lit(0.0)) for i in range(f)]
    resid = F.array(*[z[i] - recon[i] for i in range(f)])
    return t.withColumn("residuals", resid).withColumn(
        out, F.aggregate(F.col("residuals"), F.lit(0.0), lambda a, r: a + r * r))


def batch_score(model: PipelineModel, df: DataFrame, names: Column | None = None,
                remediation: DataFrame | None = None, class_col: str = "prediction") -> DataFrame:
    """Score every row, attach the class name and remediation advice."""
    s = model.transform(df)
    sure = F.array_max(vector_to_array(F.col("probability"))) if "probability" in s.columns else F.lit(1.0)
    s = s.withColumn("class_id", F.col(class_col).cast("int")).withColumn("confidence", sure)
    if names is not None:
        s = s.withColumn("class_name", names)
    if remediation is not None:
        s = s.join(F.broadcast(remediation), s["class_id"] == remediation["attack_id"], "left").drop("attack_id")
    return s


def save_bundle(model: PipelineModel, path: str, features: list[str], meta: dict) -> None:
    """K6: model + feature list + metadata side by side."""
    model.write().overwrite().save(os.path.join(path, "model"))
    write_text(SparkSession.active(), os.path.join(path, "bundle"), json.dumps({"features": features, **meta}))


def load_bundle(path: str) -> tuple[PipelineModel, list[str], dict]:
    """K7."""
    meta = json.loads(read_text(SparkSession.active(), os.path.join(path, "bundle")))
    return PipelineModel.load(os.path.join(path, "model")), meta.pop("features"), meta


def with_weights(df: DataFrame) -> DataFrame:
    return add_weight_col(df, "label")


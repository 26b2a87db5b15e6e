"""Supervised training and clustering on MLlib, behind the fitted preprocessor.

``train_supervised`` composes: task type -> drop NULL targets -> label index ->
hash split -> preprocessor fitted on the training side -> estimator (or grid
search) -> test predictions -> metrics as aggregations -> hash-fold CV score.
``train_clustering`` does the same for k-means, bisecting k-means (the scalable
hierarchy) and DBSCAN.  Every fit is a distributed MLlib job; only fitted
parameters and one-row metric frames reach the driver.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions import kinds as K
from tabsense.operators import metrics as M
from tabsense.operators import prep as P
from tabsense.operators.linear_cv import linear_cv_scores
from tabsense.session import cut_lineage

SEED = 42

# Algorithm names accepted for each task.
REGRESSORS = ["linear_regression", "ridge", "lasso", "decision_tree", "random_forest",
              "gradient_boosting", "knn", "svm", "xgboost", "lightgbm", "catboost"]
CLASSIFIERS = ["logistic_regression", "naive_bayes", "knn", "svm", "decision_tree",
               "random_forest", "gradient_boosting", "xgboost", "lightgbm", "catboost"]
KNN_GRID = [3, 5, 7]      # fixed values: neighbours tried by tuning
CLUSTERERS = ["kmeans", "dbscan", "hierarchical", "agglomerative"]
# Boosting presets standing in for the optional libraries: (max depth, step size).
BOOST_PRESETS = {"xgboost": (6, 0.3), "lightgbm": (5, 0.1), "catboost": (6, 0.1)}


def normalise_algorithm(name: str | None) -> str:
    return str(name or "random_forest").lower().replace(" ", "_")


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """RBF-kernel approximation (Rahimi & Recht 2007): z = sqrt(2/D) cos(Wx + b),
    W ~ N(0, 2 gamma).  The parameters (sizes, gamma, seed) determine W and b, so the stage
    is saved and loaded like any other; a batch is one matrix product."""

    size = Param(Params._dummy(), "size", "length of the input vectors", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "random features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the random features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, size: int = 1, gamma: float = 1.0, components: int = 100,
                 inputCol: str = "features", outputCol: str = "rff", seed: int = SEED):
        super().__init__()
        self._setDefault(size=1, gamma=1.0, components=100, inputCol="features", outputCol="rff", seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, n = self.getOrDefault(self.size), self.getOrDefault(self.components)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        w = rng.normal(0.0, math.sqrt(2.0 * self.getOrDefault(self.gamma)), size=(n, size))
        shift = rng.uniform(0.0, 2.0 * math.pi, size=n)

        @F.pandas_udf("array<double>")
        def turned(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            return pd.Series(list(math.sqrt(2.0 / n) * np.cos(np.stack(x.to_numpy()) @ w.T + shift)))

        return df.withColumn(self.getOutputCol(), array_to_vector(turned(vector_to_array(F.col(self.getInputCol())))))


def make_estimator(task: str, algorithm: str, n_train: int, y_std: float = 1.0,
                   num_classes: int = 2, features: str = "features",
                   label: str = "label") -> tuple[Any, str]:
    """(estimator, algorithm actually used).  Unknown names fall back to random forest."""
    algo = normalise_algorithm(algorithm)
    names = REGRESSORS if task == "regression" else CLASSIFIERS
    if algo not in names:
        algo = "random_forest"
    kw = dict(featuresCol=features, labelCol=label)
    n = max(1, n_train)
    if task == "regression":
        if algo == "linear_regression":
            return LinearRegression(regParam=0.0, **kw), algo
        if algo == "ridge":   # sklearn alpha = 1
            return LinearRegression(elasticNetParam=0.0, standardization=False,
                                    regParam=1.0 * (y_std or 1.0) / n, **kw), algo
        if algo == "lasso":
            return LinearRegression(elasticNetParam=1.0, standardization=False, regParam=1.0,
                                    **kw), algo
        if algo == "decision_tree":
            return DecisionTreeRegressor(maxDepth=6, maxBins=256, seed=SEED, **kw), algo
        if algo == "random_forest":
            return RandomForestRegressor(numTrees=100, maxDepth=6, featureSubsetStrategy="all",
                                         seed=SEED, **kw), algo
        if algo == "gradient_boosting":
            return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED, **kw), algo
        if algo in BOOST_PRESETS:
            depth, rate = BOOST_PRESETS[algo]
            return GBTRegressor(maxIter=100, maxDepth=depth, stepSize=rate, seed=SEED, **kw), "gbt"
        if algo == "svm":
            return LinearRegression(loss="huber", featuresCol="rff", labelCol=label), "svm_rff"
        return None, "knn"
    if algo == "logistic_regression":   # sklearn C = 1
        return LogisticRegression(maxIter=1000, standardization=False, regParam=1.0 / n, **kw), algo
    if algo == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **kw), algo
    if algo == "decision_tree":
        return DecisionTreeClassifier(maxDepth=6, maxBins=256, seed=SEED, **kw), algo
    if algo == "random_forest":
        return RandomForestClassifier(numTrees=100, maxDepth=6, featureSubsetStrategy="sqrt",
                                      seed=SEED, **kw), algo
    if algo in ("gradient_boosting", *BOOST_PRESETS):
        depth, rate = BOOST_PRESETS.get(algo, (3, 0.1))
        gbt = GBTClassifier(maxIter=100, maxDepth=depth, stepSize=rate, seed=SEED, **kw)
        used = algo if algo == "gradient_boosting" else "gbt"
        return (gbt if num_classes <= 2 else OneVsRest(classifier=gbt, **kw)), used
    if algo == "svm":
        svc = LinearSVC(featuresCol="rff", labelCol=label, maxIter=200)
        return OneVsRest(classifier=svc, featuresCol="rff", labelCol=label), "svm_rff"
    return None, "knn"


def param_grid(est: Any, algorithm: str):
    """The reference's small grids."""
    b = ParamGridBuilder()
    if isinstance(est, (RandomForestRegressor, RandomForestClassifier)):
        return b.addGrid(est.numTrees, [50, 100]).addGrid(est.maxDepth, [4, 6]).build()
    if isinstance(est, (DecisionTreeRegressor, DecisionTreeClassifier)):
        return b.addGrid(est.maxDepth, [3, 5, 8]).build()
    return None


@dataclass
class TrainResult:
    model_id: str
    task_type: str
    algorithm_requested: str
    algorithm_used: str
    target: str | None
    features: list[str]
    metrics: dict[str, float]
    classes: list = field(default_factory=list)
    excluded_features: list[str] = field(default_factory=list)
    prep: P.Prep | None = None
    model: Any = None
    predictions: DataFrame | None = None
    feature_names: list[str] = field(default_factory=list)
    cv_error: str | None = None
    reference: DataFrame | None = None      # kNN: the distinct training points, checkpointed
    neighbors: int = 5

    def predict(self, prepared: DataFrame) -> DataFrame:
        """``prepared`` rows (out of ``prep``) with their ``prediction``."""
        if self.model is not None:
            return self.model.transform(prepared)
        return _knn_apply(self.reference, prepared, self.task_type, self.neighbors)


def _rff_stage(train_feats: DataFrame, dim: int) -> RandomFourierFeatures:
    """gamma = 1 / (n_features * variance of all feature values) (sklearn 'scale')."""
    arr = vector_to_array(F.col("features"))
    var = (train_feats.select(F.explode(arr).alias("v")).agg(F.var_pop("v")).first()[0]) or 1.0
    return RandomFourierFeatures(size=dim, gamma=1.0 / (dim * var if var > 0 else dim))


def _knn_reference(train: DataFrame) -> DataFrame:
    """(rid, vec, target, w): the distinct training points and how many rows each stands for."""
    return _numbered(train.select(vector_to_array("features").alias("vec"), F.col("label").alias("target"))
                     .groupBy("vec", "target").agg(F.count(F.lit(1)).alias("w")), "rid")


def _knn_apply(ref: DataFrame, test: DataFrame, task: str, k: int) -> DataFrame:
    """``test`` with ``prediction``; equal vectors are one query."""
    from tabsense.operators.neighbors import knn_predict
    rows = test.withColumn("_vec", vector_to_array("features"))
    q = _numbered(rows.select(F.col("_vec").alias("vec")).distinct(), "qid")
    pred = knn_predict(q, ref, k, task).join(q.select("qid", F.col("vec").alias("_vec")), on="qid")
    return rows.join(pred.drop("qid"), on="_vec").drop("_vec")


def _numbered(distinct_rows: DataFrame, name: str) -> DataFrame:
    """Distinct rows with a unique id, checkpointed so that the ids never change."""
    return cut_lineage(distinct_rows.withColumn(name, F.monotonically_increasing_id()))


def _by_normal_equations(est, scaling: str) -> bool:
    """Least squares with at most a squared penalty on unscaled coefficients."""
    return (isinstance(est, LinearRegression) and est.getLoss() == "squaredError" and scaling == "standard"
            and (est.getRegParam() == 0 or (est.getElasticNetParam() == 0 and not est.getStandardization())))


def cv_score(est, data: DataFrame, keys: Sequence[str], k: int, task: str,
             num: Sequence[str], cat: Sequence[str], scaling: str,
             rff: bool = False, neighbors: int = 5) -> float | None:
    """Mean score (r2 / accuracy) of the whole pipeline refitted on k hash folds.

    As in a cross-validated pipeline, every fold fits its own preprocessor (and
    random-feature map) on its training rows before refitting a copy of ``est``.
    Linear and ridge regression on standard scaling get the same scores from one pass
    (``linear_cv``).  ``est`` None is kNN with ``neighbors``.
    The input is persisted once with its fold id; the k fold fits are independent
    Spark jobs submitted concurrently, so on a cluster they share the executors
    instead of queueing one after another.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    if est is not None and _by_normal_equations(est, scaling):
        scores = linear_cv_scores(data, keys, k, num, cat, est.getRegParam(), SEED)
        if scores is not None:
            return float(np.mean(scores)) if scores else None
    folds = P.with_folds(data, keys, k, SEED).persist()
    fold_med = P.fold_medians(folds, num, k)       # every fold's medians in one job
    metric = "r2" if task == "regression" else "accuracy"
    score = M.eval_regression if task == "regression" else M.eval_classification

    def one(i: int):
        tr_raw, va_raw = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        prep = P.fit_preprocessor(tr_raw, num, cat, scaling, fitted_medians=fold_med[i])
        tr, va = prep.model.transform(tr_raw), prep.model.transform(va_raw)
        if rff:
            stage = _rff_stage(tr, len(prep.feature_names))
            tr, va = stage.transform(tr), stage.transform(va)
        pred = (_knn_apply(_knn_reference(tr), va, task, neighbors) if est is None
                else est.copy().fit(tr).transform(va))
        return score(pred, "label", "prediction").first()[metric]

    try:
        with ThreadPoolExecutor(max_workers=k) as pool:
            run = inheritable_thread_target(data.sparkSession)(one)
            scores = [s for s in pool.map(run, range(k)) if s is not None]
    finally:
        folds.unpersist()
    return float(sum(scores) / len(scores)) if scores else None


def train_supervised(df: DataFrame, target: str, features: Sequence[str] | None = None,
                     task_type: str | None = None, algorithm: str = "random_forest",
                     scaling: str = "standard", test_pct: int = 20, cv_folds: int = 5,
                     tuning: bool = False, key_cols: Sequence[str] | None = None) -> TrainResult:
    """Train, evaluate and return the fitted pipeline with one-row metrics."""
    task = task_type or P.task_type(df, target)
    feats = list(features) if features else [c for c in df.columns if c != target]
    feats = [c for c in feats if not K.is_temporal(K.dtype_of(df, c))]
    data = P.drop_null_target(df.select(*[K.col(c) for c in dict.fromkeys([target, *feats, *(key_cols or [])])]),
                              target)
    classes: list = []
    if task == "classification":
        classes = P.fit_labels(data, target)
        data = data.withColumn("label", P.label_expr(target, classes))
    else:
        data = data.withColumn("label", K.col(target).cast("double"))
    keys = list(key_cols) if key_cols else [target, *feats]
    data = data.withColumn("_rid", F.xxhash64(*[K.col(c) for c in keys], F.lit(SEED)))
    num = [c for c in feats if K.is_numeric_like(K.dtype_of(data, c))]
    cat = [c for c in feats if c not in num]
    for c in num:
        if K.dtype_of(data, c).simpleString() == "boolean":
            data = data.withColumn(c, K.col(c).cast("double"))
    train, test = P.split(data, keys, test_pct, SEED)
    train = train.persist()
    prep = P.fit_preprocessor(train, num, cat, scaling)
    tr = prep.model.transform(train)
    te = prep.model.transform(test)
    n_train = tr.count()
    y_std = tr.agg(F.stddev_pop("label")).first()[0] or 1.0
    est, used = make_estimator(task, algorithm, n_train, y_std, max(2, len(classes)))
    if used == "svm_rff":                # the map is part of what prepares a row, saved with it
        stage = _rff_stage(tr, len(prep.feature_names))
        prep = replace(prep, model=PipelineModel(stages=[*prep.model.stages, stage]))
        tr, te = stage.transform(tr), stage.transform(te)
    metric_name = "r2" if task == "regression" else "accuracy"
    reference, neighbors = None, 5
    if est is None:
        model, reference = None, _knn_reference(tr)
        if tuning:
            found = {k: cv_score(None, train, keys, 3, task, num, cat, scaling, neighbors=k) for k in KNN_GRID}
            neighbors = max(KNN_GRID, key=lambda k: -math.inf if found[k] is None else found[k])
        pred = _knn_apply(reference, te, task, neighbors)
    else:
        grid = param_grid(est, used) if tuning else None
        if grid:
            ev = (RegressionEvaluator(metricName="r2") if task == "regression"
                  else MulticlassClassificationEvaluator(metricName="accuracy"))
            cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=3,
                                parallelism=4, seed=SEED)
            model = cv.fit(tr).bestModel
        else:
            model = est.fit(tr)
        pred = model.transform(te)
    if task == "regression":
        mrow = M.eval_regression(pred, "label", "prediction").first().asDict()
    else:
        mrow = M.eval_classification(pred, "label", "prediction").first().asDict()
        if "probability" in pred.columns:
            probs = vector_to_array("probability")
            if len(classes) == 2:
                auc = M.roc_auc(pred.select("label", probs[1].alias("p")), "label", "p").first()[0]
            else:
                cols = {str(float(i)): f"_p{i}" for i in range(len(classes))}
                wide = pred.select(F.col("label").cast("string").alias("label"),
                                   *[probs[i].alias(f"_p{i}") for i in range(len(classes))])
                auc = M.roc_auc_macro(M.roc_auc_ovr(wide, "label", cols)).first()[0]
            if auc is not None:
                mrow["roc_auc"] = auc
    cv_error = None
    if cv_folds:
        try:
            best = est
            if tuning and est is not None:
                best = est.copy({est.getParam(p.name): v for p, v in model.extractParamMap().items()
                                 if est.hasParam(p.name)})
            score = cv_score(best, data, keys, cv_folds, task, num, cat, scaling, used == "svm_rff", neighbors)
            if score is not None:
                mrow["cv_mean_score"] = score
        except Exception as e:  # noqa: BLE001  (a failed CV leaves the trained model usable)
            cv_error = f"{type(e).__name__}: {e}"
    train.unpersist()
    metrics = {k: float(v) for k, v in mrow.items() if v is not None}
    return TrainResult(str(uuid.uuid4()), task, normalise_algorithm(algorithm), used, target, feats,
                       metrics, classes, [], prep, model, pred, prep.feature_names, cv_error, reference, neighbors)


def train_clustering(df: DataFrame, features: Sequence[str] | None = None,
                     algorithm: str = "kmeans", n_clusters: int = 3,
                     id_col: str | None = None) -> tuple[TrainResult, DataFrame]:
    """Cluster, evaluate (silhouette), return the result and the labelled rows."""
    rows, feats = P.cluster_input(df, features)
    k = max(2, int(n_clusters))
    num = [c for c in feats if K.is_numeric_like(K.dtype_of(rows, c))]
    cat = [c for c in feats if c not in num]
    prep = P.fit_preprocessor(rows, num, cat, "standard")
    x = prep.model.transform(rows)
    algo = normalise_algorithm(algorithm)
    if algo == "dbscan":
        from tabsense.operators.dbscan import dbscan
        # equal rows are one weighted point; its id is the least of theirs if they have ids
        rows = x.withColumn("vec", vector_to_array("features"))
        least = [F.min(K.col(id_col)).alias("pid")] if id_col else []
        uniq = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("w"), *least)
        uniq = cut_lineage(uniq) if id_col else _numbered(uniq, "pid")
        lab = dbscan(uniq, 0.5, 5)
        labelled = (rows.join(uniq.select("vec", "pid"), on="vec").join(lab, on="pid")
                    .withColumnRenamed("cluster", "prediction"))
        used, model = "dbscan", None
    else:
        if algo in ("hierarchical", "agglomerative"):
            est, used = BisectingKMeans(k=k, seed=SEED, featuresCol="features"), "bisecting_kmeans"
        else:
            est, used = KMeans(k=k, seed=SEED, featuresCol="features"), "kmeans"
        model = est.fit(x)
        labelled = model.transform(x)
    sil = M.silhouette(labelled.select(vector_to_array("features").alias("v"), "prediction"),
                       "v", "prediction").first()[0]
    res = TrainResult(str(uuid.uuid4()), "clustering", algo, used, None, feats,
                      {"silhouette_score": float(sil)}, [], [], prep, model, None, prep.feature_names)
    return res, labelled


def save_model(res: TrainResult, path: str) -> str:
    """Write the fitted preprocessing pipeline and the model with MLlib."""
    stages = list(res.prep.model.stages) if res.prep else []
    if res.model is not None:
        stages.append(res.model)
    PipelineModel(stages=stages).write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """A saved pipeline; ``transform`` takes raw rows."""
    return PipelineModel.load(path)


__all__ = ["load_model", "train_supervised", "train_clustering", "cv_score", "make_estimator", "param_grid", "save_model",
           "TrainResult", "RandomFourierFeatures", "REGRESSORS", "CLASSIFIERS", "CLUSTERERS",
           "Estimator", "Pipeline"]

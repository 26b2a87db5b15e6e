"""Model store (S13, M15, M16, X6): a training result written whole, listed in the run
catalog and read back in another session to predict and to explain.

A result's folder holds the fitted stages (preprocessing and model), its details, its
class values and, for kNN, its reference points, all written by Spark.  The catalog row
is appended last, so a listed model is always complete; a folder without a row is an
unfinished save that no lookup sees.
"""
from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.operators import catalog as C
from tabsense.operators.explain import explain_top
from tabsense.operators.models import TrainResult
from tabsense.operators.prep import Prep

FIELDS = ("model_id", "task_type", "algorithm_requested", "algorithm_used", "target", "features", "metrics",
          "excluded_features", "feature_names", "cv_error", "neighbors")


def save_result(res: TrainResult, path: str, spark: SparkSession) -> str:
    """Write all of ``res`` that predicting and explaining need under ``path``."""
    prep = list(res.prep.model.stages)
    PipelineModel(stages=[*prep, *([res.model] if res.model is not None else [])]).write().overwrite().save(f"{path}/stages")
    if res.reference is not None:
        res.reference.write.mode("overwrite").parquet(f"{path}/reference")
    if res.classes:
        spark.createDataFrame(list(enumerate(res.classes)), ["idx", "value"]).write.mode("overwrite").parquet(f"{path}/classes")
    details = {**{f: getattr(res, f) for f in FIELDS}, "num_cols": res.prep.num_cols, "cat_cols": res.prep.cat_cols,
               "prep_stages": len(prep), "has_reference": res.reference is not None, "has_classes": bool(res.classes)}
    spark.range(1).select(F.lit(json.dumps(details)).alias("details")).write.mode("overwrite").parquet(f"{path}/details")
    return path


def load_result(spark: SparkSession, path: str) -> TrainResult:
    """The result that ``save_result`` wrote, without its test predictions."""
    d = json.loads(spark.read.parquet(f"{path}/details").first()["details"])
    stages = PipelineModel.load(f"{path}/stages").stages
    n = d["prep_stages"]
    prep = Prep(PipelineModel(stages=stages[:n]), d["num_cols"], d["cat_cols"], d["feature_names"])
    classes = ([r["value"] for r in spark.read.parquet(f"{path}/classes").orderBy("idx").collect()]
               if d["has_classes"] else [])
    return TrainResult(**{f: d[f] for f in FIELDS}, classes=classes, prep=prep,
                       model=stages[n] if len(stages) > n else None,
                       reference=spark.read.parquet(f"{path}/reference") if d["has_reference"] else None)


def register(res: TrainResult, spark: SparkSession, root: str, session_id: str,
             dataset_id: str | None = None) -> str:
    """Save ``res`` under ``root`` and list it in the catalog; gives its folder."""
    path = save_result(res, f"{root.rstrip('/')}/model_files/{res.model_id}", spark)
    record = spark.createDataFrame([C.model_record(res, session_id, dataset_id, path)], C.MODELS)
    C.append(record.withColumn("trained_at", F.current_timestamp()), root, "models")
    return path


def find_model(spark: SparkSession, root: str, session_id: str | None = None,
               model_id: str | None = None) -> dict:
    """Catalog row of a model by its id, else the session's newest one."""
    models = C.read_table(spark, root, "models")
    rows = C.get_by_id(models, model_id) if model_id else C.by_session(models, session_id, "trained_at", "id")
    row = rows.first()
    if row is None:
        raise ValueError("no trained model found; train a model first")
    return row.asDict(recursive=True)


def explain_saved(spark: SparkSession, root: str, df: DataFrame, session_id: str | None = None,
                  model_id: str | None = None, k: int = 10) -> DataFrame:
    """X6 in any session: the top ``k`` features of a listed model on ``df``."""
    return explain_top(load_result(spark, find_model(spark, root, session_id, model_id)["filepath"]), df, k)

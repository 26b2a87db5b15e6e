"""Run catalog: sessions, conversations, datasets, models and charts as
append-only Spark tables with fixed schemas, and the lookups the reference's
repository layer performs, as DataFrame operators.

Inserts never rewrite a table: new rows are the incoming rows that are not yet
present (left-anti join on the key) and are appended.  "Updates" (touching a
session) are appended events resolved by ``max`` on read.  Deletes are
left-anti joins that cascade the way the reference's foreign keys do: a session
takes its conversations, datasets, models and charts with it; a dataset takes
its models.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, TS, L = T.StringType(), T.TimestampType(), T.LongType()

SESSIONS = T.StructType([T.StructField("id", S, False), T.StructField("created_at", TS),
                         T.StructField("updated_at", TS),
                         T.StructField("settings", T.MapType(S, S))])
CONVERSATIONS = T.StructType([T.StructField("id", L, False), T.StructField("session_id", S, False),
                              T.StructField("role", S, False), T.StructField("content", S, False),
                              T.StructField("timestamp", TS)])
DATASETS = T.StructType([T.StructField("id", S, False), T.StructField("session_id", S, False),
                         T.StructField("filename", S), T.StructField("filepath", S),
                         T.StructField("file_type", S), T.StructField("row_count", L),
                         T.StructField("column_count", L),
                         T.StructField("schema_json", T.MapType(S, S)),
                         T.StructField("uploaded_at", TS)])
MODELS = T.StructType([T.StructField("id", S, False), T.StructField("session_id", S, False),
                       T.StructField("dataset_id", S), T.StructField("model_type", S),
                       T.StructField("algorithm", S), T.StructField("target_column", S),
                       T.StructField("features", T.ArrayType(S)),
                       T.StructField("metrics", T.MapType(S, T.DoubleType())),
                       T.StructField("filepath", S), T.StructField("trained_at", TS)])
CHARTS = T.StructType([T.StructField("id", S, False), T.StructField("session_id", S, False),
                       T.StructField("dataset_id", S), T.StructField("title", S),
                       T.StructField("chart_type", S), T.StructField("filepath", S),
                       T.StructField("created_at", TS)])
TABLES = {"sessions": SESSIONS, "conversations": CONVERSATIONS, "datasets": DATASETS,
          "models": MODELS, "charts": CHARTS}
TIME_COL = {"sessions": "updated_at", "conversations": "timestamp", "datasets": "uploaded_at",
            "models": "trained_at", "charts": "created_at"}
REPORT_METRICS = ("accuracy", "f1_weighted", "roc_auc", "r2", "rmse", "mae", "silhouette_score",
                  "cv_mean_score")


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def read_table(spark, root: str, name: str) -> DataFrame:
    """A catalog table under ``root`` (empty when nothing was written yet)."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    except Exception:  # noqa: BLE001  (path does not exist yet)
        return empty(spark, name)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str | Sequence[str] = "id",
               order: str | None = None) -> DataFrame:
    """R2: rows of ``incoming`` whose key is not in ``existing`` (first per key by
    ``order`` when the incoming batch repeats a key)."""
    keys = [key] if isinstance(key, str) else list(key)
    new = incoming.join(existing.select(*keys).distinct(), on=keys, how="left_anti")
    if order:
        w = Window.partitionBy(*keys).orderBy(order)
        new = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    else:
        new = new.dropDuplicates(keys)
    return new


def upsert_ignore(existing: DataFrame, incoming: DataFrame, key: str | Sequence[str] = "id",
                  order: str | None = None) -> DataFrame:
    """The table after INSERT OR IGNORE: existing rows plus the new ones."""
    return existing.unionByName(insert_new(existing, incoming, key, order).select(*existing.columns))


def append(df: DataFrame, root: str, name: str, partition_by: str | None = "session_id") -> None:
    """Append records to a catalog table (partitioned by session)."""
    w = df.select(*[f.name for f in TABLES[name].fields]).write.mode("append")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(f"{root.rstrip('/')}/{name}")


def get_by_id(table: DataFrame, key_value, key: str = "id") -> DataFrame:
    """One record by id (a pushed-down filter)."""
    return table.where(F.col(key) == F.lit(key_value))


def by_session(table: DataFrame, session_id: str, ts: str, seq: str) -> DataFrame:
    """A session's records, newest first; insertion order breaks ties."""
    return table.where(F.col("session_id") == session_id).orderBy(F.desc(ts), F.desc(seq))


def latest_per(table: DataFrame, part: Sequence[str], ts: str, seq: str) -> DataFrame:
    """Newest record per key (e.g. the newest model of every session)."""
    w = Window.partitionBy(*part).orderBy(F.desc(ts), F.desc(seq))
    return table.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def history_first(msgs: DataFrame, session: str, order: Sequence[str], limit: int = 50) -> DataFrame:
    """Oldest-first history, at most ``limit`` messages per session."""
    w = Window.partitionBy(session).orderBy(*order)
    return msgs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def history_recent(msgs: DataFrame, session: str, seq: str, limit: int = 20) -> DataFrame:
    """The most recent ``limit`` messages per session (clamped to 1..500), shown
    oldest first (``pos`` 1 = oldest of them)."""
    n = max(1, min(500, int(limit)))
    w = Window.partitionBy(session).orderBy(F.desc(seq))
    recent = msgs.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    w2 = Window.partitionBy(session).orderBy(seq)
    return recent.drop("_back").withColumn("pos", F.row_number().over(w2))


def delete_sessions(tables: dict[str, DataFrame], session_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove sessions and, by cascade, their conversations, datasets, models
    and charts; models of removed datasets go too.  ``session_ids``: (id)."""
    ids = session_ids.select("id").distinct()
    out = dict(tables)
    if "sessions" in tables:
        out["sessions"] = tables["sessions"].join(ids, on="id", how="left_anti")
    sid = ids.withColumnRenamed("id", "session_id")
    for name in ("conversations", "datasets", "models", "charts"):
        if name in tables:
            out[name] = tables[name].join(sid, on="session_id", how="left_anti")
    if "datasets" in tables and "models" in out:
        gone = tables["datasets"].join(sid, on="session_id").select(F.col("id").alias("dataset_id"))
        out["models"] = out["models"].join(gone, on="dataset_id", how="left_anti")
    return out


def delete_datasets(tables: dict[str, DataFrame], dataset_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove datasets and the models trained on them (charts keep theirs)."""
    ids = dataset_ids.select("id").distinct()
    out = dict(tables)
    out["datasets"] = tables["datasets"].join(ids, on="id", how="left_anti")
    if "models" in tables:
        out["models"] = tables["models"].join(ids.withColumnRenamed("id", "dataset_id"),
                                              on="dataset_id", how="left_anti")
    return out


def clear_history(msgs: DataFrame, session_ids: DataFrame, session: str = "session_id") -> DataFrame:
    """Drop every message of the given sessions."""
    return msgs.join(session_ids.select(F.col("id").alias(session)).distinct(), on=session,
                     how="left_anti")


def touch(sessions: DataFrame, touches: DataFrame) -> DataFrame:
    """``updated_at`` = latest of the stored value and the touch events
    ``(session_id, ts)``, resolved on read."""
    last = touches.groupBy("session_id").agg(F.max("ts").alias("_t"))
    j = sessions.join(last.withColumnRenamed("session_id", "id"), on="id", how="left")
    return j.withColumn("updated_at", F.greatest("updated_at", "_t")).drop("_t")


def models_of_dataset(models: DataFrame, dataset_id: str, k: int = 5,
                      metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """Newest k models of one dataset with chosen metrics as columns."""
    m = models.where(F.col("dataset_id") == dataset_id).orderBy(F.desc("trained_at"), F.desc("id")).limit(k)
    return m.select("id", "algorithm", "model_type", "target_column",
                    *[F.element_at("metrics", F.lit(name)).alias(name) for name in metrics])


def model_record(res, session_id: str, dataset_id: str | None, filepath: str) -> dict:
    """Catalog row for a training result (metrics as a string->double map)."""
    return {"id": res.model_id, "session_id": session_id, "dataset_id": dataset_id,
            "model_type": res.task_type, "algorithm": res.algorithm_requested,
            "target_column": res.target, "features": list(res.features),
            "metrics": {k: float(v) for k, v in res.metrics.items()}, "filepath": filepath,
            "trained_at": None}

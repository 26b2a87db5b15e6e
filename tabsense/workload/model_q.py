"""Model, neighbour, clustering and explanation queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsense.operators import explain as X
from tabsense.operators import model_store as ST
from tabsense.operators import models as MD
from tabsense.operators.dbscan import dbscan
from tabsense.operators.neighbors import knn_predict
from tabsense.session import ensure_checkpoint_dir
from tabsense.workload.base import register, rounded, table


def _metrics_frame(spark, res) -> object:
    rows = [(res.model_id, res.task_type, res.algorithm_requested, res.algorithm_used, k, float(v))
            for k, v in sorted(res.metrics.items())]
    return spark.createDataFrame(rows, "model_id string, task_type string, algorithm string, "
                                       "algorithm_used string, metric string, value double")


def _doc_labels(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(docs, "doc_id").select("quality", "n_chars", "lang", "source", "doc_id")


@register("train_regression")
def q_train_regression(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    res = MD.train_supervised(li, "l_extendedprice", algorithm="ridge", cv_folds=5)
    return _metrics_frame(spark, res)


@register("train_classification")
def q_train_classification(spark, sf):
    d = _doc_labels(spark, sf)
    res = MD.train_supervised(d.drop("doc_id"), "quality", algorithm="random_forest", cv_folds=5,
                              key_cols=None)
    return _metrics_frame(spark, res)


@register("train_clusters")
def q_train_clusters(spark, sf):
    ev = table(spark, sf, "events")
    res, labelled = MD.train_clustering(ev, ["value", "user_id"], "kmeans", 3)
    sizes = labelled.groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select(F.lit(res.metrics["silhouette_score"]).alias("silhouette_score"),
                        F.col("prediction").cast("int").alias("cluster"), "rows")


@register("knn_predict", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS rid, b.label,
             list_distance(a.v, b.v) AS d
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rk FROM p),
v AS (SELECT qid, label, count(*) AS c FROM r WHERE rk <= 5 GROUP BY qid, label),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS o FROM v)
SELECT qid AS vec_id, label AS prediction FROM w WHERE o = 1""")
def q_knn_predict(spark, sf):
    emb = table(spark, sf, "embeddings")
    ref = emb.select(F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("vec"),
                     F.col("label").alias("target"))
    q = emb.select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vec"))
    return knn_predict(q, ref, 5, "classification", exclude_self=True).select(
        F.col("qid").alias("vec_id"), "prediction")


# DBSCAN by its definition: neighbours by a range join plus the exact distance test,
# cores by degree, components by min-label propagation (a keyed recursive CTE),
# border points take the smallest neighbouring core label, the rest are noise (-1).
DBSCAN_SQL = """
WITH RECURSIVE st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv,
                             avg(user_id) AS mu, stddev_pop(user_id) AS su FROM events),
p AS (SELECT event_id AS pid, (value - mv) / sv AS x, (user_id - mu) / su AS y FROM events, st),
nb AS (SELECT a.pid AS pid, b.pid AS other FROM p a JOIN p b
         ON b.x BETWEEN a.x - 0.5 AND a.x + 0.5 AND b.y BETWEEN a.y - 0.5 AND a.y + 0.5
       WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.5),
core AS (SELECT pid FROM nb GROUP BY pid HAVING count(*) >= 5),
ce AS (SELECT nb.pid AS a, nb.other AS b FROM nb SEMI JOIN core c1 ON nb.pid = c1.pid
       SEMI JOIN core c2 ON nb.other = c2.pid),
cc(node, comp) USING KEY (node) AS (
  SELECT pid, pid FROM core
  UNION
  SELECT ce.b, min(cc.comp) FROM cc JOIN ce ON cc.node = ce.a GROUP BY ce.b
  HAVING min(cc.comp) < (SELECT r.comp FROM recurring.cc r WHERE r.node = ce.b)),
border AS (SELECT nb.pid, min(cc.comp) AS bl FROM nb JOIN cc ON nb.other = cc.node
           ANTI JOIN core ON nb.pid = core.pid GROUP BY nb.pid),
lab AS (SELECT p.pid, coalesce(cc.comp, border.bl, -1) AS cluster, cc.node IS NOT NULL AS is_core
        FROM p LEFT JOIN cc ON p.pid = cc.node LEFT JOIN border ON p.pid = border.pid)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS rows,
       CAST(count_if(is_core) AS BIGINT) AS core_rows FROM lab GROUP BY cluster"""


@register("dbscan_labels", DBSCAN_SQL)
def q_dbscan_labels(spark, sf):
    ev = table(spark, sf, "events")
    st = ev.agg(F.avg("value").alias("mv"), F.stddev_pop("value").alias("sv"),
                F.avg("user_id").alias("mu"), F.stddev_pop("user_id").alias("su"))
    pts = ev.select(F.col("event_id").alias("pid"),
                    F.array((F.col("value") - st.select("mv").scalar()) / st.select("sv").scalar(),
                            (F.col("user_id") - st.select("mu").scalar()) / st.select("su").scalar())
                    .alias("vec"))
    lab = dbscan(pts, 0.5, 5)
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"),
                                      F.count_if("is_core").alias("core_rows"))


@register("importance_native")
def q_importance_native(spark, sf):
    d = _doc_labels(spark, sf).drop("doc_id")
    res = MD.train_supervised(d, "quality", algorithm="random_forest", cv_folds=0)
    return rounded(X.native_importance(res))


@register("importance_permutation")
def q_importance_permutation(spark, sf):
    d = _doc_labels(spark, sf).drop("doc_id")
    res = MD.train_supervised(d, "quality", algorithm="logistic_regression", cv_folds=0)
    return rounded(X.permutation_importance(res, d))


@register("explain_top")
def q_explain_top(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus",
                                             "l_returnflag")
    res = MD.train_supervised(li, "l_returnflag", algorithm="decision_tree", cv_folds=0)
    return rounded(X.explain_top(res, li))


@register("explain_saved")
def q_explain_saved(spark, sf):
    """Trained and listed in a store in the shared folder, then found there and explained."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus",
                                             "l_returnflag")
    ST.register(MD.train_supervised(li, "l_returnflag", algorithm="decision_tree", cv_folds=0), spark, root, "s1", "lineitem")
    return rounded(ST.explain_saved(spark, root, li, "s1"))

"""Evaluation queries (E1-E9) on predictions made by fixed expressions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import metrics as M
from tabsense.workload.base import register, rounded, table

PRED_SQL = ("(SELECT l_orderkey, l_linenumber, l_returnflag AS y, CASE WHEN l_quantity > 25 THEN 'R' "
            "WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END AS p FROM lineitem)")


def predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    p = (F.when(F.col("l_quantity") > 25, "R").when(F.col("l_discount") > 0.05, "A").otherwise("N"))
    return li.select(F.col("l_returnflag").alias("y"), p.alias("p"))


STATS_SQL = f"""WITH pr AS {PRED_SQL},
cls AS (SELECT y AS class FROM pr UNION SELECT p FROM pr),
st AS (SELECT class,
  (SELECT count(*) FROM pr WHERE y = class) AS support,
  (SELECT count(*) FROM pr WHERE p = class) AS predicted,
  (SELECT count(*) FROM pr WHERE y = class AND p = class) AS tp FROM cls),
m AS (SELECT class, support, tp,
  CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall FROM st),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0 END AS f1 FROM m)"""


@register("eval_regression", """
WITH t AS (SELECT l_extendedprice AS y, l_quantity * 950.0 AS p FROM lineitem)
SELECT round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse,
  round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
  round(coalesce(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 0), 6) AS mape FROM t""")
def q_eval_regression(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 950.0).alias("prediction"))
    return rounded(M.eval_regression(li))


@register("eval_classification", STATS_SQL + """
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted,
  round(sum(recall * support) / sum(support), 6) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f""")
def q_eval_classification(spark, sf):
    return rounded(M.eval_classification(predictions(spark, sf), "y", "p"))


@register("confusion_matrix", f"""
WITH pr AS {PRED_SQL}, cls AS (SELECT y AS c FROM pr UNION SELECT p FROM pr)
SELECT a.c AS actual, b.c AS predicted,
  CAST((SELECT count(*) FROM pr WHERE y = a.c AND p = b.c) AS BIGINT) AS count
FROM cls a, cls b""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(predictions(spark, sf), "y", "p")


@register("class_report", STATS_SQL + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM f""")
def q_class_report(spark, sf):
    return rounded(M.class_report(predictions(spark, sf), "y", "p"))


@register("roc_auc", """
WITH d AS (SELECT l.quality AS y, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)
SELECT round((sum(CASE WHEN y = 1 THEN rk END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
             / (count_if(y = 1) * count_if(y <> 1)), 6) AS roc_auc FROM r""")
def q_roc_auc(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return rounded(M.roc_auc(lab.join(docs, "doc_id"), "quality", "n_chars"))


def _ovr_sql() -> str:
    parts = []
    for c, expr in (("A", "l_discount"), ("N", "l_tax"), ("R", "l_quantity / 50.0")):
        parts.append(f"""SELECT '{c}' AS class, (sum(CASE WHEN y THEN rk END) - count_if(y) * (count_if(y) + 1) / 2.0)
  / (count_if(y) * count_if(NOT y)) AS roc_auc FROM (
  SELECT l_returnflag = '{c}' AS y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk
  FROM (SELECT l_returnflag, CAST({expr} AS DOUBLE) AS s FROM lineitem))""")
    per = " UNION ALL ".join(parts)
    return (f"WITH p AS ({per}) SELECT class, round(roc_auc, 6) AS roc_auc FROM p "
            "UNION ALL SELECT 'macro', round(avg(roc_auc), 6) FROM p")


@register("roc_auc_ovr", _ovr_sql())
def q_roc_auc_ovr(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_discount", "l_tax", (F.col("l_quantity") / 50.0).alias("p_r"))
    per = M.roc_auc_ovr(li, "l_returnflag", {"A": "l_discount", "N": "l_tax", "R": "p_r"})
    macro = M.roc_auc_macro(per).select(F.lit("macro").alias("class"), "roc_auc")
    return rounded(per.unionByName(macro))


@register("silhouette", """
WITH p AS (SELECT l_returnflag AS c, l_quantity AS f1, l_extendedprice / 1000.0 AS f2, l_discount * 100.0 AS f3
           FROM lineitem),
q AS (SELECT *, f1 * f1 + f2 * f2 + f3 * f3 AS sq, row_number() OVER () AS rid FROM p),
cs AS (SELECT c, count(*) AS n, sum(f1) AS s1, sum(f2) AS s2, sum(f3) AS s3, sum(sq) AS qq FROM q GROUP BY c),
d AS (SELECT q.rid, q.c AS own, cs.c AS other, cs.n,
             cs.n * q.sq - 2 * (q.f1 * cs.s1 + q.f2 * cs.s2 + q.f3 * cs.s3) + cs.qq AS t FROM q, cs),
ab AS (SELECT rid, max(CASE WHEN own = other THEN n END) AS n_own,
              max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a,
              min(CASE WHEN own <> other THEN t / n END) AS b FROM d GROUP BY rid)
SELECT round(CASE WHEN (SELECT count(*) FROM cs) > 1 AND (SELECT count(*) FROM cs) < (SELECT count(*) FROM q)
  THEN avg(CASE WHEN n_own <= 1 THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END) ELSE -1 END, 6)
  AS silhouette_score FROM ab""")
def q_silhouette(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("c"), F.col("l_quantity").alias("f1"),
        (F.col("l_extendedprice") / 1000.0).alias("f2"), (F.col("l_discount") * 100.0).alias("f3"))
    return rounded(M.silhouette(li, ["f1", "f2", "f3"], "c"))

"""Feature-preparation queries (T1-T16) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import prep as T
from tabsense.workload.base import (LINEITEM_NULLS_SQL, lineitem_nulls, register, rounded,
                                    table)

LI_TYPES = [("l_orderkey", "bigint", "int"), ("l_partkey", "bigint", "int"),
            ("l_suppkey", "bigint", "int"), ("l_linenumber", "int", "int"),
            ("l_quantity", "double", "other"), ("l_extendedprice", "double", "other"),
            ("l_discount", "double", "other"), ("l_tax", "double", "other"),
            ("l_returnflag", "string", "text"), ("l_linestatus", "string", "text"),
            ("l_shipdate", "timestamp_ntz", "other")]


def _task_sql() -> str:
    parts = []
    for c, t, k in LI_TYPES:
        d = f"count(DISTINCT {c})"
        tt = ("'classification'" if k == "text" else
              f"CASE WHEN {d} <= 10 THEN 'classification' ELSE 'regression' END" if k == "int"
              else "'regression'")
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST({d} AS BIGINT) AS distinct_count, "
                     f"{tt} AS task_type FROM lineitem")
    return " UNION ALL ".join(parts)


@register("task_types", _task_sql())
def q_task_types(spark, sf):
    return T.task_types(table(spark, sf, "lineitem"))


@register("feature_select", """
WITH n AS (SELECT greatest(20.0, count(*) * 0.5)::DOUBLE AS lim, count(DISTINCT c_name) AS dn FROM customer)
SELECT 0 AS ord, 'c_custkey' AS "column", NULL::BIGINT AS distinct_count, lim AS "limit", true AS kept, NULL::VARCHAR AS reason FROM n
UNION ALL SELECT 1, 'c_name', CAST(dn AS BIGINT), lim, dn <= lim, CASE WHEN dn > lim THEN 'high-cardinality text' END FROM n
UNION ALL SELECT 2, 'c_nationkey', NULL, lim, true, NULL FROM n
UNION ALL SELECT 3, 'c_acctbal', NULL, lim, true, NULL FROM n""")
def q_feature_select(spark, sf):
    return T.feature_report(table(spark, sf, "customer"), "c_mktsegment")


@register("drop_null_target", f"""
SELECT l_orderkey, l_linenumber, l_quantity FROM {LINEITEM_NULLS_SQL} WHERE l_quantity IS NOT NULL""")
def q_drop_null_target(spark, sf):
    return T.drop_null_target(lineitem_nulls(spark, sf), "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@register("label_index", """
SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label
FROM orders""")
def q_label_index(spark, sf):
    df, _index = T.label_index(table(spark, sf, "orders"), "o_orderpriority")
    return df.select("o_orderkey", "o_orderpriority", "label")


@register("label_index_many", """
SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_orderkey) - 1 AS DOUBLE) AS label,
  count(*) OVER (PARTITION BY l_orderkey) AS n
FROM lineitem""")
def q_label_index_many(spark, sf):
    """One class an order: more classes than any list on the driver should hold."""
    df, index = T.label_index(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    return df.join(index.select(F.col("value").alias("l_orderkey"), "n"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "label", "n")


@register("impute_median", f"""
WITH t AS {LINEITEM_NULLS_SQL}
SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM t)), 6) AS l_discount FROM t""")
def q_impute_median(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(T.impute_median(df, ["l_quantity", "l_discount"]))


ORD_NULL_SQL = ("(SELECT o_orderkey, CASE WHEN o_totalprice < 60000 THEN NULL ELSE o_orderstatus END AS "
                "o_orderstatus, CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_orderpriority END AS "
                "o_orderpriority FROM orders)")


@register("impute_mode", f"""
WITH t AS {ORD_NULL_SQL},
ms AS (SELECT o_orderstatus AS v FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
mp AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT o_orderkey, coalesce(o_orderstatus, (SELECT v FROM ms)) AS o_orderstatus,
       coalesce(o_orderpriority, (SELECT v FROM mp)) AS o_orderpriority FROM t""")
def q_impute_mode(spark, sf):
    o = table(spark, sf, "orders")
    df = o.select("o_orderkey",
                  F.when(F.col("o_totalprice") < 60000, None).otherwise(F.col("o_orderstatus"))
                  .alias("o_orderstatus"),
                  F.when(F.col("o_totalprice") > 400000, None).otherwise(F.col("o_orderpriority"))
                  .alias("o_orderpriority"))
    return T.impute_mode(df, ["o_orderstatus", "o_orderpriority"])


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale_sql(center: str, scale: str) -> str:
    cols = ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT {center.format(c=c)} FROM lineitem)) / "
        f"(SELECT CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END FROM lineitem), 6) AS {c}"
        for c in SCALE_COLS)
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


@register("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def q_scale_standard(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return rounded(T.scale_standard(df, SCALE_COLS))


@register("scale_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))"))
def q_scale_minmax(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return rounded(T.scale_minmax(df, SCALE_COLS))


@register("scale_robust", _scale_sql("quantile_cont({c}, 0.5)",
                                     "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def q_scale_robust(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return rounded(T.scale_robust(df, SCALE_COLS))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("onehot", "SELECT o_orderkey, o_orderpriority, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"o_orderpriority_{p}\""
    for p in PRIORITIES) + " FROM orders")
def q_onehot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return T.onehot_columns(o, "o_orderpriority")


@register("onehot_sparse", """
SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS idx, 1.0::DOUBLE AS x,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS size
FROM lineitem""")
def q_onehot_sparse(spark, sf):
    df, _index = T.onehot_sparse(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", out="v")
    return df.select("l_orderkey", "l_linenumber", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"),
                     "v.size").select("l_orderkey", "l_linenumber", F.col("e.indices").alias("idx"),
                                      F.col("e.values").alias("x"), "size")


@register("split_counts")
def q_split_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    train, test = T.split(li, ["l_orderkey", "l_linenumber"], 20, 42)
    return (train.select(F.lit("train").alias("side")).unionByName(
        test.select(F.lit("test").alias("side"))).groupBy("side").count())


@register("cv_folds")
def q_cv_folds(spark, sf):
    li = table(spark, sf, "lineitem")
    return T.with_folds(li, ["l_orderkey", "l_linenumber"], 5).groupBy("fold").count()


@register("cluster_input", f"""
SELECT * FROM {LINEITEM_NULLS_SQL} WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
  AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_cluster_input(spark, sf):
    df, _feats = T.cluster_input(lineitem_nulls(spark, sf))
    return df

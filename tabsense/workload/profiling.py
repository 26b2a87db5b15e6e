"""Profiling queries (P1-P11, S11) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import profile as P
from tabsense.workload.base import (LINEITEM_NULLS_SQL, lineitem_nulls, register, rounded,
                                    table)

LI_COLS = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
           ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
           ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
LI_NUM = [c for c, t in LI_COLS if t in ("bigint", "int", "double")]
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def _missing_sql() -> str:
    counts = ", ".join(f"count_if({c} IS NULL) AS m{i}" for i, (c, _) in enumerate(LI_COLS))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{c}' AS \"column\", '{t}' AS dtype, CAST(m{i} AS BIGINT) AS missing_count, "
        f"round_even(100.0::DOUBLE * m{i} / total, 2) AS missing_pct FROM c"
        for i, (c, t) in enumerate(LI_COLS))
    return f"WITH t AS {LINEITEM_NULLS_SQL}, c AS (SELECT count(*) AS total, {counts} FROM t) {rows}"


@register("missing_values", _missing_sql())
def q_missing_values(spark, sf):
    return P.missing_values(lineitem_nulls(spark, sf))


@register("top_missing", f"""
WITH m AS ({_missing_sql()})
SELECT "column", missing_count, missing_pct, CAST(sum(missing_count) OVER () AS BIGINT) AS total_missing
FROM m WHERE missing_count > 0 ORDER BY missing_count DESC, ord LIMIT 5""")
def q_top_missing(spark, sf):
    return P.top_missing(lineitem_nulls(spark, sf)).withColumn(
        "total_missing", F.col("total_missing").cast("bigint"))


@register("basic_info", "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS BIGINT) AS column_count FROM events")
def q_basic_info(spark, sf):
    return P.basic_info(table(spark, sf, "events")).drop("columns")


@register("duplicate_rows", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS BIGINT)
  AS duplicate_rows FROM events""")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "events").select("user_id", "event_type"))


def _numeric_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS ord, '{c}' AS \"column\", CAST(count({x}) AS BIGINT) AS count, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
            f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {src}")
    return " UNION ALL ".join(parts)


@register("numeric_summary", f"WITH t AS {LINEITEM_NULLS_SQL} " + _numeric_sql("t", LI_NUM))
def q_numeric_summary(spark, sf):
    return rounded(P.numeric_summary(lineitem_nulls(spark, sf)))


def _cat_counts_sql(tbl: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ord, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS cnt "
        f"FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(cols))


@register("categorical_top", f"""
SELECT ord, "column", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value ASC) AS rank
  FROM ({_cat_counts_sql('orders', ORDER_CAT)})) WHERE rank <= 10""")
def q_categorical_top(spark, sf):
    return P.categorical_top(table(spark, sf, "orders"), 10)


@register("categorical_distinct", f"""
SELECT ord, "column", CAST(count(*) AS BIGINT) AS distinct_count
FROM ({_cat_counts_sql('orders', ORDER_CAT)}) GROUP BY ord, "column\"""")
def q_categorical_distinct(spark, sf):
    return P.categorical_distinct(table(spark, sf, "orders"))


def _corr_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ord_a, {j} AS ord_b, '{a}' AS col_a, '{b}' AS col_b, "
        f"round(coalesce(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0), 6) AS r FROM {src}"
        for i, a in enumerate(cols) for j, b in enumerate(cols))


@register("correlation_matrix", f"WITH t AS {LINEITEM_NULLS_SQL} " + _corr_sql("t", CORR_COLS))
def q_correlation_matrix(spark, sf):
    return rounded(P.correlation_matrix(lineitem_nulls(spark, sf), CORR_COLS))


@register("top_correlation", f"""
WITH t AS {LINEITEM_NULLS_SQL}, c AS ({_corr_sql('t', CORR_COLS)})
SELECT col_a, col_b, r FROM c WHERE ord_a < ord_b AND r <> 0 ORDER BY abs(r) DESC, ord_a, ord_b LIMIT 1""")
def q_top_correlation(spark, sf):
    cm = P.correlation_matrix(lineitem_nulls(spark, sf), CORR_COLS)
    return rounded(P.top_correlation(cm))


EV_SQL = ("(SELECT user_id, CASE WHEN value > 100 THEN NULL ELSE value END AS value, event_type "
          "FROM events)")


def events_small(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("user_id", F.when(F.col("value") > 100, None).otherwise(F.col("value"))
                     .alias("value"), "event_type")


def _full_profile_sql() -> str:
    num = ["user_id", "value"]
    parts = [
        "SELECT 'basic' AS section, NULL::VARCHAR AS \"column\", 'row_count' AS metric, "
        "CAST(count(*) AS DOUBLE) AS value FROM t",
        "SELECT 'basic', NULL, 'column_count', 3.0::DOUBLE",
        "SELECT 'duplicates', NULL, 'duplicate_rows', CAST(count(*) - (SELECT count(*) FROM "
        "(SELECT DISTINCT * FROM t)) AS DOUBLE) FROM t",
    ]
    for c in ["user_id", "value", "event_type"]:
        parts.append(f"SELECT 'missing', '{c}', 'missing_count', CAST(count_if({c} IS NULL) AS DOUBLE) FROM t")
        parts.append(f"SELECT 'missing', '{c}', 'missing_pct', "
                     f"round_even(100.0::DOUBLE * count_if({c} IS NULL) / count(*), 2) FROM t")
    for c in num:
        x = f"CAST({c} AS DOUBLE)"
        for m, e in [("count", f"count({x})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                     ("min", f"min({x})"), ("p25", f"quantile_cont({x}, 0.25)"),
                     ("p50", f"quantile_cont({x}, 0.5)"), ("p75", f"quantile_cont({x}, 0.75)"),
                     ("max", f"max({x})")]:
            parts.append(f"SELECT 'numeric', '{c}', '{m}', round(CAST({e} AS DOUBLE), 6) FROM t")
    for a in num:
        for b in num:
            parts.append(f"SELECT 'correlation', '{a}', '{b}', round(coalesce(corr(CAST({a} AS DOUBLE), "
                         f"CAST({b} AS DOUBLE)), 0), 6) FROM t")
    parts.append("SELECT 'categorical', 'event_type', 'distinct_count', "
                 "CAST(count(DISTINCT event_type) AS DOUBLE) FROM t")
    parts.append("SELECT 'top_values', 'event_type', value, CAST(cnt AS DOUBLE) FROM ("
                 "SELECT event_type AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, "
                 "event_type) AS rk FROM t WHERE event_type IS NOT NULL GROUP BY event_type) WHERE rk <= 10")
    return f"WITH t AS {EV_SQL} " + " UNION ALL ".join(parts)


@register("full_profile", _full_profile_sql())
def q_full_profile(spark, sf):
    return rounded(P.full_profile(events_small(spark, sf)))


@register("profile_headline", f"""
WITH t AS {EV_SQL}
SELECT 'rows' AS metric, NULL::VARCHAR AS "column", CAST(count(*) AS DOUBLE) AS value FROM t
UNION ALL SELECT 'mean', 'user_id', round(avg(user_id), 6) FROM t
UNION ALL SELECT 'mean', 'value', round(avg(value), 6) FROM t
UNION ALL SELECT 'duplicate_rows', NULL, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS DOUBLE) FROM t
UNION ALL SELECT 'top_correlation', 'user_id|value', round(corr(user_id, value), 6) FROM t
  WHERE (SELECT coalesce(corr(user_id, value), 0) FROM t) <> 0""")
def q_profile_headline(spark, sf):
    return rounded(P.profile_headline(events_small(spark, sf)))


@register("preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10")
def q_preview(spark, sf):
    return P.preview(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 10)

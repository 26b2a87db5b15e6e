"""Outlier queries (O1-O6) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import outliers as O
from tabsense.workload.base import register, rounded, table

EV_NUM = ["event_id", "user_id", "value"]
DOC_NUM = ["doc_id", "n_chars"]


def _iqr_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT {i} AS ord, '{c}' AS "column", 'IQR' AS method,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
  CAST((SELECT count_if({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) FROM {tbl}) AS BIGINT) AS outlier_count,
  round_even((SELECT count_if({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) FROM {tbl})::DOUBLE
             / (SELECT count(*) FROM {tbl}) * 100, 2) AS outlier_pct
FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {tbl})""")
    return " UNION ALL ".join(parts)


def _z_sql(tbl: str, cols: list[str], t: float = 3.0) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        cnt = f"(SELECT count_if(abs(({x} - mu) / sd) > {t}) FROM {tbl})"
        parts.append(f"""SELECT {i} AS ord, '{c}' AS "column", 'Z-score' AS method,
  CAST({cnt} AS BIGINT) AS outlier_count,
  round_even({cnt}::DOUBLE / (SELECT count(*) FROM {tbl}) * 100, 2) AS outlier_pct
FROM (SELECT avg({x}) AS mu, stddev_samp({x}) AS sd FROM {tbl}) WHERE sd <> 0""")
    return " UNION ALL ".join(parts)


@register("outliers_iqr", _iqr_sql("events", EV_NUM))
def q_outliers_iqr(spark, sf):
    return rounded(O.outliers_iqr(table(spark, sf, "events")))


@register("outliers_iqr_documents", _iqr_sql("documents", DOC_NUM))
def q_outliers_iqr_documents(spark, sf):
    return rounded(O.outliers_iqr(table(spark, sf, "documents")))


@register("outliers_zscore", _z_sql("events", EV_NUM))
def q_outliers_zscore(spark, sf):
    return rounded(O.outliers_zscore(table(spark, sf, "events")))


@register("outliers_zscore_documents", _z_sql("documents", DOC_NUM))
def q_outliers_zscore_documents(spark, sf):
    return rounded(O.outliers_zscore(table(spark, sf, "documents")))


@register("outliers_all", f"""
SELECT ord, "column", method, NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound, outlier_count, outlier_pct
FROM ({_z_sql('events', EV_NUM)}) WHERE outlier_count > 0""")
def q_outliers_all(spark, sf):
    return rounded(O.outliers_all(table(spark, sf, "events"), "z-score", only_found=True))


@register("outlier_rows", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS is_outlier
FROM events, b""")
def q_outlier_rows(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return O.outlier_rows(ev, "value", "iqr")


@register("top_outliers", f"""
SELECT * FROM ({_iqr_sql('documents', DOC_NUM)}) WHERE outlier_count > 0
ORDER BY outlier_count DESC, "column" LIMIT 6""")
def q_top_outliers(spark, sf):
    return rounded(O.top_outliers(O.outliers_iqr(table(spark, sf, "documents"))))

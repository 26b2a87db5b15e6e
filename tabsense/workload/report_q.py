"""Report, summary and step-runner queries (H1-H3)."""
from __future__ import annotations

from tabsense.plans import report as H
from tabsense.workload.base import LINEITEM_NULLS_SQL, lineitem_nulls, register, rounded, table
from tabsense.workload.outlier_q import _iqr_sql
from tabsense.workload.profiling import LI_NUM, _missing_sql, _numeric_sql


def _report_sql() -> str:
    t = "t"
    miss = f"({_missing_sql()})"
    num = f"({_numeric_sql(t, LI_NUM)})"
    iqr = f"(SELECT * FROM ({_iqr_sql(t, LI_NUM)}) WHERE outlier_count > 0 ORDER BY ord LIMIT 25)"
    parts = [
        f"SELECT 1 AS section, 0 AS ord, NULL::VARCHAR AS \"column\", 'rows' AS metric, "
        f"CAST(count(*) AS DOUBLE) AS value, NULL::VARCHAR AS text FROM {t}",
        "SELECT 1, 1, NULL, 'columns', 9.0::DOUBLE, NULL",
        f"SELECT 1, 2, NULL, 'duplicate_rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) "
        f"AS DOUBLE), NULL FROM {t}",
        f"SELECT 1, 3, NULL, 'total_missing', CAST(sum(missing_count) AS DOUBLE), NULL FROM {miss}",
        f"SELECT 2, ord, \"column\", 'missing_count', CAST(missing_count AS DOUBLE), dtype FROM {miss}",
        f"SELECT 2, ord, \"column\", 'missing_pct', missing_pct, dtype FROM {miss}",
    ]
    for m in ("mean", "std", "min", "p50", "max"):
        parts.append(f"SELECT 3, ord, \"column\", '{m}', {m}, NULL FROM {num}")
    for m in ("outlier_count", "outlier_pct", "lower_bound", "upper_bound"):
        parts.append(f"SELECT 4, ord, \"column\", '{m}', CAST({m} AS DOUBLE), NULL FROM {iqr}")
    return f"WITH t AS {LINEITEM_NULLS_SQL} " + " UNION ALL ".join(parts)


@register("report_tables", _report_sql())
def q_report_tables(spark, sf):
    return rounded(H.report_tables(lineitem_nulls(spark, sf), with_charts=False))


STEPS = [{"tool": "eda", "args": {}},
         {"tool": "outliers", "args": {"method": "z-score"}},
         {"tool": "chart", "args": {"chart_type": "hist", "x": "c_acctbal"}},
         {"tool": "chart", "args": {"chart_type": "box", "x": "c_mktsegment", "y": "c_acctbal"}},
         {"tool": "explain_model", "args": {}},
         {"tool": "bogus", "args": {}},
         {"tool": "report", "args": {}}]


@register("run_steps")
def q_run_steps(spark, sf):
    ctx = H.StepContext(table(spark, sf, "customer"))
    status, _outputs = H.run_steps(ctx, STEPS)
    return status


def _summary_sql() -> str:
    """The four summary lines: profile counts and the z-score outlier columns come
    from the table; the two chart steps end as fixed texts (an unknown kind fails,
    the box plot succeeds)."""
    from tabsense.operators.charts import CHART_TYPES
    cols = ["c_custkey", "c_nationkey", "c_acctbal"]
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(cols))
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, count_if(abs(({c} - m{i}) / s{i}) > 3.0) AS n FROM customer, s WHERE s{i} <> 0"
        for i, c in enumerate(cols))
    failed = f"chart failed: unknown chart type 'hist'; known: {', '.join(CHART_TYPES)}"
    return f"""
WITH s AS (SELECT {stats} FROM customer),
o AS ({counts}),
t AS (SELECT string_agg(col || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, col) AS top
      FROM (SELECT * FROM o WHERE n > 0 ORDER BY n DESC, col LIMIT 6) k)
SELECT 0 AS step, 'profile: ' || CAST(count(*) AS VARCHAR) || ' rows, 5 columns, '
       || CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer) d) AS VARCHAR)
       || ' duplicate rows' AS line FROM customer
UNION ALL SELECT 1, 'outliers (zscore): ' || coalesce(top, 'none found') FROM t
UNION ALL SELECT 2, '{failed.replace("'", "''")}'
UNION ALL SELECT 3, 'chart: box_plot'"""


@register("summary_lines", _summary_sql())
def q_summary_lines(spark, sf):
    ctx = H.StepContext(table(spark, sf, "customer"))
    _status, outputs = H.run_steps(ctx, STEPS[:4])
    lines = H.summary_lines(outputs)
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "step int, line string")

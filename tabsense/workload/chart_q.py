"""Chart-aggregate queries (V1-V15) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import charts as C
from tabsense.workload.base import register, rounded, table
from tabsense.workload.profiling import _corr_sql

Z = C.Z95


@register("chart_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n,
                  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
l AS (SELECT lo, hi, CAST(greatest(1, ceil((hi - lo) /
        CASE WHEN 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) > 0
             THEN least(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1.0))
             ELSE (hi - lo) / (log2(n) + 1.0) END)) AS INTEGER) AS bins FROM s),
b AS (SELECT least(bins - 1, CAST(floor((value - lo) / ((hi - lo) / bins)) AS INTEGER)) AS bin, lo, hi, bins
      FROM events, l WHERE value IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / bins), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / bins), 6) AS bin_hi,
       CAST(count(*) AS BIGINT) AS count FROM b GROUP BY bin, lo, hi, bins""")
def q_chart_histogram(spark, sf):
    return rounded(C.histogram(table(spark, sf, "events"), "value"))


@register("chart_bar_mean", f"""
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean,
  round(avg(l_extendedprice) - {Z} * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci_lo,
  round(avg(l_extendedprice) + {Z} * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci_hi,
  CAST(count(l_extendedprice) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_chart_bar_mean(spark, sf):
    return rounded(C.bar_mean(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice",
                              "l_linestatus"))


@register("chart_count", """
SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS count FROM orders
GROUP BY o_orderpriority, o_orderstatus""")
def q_chart_count(spark, sf):
    return C.count_plot(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@register("chart_scatter_bins", """
WITH s AS (SELECT min(l_quantity) AS xlo, max(l_quantity) AS xhi, min(l_extendedprice) AS ylo,
                  max(l_extendedprice) AS yhi FROM lineitem),
b AS (SELECT least(49, CAST(floor((l_quantity - xlo) / ((xhi - xlo) / 50)) AS INTEGER)) AS bx,
             least(49, CAST(floor((l_extendedprice - ylo) / ((yhi - ylo) / 50)) AS INTEGER)) AS "by",
             xlo, xhi, ylo, yhi FROM lineitem, s)
SELECT bx, "by", round(xlo + (bx + 0.5) * ((xhi - xlo) / 50), 6) AS x_mid,
       round(ylo + ("by" + 0.5) * ((yhi - ylo) / 50), 6) AS y_mid, CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY bx, "by", xlo, xhi, ylo, yhi""")
def q_chart_scatter_bins(spark, sf):
    return rounded(C.scatter_bins(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 50))


@register("chart_line", f"""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(avg(value), 6) AS mean,
  round(avg(value) - {Z} * stddev_samp(value) / sqrt(count(value)), 6) AS ci_lo,
  round(avg(value) + {Z} * stddev_samp(value) / sqrt(count(value)), 6) AS ci_hi,
  CAST(count(value) AS BIGINT) AS n
FROM events GROUP BY 1""")
def q_chart_line(spark, sf):
    return rounded(C.line_chart(table(spark, sf, "events"), "ts", "value", time_unit="day"))


@register("chart_box", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem GROUP BY l_returnflag)
SELECT q.l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 6) AS whisker_lo,
  round(max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 6) AS whisker_hi,
  CAST(count_if(NOT (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS fliers,
  CAST(count(*) AS BIGINT) AS n
FROM lineitem JOIN q ON lineitem.l_returnflag = q.l_returnflag
GROUP BY q.l_returnflag, q1, median, q3""")
def q_chart_box(spark, sf):
    return rounded(C.box_plot(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@register("chart_pie_count", """
SELECT c_nationkey, count, round(count / sum(count) OVER (), 6) AS share FROM (
  SELECT c_nationkey, CAST(count(*) AS BIGINT) AS count FROM customer WHERE c_nationkey IS NOT NULL
  GROUP BY c_nationkey ORDER BY count DESC, c_nationkey LIMIT 10)""")
def q_chart_pie_count(spark, sf):
    return rounded(C.pie_count(table(spark, sf, "customer"), "c_nationkey"))


@register("chart_pie_sum", """
SELECT l_suppkey, round(sum, 6) AS sum, round(sum / sum(sum) OVER (), 6) AS share FROM (
  SELECT l_suppkey, sum(l_extendedprice) AS sum FROM lineitem WHERE l_suppkey IS NOT NULL
  GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 10)""")
def q_chart_pie_sum(spark, sf):
    return rounded(C.pie_sum(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice"))


@register("chart_heatmap", _corr_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_chart_heatmap(spark, sf):
    return rounded(C.heatmap(table(spark, sf, "orders")))


def _density_sql(src: str, value: str, group: str, grid: int, fine_bins: int = 2048,
                 cut: float = 3.0) -> str:
    """Gaussian KDE on a grid from fine-bin centres, the same arithmetic as V11."""
    v = f"CAST({value} AS DOUBLE)"
    z = f"((glo + point * step - c) / h)"
    return f"""
WITH base AS (SELECT {group}, {v} AS v FROM {src} WHERE {value} IS NOT NULL AND NOT isnan({v})),
st AS (SELECT {group}, min(v) AS lo, max(v) AS hi, count(*) AS n,
              stddev_samp(v) * pow(count(*), -0.2) AS h FROM base GROUP BY {group}),
s2 AS (SELECT *, lo - {cut} * h AS glo, hi + {cut} * h AS ghi FROM st WHERE h > 0),
fb AS (SELECT base.{group} AS {group},
              least({fine_bins - 1}, CAST(floor((v - lo) / ((hi - lo) / {fine_bins})) AS INTEGER)) AS b,
              count(*) AS w, avg(v) AS c
       FROM base JOIN s2 ON base.{group} = s2.{group} GROUP BY 1, 2),
pts AS (SELECT fb.{group} AS {group}, w, c, h, n, glo, (ghi - glo) / {grid - 1} AS step,
               CAST(p.point AS INTEGER) AS point
        FROM fb JOIN s2 ON fb.{group} = s2.{group} CROSS JOIN range(0, {grid}) p(point))
SELECT {group}, point, round(glo + point * step, 6) AS x,
       round(sum(w * exp(-0.5 * {z} * {z}) / (n * h * sqrt(2 * pi()))), 6) AS density
FROM pts GROUP BY {group}, point, glo, step"""


@register("chart_density", _density_sql("events", "value", "event_type", 200))
def q_chart_density(spark, sf):
    return rounded(C.density(table(spark, sf, "events"), "value", "event_type"))


def _quartiles_sql(src: str, value: str, group: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {group}, 'box' AS part, CAST({k} AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS at,
       round(quantile_cont({value}, {k}), 6) AS value FROM {src} WHERE {value} IS NOT NULL GROUP BY {group}"""
        for k in (0.25, 0.5, 0.75))


@register("chart_violin", f"""
SELECT l_returnflag, 'density' AS part, CAST(point AS DOUBLE) AS k, x AS at, density AS value
FROM ({_density_sql("lineitem", "l_extendedprice", "l_returnflag", 100)}) d
UNION ALL {_quartiles_sql("lineitem", "l_extendedprice", "l_returnflag")}""")
def q_chart_violin(spark, sf):
    return rounded(C.violin(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


_FLAGS = "(SELECT l_returnflag || '/' || l_linestatus AS g, l_quantity FROM lineitem) s"


@register("chart_violin_hue", f"""
SELECT split_part(g, '/', 1) AS l_returnflag, split_part(g, '/', 2) AS l_linestatus, part, k, "at", value FROM (
SELECT g, 'density' AS part, CAST(point AS DOUBLE) AS k, x AS at, density AS value
FROM ({_density_sql(_FLAGS, "l_quantity", "g", 100)}) d
UNION ALL {_quartiles_sql(_FLAGS, "l_quantity", "g")}) v""")
def q_chart_violin_hue(spark, sf):
    return rounded(C.violin(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus"))


def _pairs_sql(src: str, cols: list[str], bins: int = 20) -> str:
    """2-D bins of every pair (a <= b) and 1-D bins on the diagonal, as V12."""
    stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo{i}, max(CAST({c} AS DOUBLE)) AS hi{i}"
                      for i, c in enumerate(cols))

    def idx(c: str, i: int) -> str:
        hi = f"(CASE WHEN hi{i} > lo{i} THEN hi{i} ELSE lo{i} + 1.0 END)"
        return (f"least({bins - 1}, CAST(floor((CAST({c} AS DOUBLE) - lo{i}) / "
                f"(({hi} - lo{i}) / {bins})) AS INTEGER))")

    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            by = idx(b, j) if j != i else "0"
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, bx, "by", CAST(count(*) AS BIGINT) AS count
FROM (SELECT {idx(a, i)} AS bx, {by} AS "by" FROM {src}, s) t
WHERE bx IS NOT NULL AND "by" IS NOT NULL GROUP BY bx, "by\"""")
    return f"WITH s AS (SELECT {stats} FROM {src})\n" + "\nUNION ALL\n".join(parts)


PAIR_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@register("chart_pairs", _pairs_sql("lineitem", PAIR_COLS))
def q_chart_pairs(spark, sf):
    return C.pair_plot(table(spark, sf, "lineitem"))


def _hist_sql(src: str, col: str) -> str:
    """V1 bins (numpy 'auto' width) and counts of one column."""
    v = f"CAST({col} AS DOUBLE)"
    return f"""
WITH s AS (SELECT min({v}) AS lo, max({v}) AS hi, count({v}) AS n,
                  quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {src}),
l AS (SELECT lo, hi, CAST(greatest(1, ceil((hi - lo) /
        CASE WHEN 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) > 0
             THEN least(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1.0))
             ELSE (hi - lo) / (log2(n) + 1.0) END)) AS INTEGER) AS bins FROM s),
b AS (SELECT least(bins - 1, CAST(floor(({v} - lo) / ((hi - lo) / bins)) AS INTEGER)) AS bin
      FROM {src}, l WHERE {col} IS NOT NULL)
SELECT bin, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY bin"""


AUTO_NUM = ["o_totalprice", "o_custkey"]


@register("auto_charts", f"""
SELECT 0 AS chart, 'heatmap' AS chart_type, col_a AS x, col_b AS key, r AS value
FROM ({_corr_sql("orders", AUTO_NUM)}) c
UNION ALL
SELECT 1, 'histogram', 'o_totalprice', CAST(bin AS VARCHAR), CAST(count AS DOUBLE)
FROM ({_hist_sql("orders", "o_totalprice")}) h1
UNION ALL
SELECT 2, 'histogram', 'o_custkey', CAST(bin AS VARCHAR), CAST(count AS DOUBLE)
FROM ({_hist_sql("orders", "o_custkey")}) h2""")
def q_auto_charts(spark, sf):
    return rounded(C.auto_charts(table(spark, sf, "orders").select(
        "o_totalprice", "o_custkey", "o_orderstatus", F.col("o_orderdate"))))

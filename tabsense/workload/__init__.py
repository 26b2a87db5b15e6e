"""Registered queries over the driver tables: each is ``fn(spark, sf_dir) -> DataFrame``
paired (where SQL can express it) with an equivalent DuckDB statement.

Computed columns carry the same alias on both sides, doubles are rounded to 6
decimals on both sides and percentages to 2 (half-to-even).
"""
from __future__ import annotations

from tabsense.workload.base import QUERIES, SQL  # noqa: F401
from tabsense.workload import (  # noqa: F401  (imports register the queries)
    profiling, outlier_q, chart_q, metric_q, prep_q, model_q, catalog_q, request_q, report_q,
    source_q,
)

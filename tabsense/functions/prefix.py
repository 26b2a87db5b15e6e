"""Running totals over a sorted key without a single-partition window.

A window ``ORDER BY`` without ``PARTITION BY`` moves every row to one task.
``exclusive_prefix`` splits each group into deterministic range buckets
(``functions/buckets.py``), sums inside each bucket with a window partitioned by
``(group, bucket)``, and adds the totals of the group's earlier buckets (a frame
of at most groups x buckets rows).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.buckets import (BUCKET, group_bounds, ranged_offsets,
                                        shuffle_partitions, with_buckets)


def exclusive_prefix(df: DataFrame, keys: Sequence[str], order: str, value: str,
                     out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``keys`` group whose
    ``order`` is strictly smaller.  ``order`` must be unique within a group."""
    keys = list(keys)
    parts = partitions or shuffle_partitions(df)
    bounds, small = group_bounds(df, keys, order, parts)
    b = with_buckets(df, keys, order, bounds, small, parts)
    before = Window.partitionBy(*keys, BUCKET).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = b.withColumn("_loc", F.coalesce(F.sum(value).over(before), F.lit(0)))
    offsets = ranged_offsets(b, keys, value, small).drop("_n")
    return (local.join(offsets, on=[*keys, BUCKET])
            .withColumn(out, F.col("_off") + F.col("_loc")).drop(BUCKET, "_loc", "_off"))

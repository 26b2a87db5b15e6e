"""Deterministic range buckets inside groups, the shared step of exact quantiles
and running sums.

A running count over a sorted key needs the rows of a group in order.  Putting a
whole group in one task does not scale (one column of a profile, or one hot
group, may hold a third of the table), and ``repartitionByRange`` samples its
bounds anew each time its plan is executed: two branches of one plan (local sums
and partition totals) may see different bounds after a stage retry.  Here each
group gets its own bounds instead:

1. one sketch pass over a Bernoulli sample: ``percentile_approx`` at ``parts - 1``
   even probabilities per group (mergeable, partial aggregation);
2. the bounds are fixed once (collected when small, else checkpointed into the
   shared checkpoint folder), so every later branch and every retry reads the
   same values;
3. a row's bucket is the number of bounds <= its value, found with a two-level
   lookup (about 2 * sqrt(parts) comparisons).

A bucket holds about ``rows / parts`` rows of its group, so at most that many
distinct values.  The bounds frame has one row per group and at most
``parts - 1`` doubles; it is broadcast only when that size is under the
session's broadcast threshold, otherwise joined by key (AQE splits a skewed key).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.session import cut_lineage

BUCKET = "_bkt"
ACCURACY = 10000
SAMPLE_RATE = 0.01
SEED = 42


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def broadcast_limit(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = str(raw).strip().lower()
    mult = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for suffix in ("kb", "mb", "gb", "b", "k", "m", "g"):
        if raw.endswith(suffix):
            return int(float(raw[: -len(suffix)]) * mult[suffix[0]])
    return int(raw)


def group_bounds(source: DataFrame, keys: Sequence[str], value: str,
                 parts: int | None = None,
                 stats: dict[str, Column] | None = None) -> tuple[DataFrame, bool]:
    """``keys + _bounds`` (sorted distinct approximate quantiles of ``value`` per
    group, sketched over a ``SAMPLE_RATE`` Bernoulli sample of its non-null rows)
    and whether the frame is small enough to broadcast.

    ``stats`` (name -> aggregate over all rows of the group) ride along in the same
    scan, so a caller that needs them anyway (the numeric summary's count, mean,
    std, min and max) does not read the data again.

    The bounds only balance the buckets; any bounds give exact results.  A group
    too small to be sampled gets no bounds (one bucket), which is fine because it
    is small.  The bounds are fixed once: a small frame is collected and
    re-created as a local relation (bounded: the broadcast threshold), a larger
    one is checkpointed into the shared checkpoint folder.
    """
    keys = list(keys)
    parts = max(2, parts or shuffle_partitions(source))
    probs = [i / parts for i in range(1, parts)]
    v = F.col(value)
    picked = F.when(v.isNotNull() & (F.rand(SEED) < F.lit(SAMPLE_RATE)), v)
    src = source.select(*keys, value, picked.alias("_smp"))
    if not stats:
        src = src.where(v.isNotNull())
    aggs = [F.array_distinct(F.percentile_approx("_smp", probs, ACCURACY)).alias("_bounds")]
    aggs += [c.alias(n) for n, c in (stats or {}).items()]
    bounds = src.groupBy(*keys).agg(*aggs)
    cap = max(1, broadcast_limit(source) // (parts * 8 + 64))
    rows = bounds.limit(cap + 1).collect()
    if len(rows) <= cap:
        return source.sparkSession.createDataFrame(rows, bounds.schema), True
    return cut_lineage(bounds), False


def local_if_small(df: DataFrame, row_bytes: int = 256) -> DataFrame | None:
    """``df`` re-created as a local relation (safe to broadcast) when its rows fit
    the session's broadcast threshold at ``row_bytes`` each; None otherwise.  At
    most threshold / row_bytes + 1 rows reach the driver."""
    cap = max(1, broadcast_limit(df) // row_bytes)
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def bucket_of(value: Column, bounds: Column, parts: int) -> Column:
    """Number of entries of the sorted array ``bounds`` that are <= ``value``."""
    step = max(1, int(math.ceil(math.sqrt(parts))))
    coarse = F.filter(bounds, lambda x, i: i % step == 0)
    c = F.size(F.filter(coarse, lambda x: x <= value))
    base = (c - 1) * step
    fine = F.size(F.filter(F.slice(bounds, F.greatest(base + 1, F.lit(1)), F.lit(step)),
                           lambda x: x <= value))
    return F.when(c == 0, F.lit(0)).otherwise(base + fine).cast("int")


def with_buckets(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame,
                 small: bool, parts: int | None = None) -> DataFrame:
    """``df`` plus ``_bkt`` from the group's bounds (groups without bounds: 0)."""
    keys = list(keys)
    parts = max(2, parts or shuffle_partitions(df))
    bounds = bounds.select(*keys, "_bounds")
    b = F.broadcast(bounds) if small else bounds
    j = df.join(b, on=keys, how="left") if keys else df.crossJoin(F.broadcast(bounds))
    bkt = F.coalesce(bucket_of(F.col(value), F.col("_bounds"), parts), F.lit(0))
    return j.withColumn(BUCKET, bkt).drop("_bounds")


def ranged_offsets(df: DataFrame, keys: Sequence[str], weight: str, small: bool) -> DataFrame:
    """Per ``(keys, _bkt)``: ``_off`` = total ``weight`` of the group's earlier
    buckets and ``_n`` = the group total.  One row per bucket (<= groups x parts);
    broadcast under the same size check as the bounds."""
    from pyspark.sql import Window

    keys = list(keys)
    totals = df.groupBy(*keys, BUCKET).agg(F.sum(weight).alias("_bt"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    out = totals.select(*keys, BUCKET,
                        F.coalesce(F.sum("_bt").over(before), F.lit(0)).alias("_off"),
                        F.sum("_bt").over(whole).alias("_n"))
    return F.broadcast(out) if small else out

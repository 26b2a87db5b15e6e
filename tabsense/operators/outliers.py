"""Outlier detection: Tukey fences (IQR) and z-score, per column and row-level.

Counts use strict inequalities; the percentage is of *all* rows (NULLs included)
while the fences come from the non-null values, as the reference does.
All numeric columns are handled in the same two passes over an unpivoted frame;
the per-column bounds frame has one row per column, so broadcasting it is safe.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions import kinds as K
from tabsense.functions.quantiles import quantiles
from tabsense.operators.profile import column_name, long_numeric


def normalise_method(method: str | None) -> str:
    """O5: 'z-score', 'zscore', 'Z_SCORE' -> zscore; anything else -> iqr."""
    m = str(method or "iqr").lower().replace("-", "").replace("_", "")
    return "zscore" if m == "zscore" else "iqr"


def _check_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"column not found: {c}")
        if not K.is_numeric(K.dtype_of(df, c)):
            raise ValueError(f"{c} is not numeric")


def fences(qs: DataFrame) -> DataFrame:
    """Tukey fences from a frame of ``ord, column, q1, q3``."""
    iqr = F.col("q3") - F.col("q1")
    return qs.select("ord", "column", "q1", "q3",
                     (F.col("q1") - 1.5 * iqr).alias("lower_bound"),
                     (F.col("q3") + 1.5 * iqr).alias("upper_bound"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    long = long_numeric(df, cols).drop("column")
    qs = quantiles(long, ["ord"], "value", (0.25, 0.75), ("q1", "q3"), approx=approx)
    return fences(qs.withColumn("column", column_name(cols)))


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None,
                 approx: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """O1: Tukey fences and strict outlier counts per numeric column.

    ``bounds`` (``ord, lower_bound, upper_bound`` for the same ``cols``) lets a
    caller that already has the quartiles (the report's numeric summary) skip a
    second quantile job."""
    cols = list(cols) if cols is not None else K.numeric_columns(df)
    _check_numeric(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    bounds = bounds if bounds is not None else iqr_bounds(df, cols, approx)
    long = long_numeric(df, cols)
    flagged = long.join(F.broadcast(bounds.select("ord", "lower_bound", "upper_bound")),
                        on="ord", how="left")
    out = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    counts = flagged.groupBy("ord").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(out).alias("outlier_count"),
        F.first("lower_bound", ignorenulls=True).alias("lower_bound"),
        F.first("upper_bound", ignorenulls=True).alias("upper_bound"))
    pct = F.try_divide(F.col("outlier_count").cast("double"), F.col("_rows")) * 100
    return counts.select("ord", names[F.col("ord")].alias("column"), F.lit("IQR").alias("method"),
                         "lower_bound", "upper_bound",
                         F.col("outlier_count").cast("bigint").alias("outlier_count"),
                         K.pct2(pct).alias("outlier_pct"))


def outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None,
                    threshold: float = 3.0, keep_errors: bool = False) -> DataFrame:
    """O2: |(x - mean) / std| > threshold with the sample std.

    A column whose std is exactly 0 is an error in the reference; it is dropped
    here unless ``keep_errors`` (then ``error`` says why).
    """
    cols = list(cols) if cols is not None else K.numeric_columns(df)
    _check_numeric(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    long = long_numeric(df, cols)
    stats = long.groupBy("ord").agg(F.avg("value").alias("mu"),
                                    F.stddev_samp("value").alias("sd"))
    flagged = long.join(F.broadcast(stats), on="ord", how="left")
    z = F.abs((F.col("value") - F.col("mu")) / F.col("sd"))
    counts = flagged.groupBy("ord").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if((F.col("sd") != 0) & (z > F.lit(float(threshold)))).alias("outlier_count"),
        F.first("sd", ignorenulls=True).alias("_sd"))
    pct = F.try_divide(F.col("outlier_count").cast("double"), F.col("_rows")) * 100
    res = counts.select("ord", names[F.col("ord")].alias("column"), F.lit("Z-score").alias("method"),
                        F.col("outlier_count").cast("bigint").alias("outlier_count"),
                        K.pct2(pct).alias("outlier_pct"),
                        F.when(F.col("_sd") == 0, F.concat(F.lit("std of "),
                                                           names[F.col("ord")],
                                                           F.lit(" is zero"))).alias("error"))
    if keep_errors:
        return res
    return res.where(F.col("error").isNull()).drop("error")


def detect(df: DataFrame, column: str, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """Single-column entry point; raises ValueError on a non-numeric column."""
    if normalise_method(method) == "zscore":
        res = outliers_zscore(df, [column], threshold, keep_errors=True)
    else:
        res = outliers_iqr(df, [column])
    return res


def outliers_all(df: DataFrame, method: str = "iqr", threshold: float = 3.0,
                 only_found: bool = False) -> DataFrame:
    """Every numeric column by one method; error columns left out;
    ``only_found`` keeps the columns with at least one outlier."""
    m = normalise_method(method)
    cols = K.numeric_columns(df)
    if m == "zscore":
        res = outliers_zscore(df, cols, threshold).select(
            "ord", "column", "method", F.lit(None).cast("double").alias("lower_bound"),
            F.lit(None).cast("double").alias("upper_bound"), "outlier_count", "outlier_pct")
    else:
        res = outliers_iqr(df, cols)
    return res.where(F.col("outlier_count") > 0) if only_found else res


def outlier_rows(df: DataFrame, column: str, method: str = "iqr",
                 threshold: float = 3.0) -> DataFrame:
    """The input rows with an ``is_outlier`` flag for one column.

    The fences are scalar subqueries (one value each), so no join is needed.
    """
    _check_numeric(df, [column])
    x = K.as_double(df, column)
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull())
    if normalise_method(method) == "zscore":
        mu = vals.agg(F.avg("v")).scalar()
        sd = vals.agg(F.stddev_samp("v")).scalar()
        flag = F.abs(F.try_divide(x - mu, sd)) > F.lit(float(threshold))
    else:
        bounds = iqr_bounds(df, [column])
        lo = bounds.select("lower_bound").scalar()
        hi = bounds.select("upper_bound").scalar()
        flag = (x < lo) | (x > hi)
    return df.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def top_outliers(result: DataFrame, k: int = 6) -> DataFrame:
    """Columns with the most outliers (ties by column name)."""
    return (result.where(F.col("outlier_count") > 0)
            .orderBy(F.desc("outlier_count"), "column").limit(k))

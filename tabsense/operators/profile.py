"""Column profiling: shape, types, missing values, duplicates, numeric and
categorical summaries, pairwise-complete Pearson correlation.

Every operator is a DataFrame -> DataFrame function.  Wide tables are handled by
unpivoting to ``(column, value)`` and grouping by column, so the plan size does
not grow with the column count.  Correlation is a masked Gram matrix summed over
partitions, so one scan serves all column pairs.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions import kinds as K
from tabsense.functions.quantiles import exact_quantiles_sized, quantiles

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("p25", "p50", "p75")


def _cols(df: DataFrame, cols: Sequence[str] | None, default: list[str]) -> list[str]:
    if cols is None:
        return default
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"column not found: {c}")
    return list(cols)


def basic_info(df: DataFrame) -> DataFrame:
    """Row count, column count, column names (one row)."""
    names = F.array(*[F.lit(c) for c in df.columns]) if df.columns else F.array()
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        names.alias("columns"))


def data_types(df: DataFrame) -> DataFrame:
    """Type name per column (derived from the schema; no data scan)."""
    rows = [(i, f.name, K.type_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = "ord int, column string, dtype string"
    return df.sparkSession.createDataFrame(rows, schema)


def missing_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL/NaN count and percent of all rows per column, one scan."""
    cols = _cols(df, cols, list(df.columns))
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(K.missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"{i}, '{c.replace(chr(39), chr(39) * 2)}', `_m{i}`"
                      for i, c in enumerate(cols))
    long = one.selectExpr("_total", f"stack({len(cols)}, {pairs}) as (ord, column, missing_count)")
    pct = F.try_divide(F.col("missing_count") * 100.0, F.col("_total"))
    dtypes = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(K.type_name(K.dtype_of(df, c))))])
    return long.select(
        F.col("ord").cast("int").alias("ord"), "column",
        dtypes[F.col("column")].alias("dtype"),
        F.col("missing_count").cast("bigint").alias("missing_count"),
        K.pct2(pct).alias("missing_pct"))


def top_missing(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values, k largest, plus the table-wide total."""
    mv = missing_values(df, cols)
    w = Window.partitionBy()
    return (mv.where("missing_count > 0")
            .withColumn("total_missing", F.sum("missing_count").over(w))
            .orderBy(F.desc("missing_count"), "ord").limit(k)
            .select("column", "missing_count", "missing_pct", "total_missing"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: rows minus distinct rows (NULLs compare equal), as one row.

    Grouping by every column pre-aggregates map-side, so one duplicated row that
    holds a third of the table shuffles as one partial count per task.
    """
    cols = _cols(df, cols, list(df.columns))
    grouped = df.groupBy(*[K.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")
                       .alias("duplicate_rows"))


def long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unpivot numeric columns to ``(ord, column, value double)`` with NaN -> NULL."""
    if not cols:
        raise ValueError("no numeric columns")
    named = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"),
                      K.as_double(df, c).alias("value")) for i, c in enumerate(cols)]
    return df.select(F.explode(F.array(*named)).alias("_r")).select("_r.*")


def column_name(cols: Sequence[str], ord_col: str = "ord") -> Column:
    """The column name for an ordinal produced by ``long_numeric``."""
    return F.array(*[F.lit(c) for c in cols])[F.col(ord_col)]


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Count, mean, std (n-1), min, quartiles, max per numeric column."""
    cols = _cols(df, cols, K.numeric_columns(df))
    # group by the int ordinal only; the names come back from a literal array
    long = long_numeric(df, cols).drop("column")
    stats = {"count": F.count("value"), "mean": F.avg("value"), "std": F.stddev_samp("value"),
             "min": F.min("value"), "max": F.max("value")}
    if approx:
        base = long.groupBy("ord").agg(*[c.alias(n) for n, c in stats.items()])
        qs = quantiles(long, ["ord"], "value", QUARTILES, QUARTILE_NAMES, approx=True)
        out = base.join(qs.drop("_n"), on=["ord"], how="left")
    else:
        # the plain statistics ride along in the bucket-bounds scan (one scan fewer)
        out, _small = exact_quantiles_sized(long, ["ord"], "value", QUARTILES, QUARTILE_NAMES,
                                            stats=stats)
    return out.select("ord", column_name(cols).alias("column"),
                      F.col("count").cast("bigint").alias("count"),
                      "mean", "std", "min", *QUARTILE_NAMES, "max")


def long_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unpivot categorical columns to ``(ord, column, value string)``."""
    named = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"),
                      K.col(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    return df.select(F.explode(F.array(*named)).alias("_r")).select("_r.*")


def categorical_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Non-null count per ``(column, value)``; the shared input of P7."""
    cols = _cols(df, cols, K.categorical_columns(df))
    if not cols:
        raise ValueError("no categorical columns")
    long = long_categorical(df, cols)
    return (long.where(F.col("value").isNotNull())
            .groupBy("ord", "column", "value").agg(F.count(F.lit(1)).alias("count")))


def categorical_top(df: DataFrame, k: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """The k commonest values per categorical column (ties: value ascending).

    The ``row_number() <= k`` filter becomes a partial WindowGroupLimit before the
    shuffle, so a column with billions of distinct values sends only k rows per
    map task to the final ranking.
    """
    counts = categorical_counts(df, cols)
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("ord", "column", F.col("rank").cast("int").alias("rank"), "value",
                    F.col("count").cast("bigint").alias("count")))


def categorical_distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-null values per categorical column."""
    counts = categorical_counts(df, cols)
    return counts.groupBy("ord", "column").agg(
        F.count(F.lit(1)).cast("bigint").alias("distinct_count"))


GRAM_SCHEMA = T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
    T.StructField("n", T.DoubleType()), T.StructField("sx", T.DoubleType()),
    T.StructField("sy", T.DoubleType()), T.StructField("sxx", T.DoubleType()),
    T.StructField("syy", T.DoubleType()), T.StructField("sxy", T.DoubleType())])


def _gram_blocks(k: int, index: Sequence[int] | None = None, keep=None):
    """Per-partition masked Gram blocks: one (k x k) block per moment.  ``index``
    maps local column positions to global ordinals; ``keep(i, j)`` (global) picks
    the pairs a tile reports."""
    def run(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            xc = np.where(m, x, 0.0)
            mf = m.astype("float64")
            blocks = (mf.T @ mf, xc.T @ mf, mf.T @ xc, (xc * xc).T @ mf,
                      mf.T @ (xc * xc), xc.T @ xc)
            acc = blocks if acc is None else tuple(a + b for a, b in zip(acc, blocks))
        if acc is None:
            return
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        gi, gj = ii.ravel(), jj.ravel()
        if index is not None:
            pos = np.asarray(index)
            gi, gj = pos[gi], pos[gj]
        sel = keep(gi, gj) if keep is not None else np.ones(len(gi), bool)
        yield pd.DataFrame({"i": gi[sel].astype("int32"), "j": gj[sel].astype("int32"),
                            "n": acc[0].ravel()[sel], "sx": acc[1].ravel()[sel],
                            "sy": acc[2].ravel()[sel], "sxx": acc[3].ravel()[sel],
                            "syy": acc[4].ravel()[sel], "sxy": acc[5].ravel()[sel]})
    return run


GRAM_BLOCK = 256


def _gram_parts(centred: DataFrame, k: int, block: int) -> DataFrame:
    """Per-task moment rows for every column pair.  Up to ``block`` columns one
    pass holds the whole (k x k) blocks; above it the pairs are tiled: one pass per
    pair of column blocks (a <= b) over just those columns, so a task holds at
    most (2 * block)^2 cells per moment whatever k is."""
    if k <= block:
        return centred.mapInPandas(_gram_blocks(k), GRAM_SCHEMA)
    blocks = [list(range(s0, min(k, s0 + block))) for s0 in range(0, k, block)]
    out = None
    for a, ca in enumerate(blocks):
        for b in range(a, len(blocks)):
            cb = blocks[b]
            idx = ca + cb if a != b else ca
            in_a, in_b = set(ca), set(cb)

            def keep(gi, gj, in_a=in_a, in_b=in_b):
                ga = np.isin(gi, list(in_a))
                gb = np.isin(gj, list(in_b))
                return (ga & gb) | (np.isin(gi, list(in_b)) & np.isin(gj, list(in_a)))
            part = centred.select(*[f"x{i}" for i in idx]).mapInPandas(
                _gram_blocks(len(idx), idx, keep), GRAM_SCHEMA)
            out = part if out is None else out.unionByName(part)
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                       block: int = GRAM_BLOCK) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered column pair, undefined -> 0.

    Pass 1 takes the column means (one row); pass 2 centres by them and sums, per
    partition, the six k x k moment blocks of ``Z = [mask, x, x^2]``; only those
    k^2 partial rows per task are shuffled.  Above ``block`` columns the pairs are
    tiled by column blocks (``_gram_parts``), so task memory stays bounded.
    """
    cols = _cols(df, cols, K.numeric_columns(df))
    if not cols:
        raise ValueError("no numeric columns")
    k = len(cols)
    means = df.agg(*[F.avg(K.as_double(df, c)).alias(f"m{i}")
                     for i, c in enumerate(cols)]).first()
    centred = df.select(*[(K.as_double(df, c) - F.lit(float(means[i] or 0.0)))
                          .alias(f"x{i}") for i, c in enumerate(cols)])
    parts = _gram_parts(centred, k, block)
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in
                                         ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = n * F.col("sxy") - sx * sy
    vx = n * F.col("sxx") - sx * sx
    vy = n * F.col("syy") - sy * sy
    r = F.when((n >= 2) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))   # least/greatest skip NULL
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(F.col("i").alias("ord_a"), F.col("j").alias("ord_b"),
                       names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"),
                       F.coalesce(r, F.lit(0.0)).alias("r"))


def top_correlation(corr: DataFrame) -> DataFrame:
    """Strongest pair by |r| over the upper triangle (none when all r = 0)."""
    best = (corr.where((F.col("ord_a") < F.col("ord_b")) & (F.col("r") != 0))
            .agg(F.max_by(F.struct("col_a", "col_b", "r"),
                          F.struct(F.abs("r"), -F.col("ord_a"), -F.col("ord_b"))).alias("b")))
    return best.where(F.col("b").isNotNull()).select("b.col_a", "b.col_b", "b.r")


def full_profile(df: DataFrame, approx: bool = False, top_k: int = 10) -> DataFrame:
    """P10: every profile section as one long frame ``(section, column, metric, value)``.

    Four jobs: numeric grouped summary, categorical grouped counts, the Gram pass
    (plus its one-row mean pass), and the duplicate count.
    """
    num_cols = K.numeric_columns(df)
    cat_cols = K.categorical_columns(df)
    parts: list[DataFrame] = []
    info = basic_info(df)
    parts.append(info.select(F.lit("basic").alias("section"), F.lit(None).cast("string").alias("column"),
                             F.lit("row_count").alias("metric"),
                             F.col("row_count").cast("double").alias("value")))
    parts.append(info.select(F.lit("basic"), F.lit(None).cast("string"), F.lit("column_count"),
                             F.col("column_count").cast("double")))
    mv = missing_values(df)
    parts.append(mv.select(F.lit("missing"), "column", F.lit("missing_count"),
                           F.col("missing_count").cast("double")))
    parts.append(mv.select(F.lit("missing"), "column", F.lit("missing_pct"),
                           F.col("missing_pct").cast("double")))
    parts.append(duplicate_rows(df).select(F.lit("duplicates"), F.lit(None).cast("string"),
                                           F.lit("duplicate_rows"),
                                           F.col("duplicate_rows").cast("double")))
    if num_cols:
        ns = numeric_summary(df, num_cols, approx=approx)
        metrics = ["count", "mean", "std", "min", *QUARTILE_NAMES, "max"]
        stacked = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
        parts.append(ns.selectExpr("'numeric'", "column",
                                   f"stack({len(metrics)}, {stacked}) as (metric, value)"))
        cm = correlation_matrix(df, num_cols)
        parts.append(cm.select(F.lit("correlation"), "col_a", "col_b", "r"))
    if cat_cols:
        parts.append(categorical_distinct(df, cat_cols).select(
            F.lit("categorical"), "column", F.lit("distinct_count"),
            F.col("distinct_count").cast("double")))
        parts.append(categorical_top(df, top_k, cat_cols).select(
            F.lit("top_values"), "column", "value", F.col("count").cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("section", "column", "metric", "value")


def profile_headline(df: DataFrame, n_means: int = 6) -> DataFrame:
    """Rows, duplicates, means of the first numeric columns, top correlation."""
    num_cols = K.numeric_columns(df)
    head = num_cols[:n_means]
    row = df.agg(F.count(F.lit(1)).cast("double").alias("rows"),
                 *[F.avg(K.as_double(df, c)).alias(f"_m{i}") for i, c in enumerate(head)])
    parts = [row.select(F.lit("rows").alias("metric"), F.lit(None).cast("string").alias("column"),
                        F.col("rows").alias("value"))]
    parts += [row.select(F.lit("mean"), F.lit(c), F.col(f"_m{i}")) for i, c in enumerate(head)]
    parts.append(duplicate_rows(df).select(F.lit("duplicate_rows"), F.lit(None).cast("string"),
                                           F.col("duplicate_rows").cast("double")))
    if len(num_cols) >= 2:
        tc = top_correlation(correlation_matrix(df, num_cols))
        parts.append(tc.select(F.lit("top_correlation"),
                               F.concat_ws("|", "col_a", "col_b"), F.col("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("metric", "column", "value")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows by an explicit key, n clamped to 1..200."""
    n = max(1, min(200, int(n)))
    return df.orderBy(*[K.col(c) for c in order_by]).limit(n)

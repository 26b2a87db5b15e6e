"""Exact grouped quantiles by rank-directed selection, and one-pass approximate ones.

Neither a whole group nor all its values ever meet in one task or cross the network:

1. one scan counts the rows of fixed buckets (64 a power of two of the value's size), with
   partial counts in the tasks; a bucket also keeps its least and largest value;
2. running counts over a group's buckets (a few thousand rows at most) tell which bucket
   holds each wanted rank; a bucket of one value, or whose first or last row is wanted,
   is settled at once;
3. the other wanted buckets are ranges of values.  A range of more than ``GATHER_ROWS``
   rows is counted again in ``SPLITS`` even parts, until all are shorter; a last scan then
   counts the distinct values inside the wanted ranges only.

The ranges are one row per group, probability and side; they are collected and broadcast
when that is under the session's broadcast threshold, otherwise written to the shared
checkpoint folder and joined by key.  Interpolation is linear (pandas / ``quantile_cont``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.buckets import local_if_small
from tabsense.session import cut_lineage

#: Buckets a power of two, and parts of a range that is counted again.
PER_POWER, SPLITS = 64, 1024
#: A wanted range of more rows is split before its values are counted.
GATHER_ROWS = 1 << 20
FLOOR, CEIL = 0, 1


def size_bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises (any numeric type, infinities too)."""
    v = value.cast("double")
    power = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0))
    away = F.floor((power + 1101) * PER_POWER) + 1
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, away).otherwise(-away)


def _ranked(parts: DataFrame, within: Sequence[str]) -> DataFrame:
    """Buckets (n, lo, hi) with the rows before them and in all, inside ``within``."""
    group = Window.partitionBy(*within)
    before = group.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(group)})


def _wanted(parts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """keys, total, prob, side, rank (inside the bucket), n, lo, hi: a bucket per wanted rank."""
    ranks = []
    for i, p in enumerate(probs):
        at = (F.col("all") - 1) * F.lit(float(p))
        for side, rank in ((FLOOR, F.floor(at)), (CEIL, F.ceil(at))):
            ranks.append(F.struct(F.lit(i).alias("prob"), F.lit(side).alias("side"), (rank - F.col("before")).alias("rank")))
    inside = F.filter(F.array(*ranks), lambda r: (r["rank"] >= 0) & (r["rank"] < F.col("n")))
    return (_ranked(parts, keys).withColumn("w", F.explode(inside))
            .select(*keys, F.col("all").alias("total"), "w.prob", "w.side", "w.rank", "n", "lo", "hi"))


SETTLED = "(lo = hi OR rank = 0 OR rank = n - 1)"


def _fixed(wanted: DataFrame) -> tuple[DataFrame, bool]:
    """The wanted ranges, computed once, and whether they are small enough to broadcast."""
    local = local_if_small(wanted, 128)
    return (cut_lineage(wanted), False) if local is None else (local, True)


def _inside(present: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, small: bool,
            part: Column) -> DataFrame:
    """Wanted ranks moved from their range into its parts (``part`` of value, _lo, _hi)."""
    named = [F.col(k).alias(f"_{k}") for k in keys]
    ranges = wanted.select(*named, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    same = F.col(value).between(F.col("_lo"), F.col("_hi"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    rows = present.join(F.broadcast(ranges) if small else ranges, same)
    parts = (rows.groupBy(*[f"_{k}" for k in keys], "_lo", part.alias("_part"))
             .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")))
    parts = _ranked(parts, [*[f"_{k}" for k in keys], "_lo"]).drop("all", "_part")
    hit = (F.col("w.lo") == F.col("p._lo")) & (F.col("w.rank") >= F.col("p.before")) & (
        F.col("w.rank") < F.col("p.before") + F.col("p.n"))
    for k in keys:
        hit = hit & (F.col(f"w.{k}") == F.col(f"p._{k}"))
    asked = F.broadcast(wanted.alias("w")) if small else wanted.alias("w")
    return parts.alias("p").join(asked, hit).select(
        *[F.col(f"w.{k}").alias(k) for k in keys], "w.total", "w.prob", "w.side",
        (F.col("w.rank") - F.col("p.before")).alias("rank"), "p.n", "p.lo", "p.hi")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys`` group.

    Returns ``keys + names`` (one double column per probability) plus ``_n``,
    the non-null count.  NULL values are ignored; groups without values, or with a
    NULL key, are absent.
    """
    return exact_quantiles_sized(df, keys, value, probs, names)[0]


def exact_quantiles_sized(df: DataFrame, keys: Sequence[str], value: str,
                          probs: Sequence[float], names: Sequence[str] | None = None,
                          stats: dict[str, Column] | None = None) -> tuple[DataFrame, bool]:
    """``exact_quantiles`` plus whether its one-row-per-group result is proven
    small enough to broadcast (the wanted ranges, several rows a group, were).

    With ``stats`` (name -> aggregate over all rows of a group) the result has one row
    per group of ``df``, including groups whose values are all NULL (their quantiles
    are NULL), with those columns added.
    """
    names = list(names or [f"q{i}" for i in range(len(probs))])
    keys, v = list(keys), F.col(value)
    present = df.select(*keys, value).where(v.isNotNull())
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    parts = (present.groupBy(*keys, size_bucket(v).alias("_bucket"))
             .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).drop("_bucket"))
    wanted, small = _fixed(_wanted(parts, keys, probs))
    longest, unsettled = None, wanted.where(f"NOT {SETTLED}")
    done = [wanted.where(SETTLED)]
    while (now := unsettled.agg(F.max("n")).first()[0] or 0) > GATHER_ROWS and now != longest:
        longest = now
        width = F.col("_hi").cast("double") - F.col("_lo").cast("double")
        share = (v.cast("double") - F.col("_lo").cast("double")) / F.nullif(width, F.lit(0.0))
        wanted, small = _fixed(_inside(present, keys, value, unsettled, small,
                                       F.least(F.floor(share * SPLITS), F.lit(SPLITS))))
        done.append(wanted.where(SETTLED))
        unsettled = wanted.where(f"NOT {SETTLED}")
    if longest is not None or now:
        done.append(_inside(present, keys, value, unsettled, small, v))

    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    at = F.when(F.col("rank") == 0, F.col("lo")).otherwise(F.col("hi"))
    pick = [F.max(F.when((F.col("prob") == i) & (F.col("side") == side), at)).alias(f"_{i}_{side}")
            for i in range(len(probs)) for side in (FLOOR, CEIL)]
    picked = found.groupBy(*keys).agg(F.first("total").alias("_n"), *pick)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_{i}_{FLOOR}"), F.col(f"_{i}_{CEIL}")
        out.append((low + (high - low) * (h - F.floor(h))).alias(name))
    result = picked.select(*keys, "_n", *out)
    if not keys:
        result = result.where(F.col("_n").isNotNull())
    if stats:
        base = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(f"b.{k}") == F.col(f"q.{k}"))
        answers = F.broadcast(result) if small else result
        result = (base.alias("b").join(answers.alias("q"), same, "left")
                  .select(*[F.col(f"b.{k}") for k in keys], *stats, "_n", *names))
    return result, small


def approx_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                     probs: Sequence[float], names: Sequence[str] | None = None,
                     accuracy: int = 10000) -> DataFrame:
    """One-pass mergeable sketch (``percentile_approx``); no interpolation."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    arr = F.percentile_approx(F.col(value), list(map(float, probs)), accuracy)
    grouped = (df.where(F.col(value).isNotNull()).groupBy(*keys)
               .agg(arr.alias("_qs"), F.count(F.lit(1)).alias("_n")))
    return grouped.select(*keys, "_n", *[F.col("_qs")[i].cast("double").alias(n)
                                          for i, n in enumerate(names)])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    if approx:
        return approx_quantiles(df, keys, value, probs, names)
    return exact_quantiles(df, keys, value, probs, names)

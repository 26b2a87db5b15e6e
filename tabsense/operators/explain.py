"""Model explanation: native importances and permutation importance.

Permutation importance is not a loop of jobs per feature: every row sends its value
of each feature to another row, once per repeat, by a bijection of row numbers
computed per row; a row is then replicated with ``explode``, one copy per value it
received, the whole frame goes through the fitted pipeline in one pass, and the
score is a grouped aggregation.  Any trained model is explained this way, kNN too.
"""
from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsense.functions import kinds as K
from tabsense.functions.prefix import exclusive_prefix
from tabsense.operators.models import TrainResult
from tabsense.session import cut_lineage


def native_importance(res: TrainResult) -> DataFrame | None:
    """Tree importances, or |coefficients| (mean over classes), by expanded
    feature name (X3), sorted descending.  None when the model has neither."""
    m = res.model
    names = res.feature_names
    vals = None
    if m is not None and hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif m is not None and hasattr(m, "coefficientMatrix") and m.coefficientMatrix.numRows > 1:
        arr = m.coefficientMatrix.toArray()
        vals = abs(arr).mean(axis=0).tolist()
    elif m is not None and hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    if vals is None or len(vals) != len(names):
        return None
    spark = res.predictions.sparkSession if res.predictions is not None else SparkSession.active()   # loaded: no predictions
    rows = sorted(zip(names, map(float, vals)), key=lambda kv: -kv[1])
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


def _score(pred: DataFrame, task: str, keys: Sequence[str]) -> DataFrame:
    if task == "regression":
        e = F.col("label") - F.col("prediction")
        g = pred.groupBy(*keys).agg(F.sum(e * e).alias("_sse"),
                                    (F.var_pop("label") * F.count(F.lit(1))).alias("_sst"))
        return g.select(*keys, F.when(F.col("_sst") != 0, 1 - F.col("_sse") / F.col("_sst"))
                        .otherwise(F.lit(0.0)).alias("score"))
    return pred.groupBy(*keys).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``rn``, 0 to n - 1 in the order of ``order``.  Ties are numbered within
    the partition that holds them, so equal rows of any number spread over tasks."""
    rows = cut_lineage(df.withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy(order, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = exclusive_prefix(cut_lineage(counts), [], order, "_c", "_before").drop("_c")
    local = F.row_number().over(Window.partitionBy(order, "_part").orderBy(order)) - 1
    return cut_lineage(rows.withColumn("_local", local).join(before, on=[order, "_part"])
                       .withColumn("rn", F.col("_before") + F.col("_local"))
                       .drop("_part", "_local", "_before"))


def _bijection(n: int, *key) -> tuple[int, int]:
    """(a, b) of the row numbers' permutation (a * rn + b) mod n, drawn by ``key``; products
    fit a long up to 2**33 rows."""
    rng = random.Random("/".join(map(str, key)))
    a = rng.randrange(max(n, 1)) % (1 << 30) or 1
    while math.gcd(a, n) != 1:
        a = a % (1 << 30) + 1
    return a, rng.randrange(max(n, 1))


def permutation_importance(res: TrainResult, df: DataFrame, sample_size: int | None = None,
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean drop of the score (r2 / accuracy) when one raw feature is shuffled.

    ``df`` holds the raw rows (target included); rows with a missing target are
    dropped first.  All rows are scored, or the ``sample_size`` rows with the smallest
    hash if that is given.
    """
    from tabsense.operators import prep as P
    feats = list(res.features)
    base = P.drop_null_target(df.select(*[K.col(c) for c in dict.fromkeys([res.target, *feats])]),
                              res.target)
    if res.task_type == "classification":
        base = base.withColumn("label", P.label_expr(res.target, res.classes))
    else:
        base = base.withColumn("label", K.col(res.target).cast("double"))
    h = F.xxhash64(*[K.col(c) for c in [res.target, *feats]], F.lit(seed))
    base = base.withColumn("_h", h)
    if sample_size is not None:
        base = base.orderBy("_h").limit(sample_size)
    rows = _numbered(base, "_h").drop("_h")
    n = rows.count()
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("rep"),
                              F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                     for i, f in enumerate(feats) for r in range(repeats)
                     for a, b in [_bijection(n, seed, f, r)]])
    # Every row sends its value of a feature, as text, to another row: one value a (feature,
    # repeat) is shuffled, not a copy of the row; the copies are made behind the join.
    own = F.array(*[K.col(c).cast("string") for c in feats])
    sent = rows.select("rn", own.alias("own"), F.explode(grid).alias("g")).select(
        ((F.col("g.a") * F.col("rn") + F.col("g.b")) % max(n, 1)).alias("rn"),
        F.struct("g.i", "g.rep", F.get("own", "g.i").alias("value")).alias("s"))
    given = sent.groupBy("rn").agg(F.collect_list("s").alias("given"))
    unchanged = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("rep"), F.lit(None).cast("string").alias("value")))
    mixed = rows.join(given, "rn").withColumn("g", F.explode(F.concat(unchanged, "given"))).drop("given")
    mixed = mixed.withColumns({
        "feature": F.coalesce(F.get(F.array(*map(F.lit, feats)), "g.i"), F.lit("__base__")), "rep": F.col("g.rep"),
        **{c: F.when(F.col("g.i") == i, F.col("g.value").cast(K.dtype_of(base, c))).otherwise(K.col(c))
           for i, c in enumerate(feats)}}).drop("g")
    pred = res.predict(res.prep.model.transform(mixed))
    scores = _score(pred, res.task_type, ["feature", "rep"])
    baseline = scores.where(F.col("feature") == "__base__").select(F.col("score").alias("b"))
    perm = scores.where(F.col("feature") != "__base__").groupBy("feature").agg(
        F.avg("score").alias("s"))
    imp = perm.select("feature", (baseline.scalar() - F.col("s")).alias("importance"))
    return imp.select(F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
                      .cast("int").alias("rank"), "feature", "importance")


def explain_top(res: TrainResult, df: DataFrame, k: int = 10) -> DataFrame:
    """The top k features, native importances when the model has them, else
    permutation importance.  (``shap_summary`` of the reference is this same
    permutation table, X5.)"""
    nat = native_importance(res)
    src = nat if nat is not None else permutation_importance(res, df)
    return src.orderBy("rank").limit(k).withColumn(
        "source", F.lit("native" if nat is not None else "permutation"))

"""Model evaluation as aggregations over a predictions frame.

Regression: MAE, MSE, RMSE, R^2, MAPE.  Classification: accuracy, per-class and
macro/weighted precision/recall/F1 (0 on zero division), dense confusion matrix,
ROC-AUC (binary and one-vs-rest macro).  Clustering: silhouette.

Nothing is collected: every metric is a DataFrame, usually of one row.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabsense.functions import kinds as K
from tabsense.functions.prefix import exclusive_prefix


def eval_regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row of mae, mse, rmse, r2, mape (percent over label != 0, else 0)."""
    y, p = K.col(label).cast("double"), K.col(prediction).cast("double")
    valid = df.where(y.isNotNull() & p.isNotNull())
    e = y - p
    one = valid.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                    F.sum(e * e).alias("_sse"),
                    (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
                    F.avg(F.when(y != 0, F.abs(e / y))).alias("_mape"))
    r2 = (F.when(F.col("_sst") != 0, 1 - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return one.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"),
                      F.coalesce(F.col("_mape") * 100, F.lit(0.0)).alias("mape"))


def _pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(y, p) as text; numbers of two types are compared as numbers, so 1 is 1.0."""
    y, p = K.col(label), K.col(prediction)
    kinds = [df.select(c).schema[0].dataType for c in (y, p)]
    if kinds[0] != kinds[1] and all(isinstance(t, NumericType) for t in kinds):
        y, p = _number_text(y.cast("double")), _number_text(p.cast("double"))
    return df.select(y.cast("string").alias("y"), p.cast("string").alias("p")).where(
        F.col("y").isNotNull() & F.col("p").isNotNull())


def _number_text(v: Column) -> Column:
    whole = (v == F.floor(v)) & (F.abs(v) < 2.0 ** 53)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def class_stats(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class (labels union predictions): support, predicted, tp, precision, recall, f1."""
    pairs = _pairs(df, label, prediction)
    cells = pairs.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    as_true = cells.groupBy(F.col("y").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("tp"))
    as_pred = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    j = as_true.join(as_pred, on="class", how="full_outer")
    support = F.coalesce(F.col("support"), F.lit(0)).cast("bigint")
    predicted = F.coalesce(F.col("predicted"), F.lit(0)).cast("bigint")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("bigint")
    prec = F.coalesce(F.try_divide(tp.cast("double"), predicted), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), support), F.lit(0.0))
    s = j.select("class", support.alias("support"), predicted.alias("predicted"), tp.alias("tp"),
                 prec.alias("precision"), rec.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return s.withColumn("f1", f1)


def eval_classification(df: DataFrame, label: str = "label",
                        prediction: str = "prediction") -> DataFrame:
    """Accuracy plus macro and support-weighted precision/recall/F1 (one row)."""
    cs = class_stats(df, label, prediction)
    tot = F.sum("support")
    return cs.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E5: dense ``(actual, predicted, count)`` over the sorted class list.

    The class list is one aggregated array (size = number of classes); the grid is
    two ``explode`` calls on it, then the observed cells are joined in.
    """
    pairs = _pairs(df, label, prediction)
    cells = pairs.groupBy(F.col("y").alias("actual"), F.col("p").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    classes = pairs.select(F.explode(F.array("y", "p")).alias("c")).agg(
        F.array_sort(F.collect_set("c")).alias("cs"))
    grid = (classes.select(F.explode("cs").alias("actual"), "cs")
            .select("actual", F.explode("cs").alias("predicted")))
    return grid.join(cells, on=["actual", "predicted"], how="left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows."""
    cs = class_stats(df, label, prediction)
    per = cs.select("class", "precision", "recall", "f1", "support")
    tot = F.sum("support")
    macro = cs.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   tot.cast("bigint").alias("support"))
    weighted = cs.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
                      tot.cast("bigint").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def _auc_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """counts: keys + score + pos + neg (one row per distinct score)."""
    keys = list(keys)
    pre = exclusive_prefix(counts, keys, "score", "neg", "neg_below")
    contrib = F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))
    agg = pre.groupBy(*keys).agg(F.sum(contrib).alias("_u"), F.sum("pos").alias("_p"),
                                 F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return agg.select(*keys, auc.alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Binary ROC-AUC, ties averaged (Mann-Whitney U / (P*N)).

    Rows are first reduced to one row per distinct score; the running count of
    negatives below each score comes from a range-partitioned prefix sum, never
    from one global window.
    """
    y = K.col(label).cast("double")
    s = K.col(score).cast("double")
    base = df.where(y.isNotNull() & s.isNotNull()).select((y == 1).alias("_pos"), s.alias("score"))
    counts = base.groupBy("score").agg(F.count_if("_pos").alias("pos"),
                                       F.count_if(~F.col("_pos")).alias("neg"))
    counts = counts.withColumn("_k", F.lit(0))
    return _auc_from_counts(counts, ["_k"]).select("roc_auc")


def roc_auc_ovr(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest ROC-AUC per class and their macro mean.

    ``scores`` maps each class value to the column holding its score.
    """
    y = K.col(label).cast("string")
    per_class = F.array(*[F.struct(F.lit(str(c)).alias("class"), K.col(col).cast("double").alias("score"))
                          for c, col in scores.items()])
    long = (df.where(y.isNotNull()).select(y.alias("y"), F.explode(per_class).alias("e"))
            .select("y", "e.class", "e.score").where(F.col("score").isNotNull()))
    counts = long.groupBy("class", "score").agg(
        F.count_if(F.col("y") == F.col("class")).alias("pos"),
        F.count_if(F.col("y") != F.col("class")).alias("neg"))
    return _auc_from_counts(counts, ["class"])


def roc_auc_macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("roc_auc").alias("roc_auc"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, x: acc + x)


def silhouette(df: DataFrame, features: Sequence[str] | str, cluster: str,
               max_unrolled: int = 4096) -> DataFrame:
    """Mean silhouette with squared Euclidean distance (one row).

    sum_{y in C} |x - y|^2 = |C| |x|^2 - 2 x . S_C + Q_C, so each point needs only
    the per-cluster count, vector sum S_C and square sum Q_C: one small aggregate
    (one row per cluster), no pairs of points.
    A singleton cluster scores 0; the result is -1 unless 1 < clusters < rows.
    ``features``: list of numeric columns, or the name of an array<double> column.

    With a list of columns and at most ``max_unrolled`` cluster statistics, the
    cluster table is read once and every distance is a plain (code-generated)
    expression over literals; otherwise the table is a scalar subquery walked with
    higher-order functions.
    """
    if not isinstance(features, str):
        out = _silhouette_unrolled(df, list(features), cluster, max_unrolled)
        if out is not None:
            return out
    if isinstance(features, str):
        vec = K.col(features).cast("array<double>")
    else:
        vec = F.array(*[K.col(c).cast("double") for c in features])
    # distances do not change when the mean is taken off, but their digits survive
    mean = df.where(vec.isNotNull()).agg(Summarizer.mean(array_to_vector(vec))).first()[0]
    if mean is not None:
        centre = F.array(*[F.lit(float(m)) for m in mean])
        vec = F.zip_with(vec, centre, lambda a, b: a - b)
    pts = df.select(vec.alias("x"), K.col(cluster).cast("string").alias("c")).where(
        F.col("c").isNotNull() & F.col("x").isNotNull())
    pts = pts.withColumn("sq", F.aggregate(F.col("x"), F.lit(0.0), lambda acc, v: acc + v * v))
    exploded = pts.select("c", "sq", F.posexplode("x").alias("i", "v"))
    sums = exploded.groupBy("c", "i").agg(F.sum("v").alias("s"))
    vec_sums = sums.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sv"))
    sizes = pts.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("q"))
    clusters = sizes.join(vec_sums, on="c").select(
        F.struct("c", "n", "q", F.transform("sv", lambda e: e["s"]).alias("s")).alias("k"))
    table = clusters.agg(F.collect_list("k").alias("ks")).scalar()
    per = pts.select("c", "x", "sq", table.alias("ks"))
    tot = F.transform("ks", lambda k: F.struct(
        k["c"].alias("c"), k["n"].alias("n"),
        (k["n"] * F.col("sq") - 2 * _dot(F.col("x"), k["s"]) + k["q"]).alias("t")))
    per = per.select("c", tot.alias("d"))
    own = F.filter("d", lambda e: e["c"] == F.col("c"))[0]
    others = F.filter("d", lambda e: e["c"] != F.col("c"))
    a = F.when(own["n"] > 1, own["t"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda e: e["t"] / e["n"]))
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    scored = per.select(s.alias("s"), F.size("d").alias("k"))
    res = scored.agg(F.avg("s").alias("s"), F.max("k").alias("k"), F.count(F.lit(1)).alias("n"))
    return res.select(F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("s"))
                      .otherwise(F.lit(-1.0)).alias("silhouette_score"))


def _silhouette_unrolled(df: DataFrame, features: list[str], cluster: str,
                         max_unrolled: int) -> DataFrame | None:
    """The silhouette of ``silhouette`` with the cluster table inlined as literals;
    None when the table has more than ``max_unrolled`` entries."""
    d = len(features)
    xs = [K.col(c).cast("double") for c in features]
    means = df.where(K.col(cluster).isNotNull()).agg(*[F.avg(x) for x in xs]).first()
    xs = [x - F.lit(float(m or 0.0)) for x, m in zip(xs, means)]
    pts = df.select(*[x.alias(f"_x{i}") for i, x in enumerate(xs)],
                    K.col(cluster).cast("string").alias("c")).where(F.col("c").isNotNull())
    x = [F.col(f"_x{i}") for i in range(d)]
    sq = x[0] * x[0]
    for xi in x[1:]:
        sq = sq + xi * xi
    pts = pts.withColumn("sq", sq)
    stats = pts.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("q"),
                                 *[F.sum(f"_x{i}").alias(f"s{i}") for i in range(d)])
    cap = max(1, max_unrolled // (d + 3))
    rows = stats.limit(cap + 1).collect()
    if len(rows) > cap:
        return None
    own_n, own_a, others = None, None, []
    for r in rows:
        dot = x[0] * F.lit(r["s0"])
        for i in range(1, d):
            dot = dot + x[i] * F.lit(r[f"s{i}"])
        t = F.lit(r["n"]) * F.col("sq") - 2 * dot + F.lit(r["q"])
        mine = F.col("c") == F.lit(r["c"])
        own_n = (own_n if own_n is not None else F).when(mine, F.lit(r["n"]))
        a_j = F.when(F.lit(r["n"]) > 1, t / (r["n"] - 1)) if r["n"] > 1 else F.lit(None).cast("double")
        own_a = (own_a if own_a is not None else F).when(mine, a_j)
        others.append(F.when(~mine, t / r["n"]))
    k = len(rows)
    if k == 0:
        return df.sparkSession.createDataFrame([(-1.0,)], "silhouette_score double")
    a = own_a
    b = F.least(*others) if len(others) > 1 else others[0]
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    res = pts.agg(F.avg(s).alias("s"), F.count(F.lit(1)).alias("n"))
    return res.select(F.when((F.lit(k) > 1) & (F.lit(k) < F.col("n")), F.col("s"))
                      .otherwise(F.lit(-1.0)).alias("silhouette_score"))


def silhouette_spark(df: DataFrame, features_col: str, prediction_col: str) -> DataFrame:
    """MLlib's own silhouette (squared Euclidean) on a vector column, as one row."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol=prediction_col)
    return df.sparkSession.createDataFrame([(float(ev.evaluate(df)),)], "silhouette_spark double")

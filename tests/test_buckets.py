import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsense.functions.buckets import BUCKET, group_bounds, with_buckets
from tabsense.functions.prefix import exclusive_prefix
from tabsense.functions.quantiles import exact_quantiles


def _skewed(spark, n=60000, seed=3):
    rng = np.random.default_rng(seed)
    v = np.concatenate([np.full(n // 3, 42.0), rng.lognormal(3, 2, n - n // 3)])
    k = np.where(np.arange(n) < n // 2, 0, rng.integers(1, 4, n))   # group 0 is hot
    pdf = pd.DataFrame({"k": k.astype("int64"), "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_buckets_split_hot_group_and_are_monotone(spark):
    pdf, df = _skewed(spark)
    bounds, small = group_bounds(df, ["k"], "v", 32)
    assert small
    b = with_buckets(df, ["k"], "v", bounds, small, 32)
    per = b.groupBy("k").agg(F.count_distinct(BUCKET).alias("nb")).collect()
    assert all(r["nb"] > 4 for r in per)
    # bucket order follows value order inside every group
    bad = (b.groupBy("k", BUCKET).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
           .selectExpr("k", BUCKET, "lo", "hi",
                       f"lag(hi) over (partition by k order by {BUCKET}) as prev_hi")
           .where("prev_hi > lo").count())
    assert bad == 0


def test_exact_quantiles_many_buckets_vs_numpy(spark):
    pdf, df = _skewed(spark)
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, g in pdf.groupby("k"):
        exp = np.quantile(g["v"].values, probs)
        assert got[k]["_n"] == len(g)
        for i, e in enumerate(exp):
            assert abs(got[k][f"q{i}"] - e) <= 1e-9 * max(1.0, abs(e))


def test_exclusive_prefix_vs_cumsum(spark):
    rng = np.random.default_rng(5)
    n = 20000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n).astype("int64"),
                        "o": rng.permutation(n).astype("float64"),
                        "w": rng.integers(0, 10, n).astype("int64")})
    out = exclusive_prefix(spark.createDataFrame(pdf), ["g"], "o", "w", "before", 16).toPandas()
    exp = pdf.sort_values(["g", "o"]).copy()
    exp["before"] = exp.groupby("g")["w"].cumsum() - exp["w"]
    m = exp.merge(out, on=["g", "o", "w"], suffixes=("_e", "_g"))
    assert len(m) == n
    assert (m["before_e"] == m["before_g"]).all()


def test_exact_quantiles_without_broadcast(spark):
    """Above the broadcast threshold the bounds are checkpointed and joined by key;
    the result must stay exact (the threshold is switched off for this test)."""
    pdf, df = _skewed(spark, n=20000, seed=9)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bounds, small = group_bounds(df, ["k"], "v", 16)
        assert not small
        probs = (0.1, 0.5, 0.9)
        got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
        opdf = pdf.assign(o=np.arange(len(pdf), dtype="float64"))
        pre = exclusive_prefix(spark.createDataFrame(opdf), ["k"], "o", "v", "before", 16).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exp = opdf.sort_values(["k", "o"]).copy()
    exp["before"] = exp.groupby("k")["v"].cumsum() - exp["v"]
    m = exp.merge(pre, on=["k", "o"], suffixes=("_e", "_g"))
    assert len(m) == len(pdf)
    assert np.allclose(m["before_e"], m["before_g"], rtol=1e-9)
    for k, g in pdf.groupby("k"):
        exp = np.quantile(g["v"].values, probs)
        for i, e in enumerate(exp):
            assert abs(got[k][f"q{i}"] - e) <= 1e-9 * max(1.0, abs(e))


def test_density_same_without_broadcast(spark):
    """Group statistics above the broadcast threshold are joined by key instead;
    the density table must not change."""
    from tabsense.functions.buckets import local_if_small
    from tabsense.operators import charts as C
    pdf, df = _skewed(spark, n=6000, seed=41)
    df = df.withColumn("g", (F.col("k") % 2).cast("string"))
    base = sorted((r["g"], r["point"], round(r["density"], 12)) for r in C.density(df, "v", "g").collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert local_if_small(df.select("g").distinct()) is None
        other = sorted((r["g"], r["point"], round(r["density"], 12))
                       for r in C.density(df, "v", "g").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert base == other

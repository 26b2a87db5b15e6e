"""Rank-directed selection against numpy: ties, zeros, signs, heavy tails, narrow ranges."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.functions import quantiles as Q

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
RNG = np.random.default_rng(4)
N = 4000
SHAPES = {
    "normal": RNG.normal(0, 1, N), "tail": np.exp(RNG.normal(0, 8, N)) * RNG.choice([-1, 1], N),
    "narrow": 1.7e9 + RNG.random(N), "ties": RNG.integers(0, 4, N).astype(float), "one": np.full(N, 7.25),
    "outlier": np.r_[RNG.normal(5, 1, N - 1), 1e300], "tiny": RNG.random(N) * 5e-324 * 1000,
    "zeros": np.where(RNG.random(N) < 0.6, 0.0, RNG.normal(0, 1, N)), "few": np.r_[3.0, np.full(N - 1, np.nan)],
}


@pytest.mark.parametrize("gather", [1 << 20, 50])
@pytest.mark.parametrize("limit", ["10485760", "1"])
def test_shapes_against_numpy(spark, monkeypatch, gather, limit):
    monkeypatch.setattr(Q, "GATHER_ROWS", gather)
    pdf = pd.concat([pd.DataFrame({"k": k, "v": x}) for k, x in SHAPES.items()])
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {r.k: r for r in Q.exact_quantiles(df, ["k"], "v", PROBS).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for k, x in SHAPES.items():
        x = x[~np.isnan(x)]
        assert got[k]["_n"] == len(x)
        assert np.allclose([got[k][f"q{i}"] for i in range(len(PROBS))], np.quantile(x, PROBS), rtol=1e-12, atol=0)


def test_longs_nulls_and_no_keys(spark, monkeypatch):
    monkeypatch.setattr(Q, "GATHER_ROWS", 3)
    base = 1 << 60
    df = spark.createDataFrame([("a" if i % 3 else None, base + i if i % 10 else None) for i in range(100)], "k string, v long")
    got = {r.k: r for r in Q.exact_quantiles(df, ["k"], "v", (0.0, 1.0)).collect()}
    assert set(got) == {"a"} and got["a"].q0 == float(base + 1) and got["a"].q1 == float(base + 98)
    whole = Q.exact_quantiles(df, [], "v", (0.5,)).collect()
    assert len(whole) == 1 and whole[0]["_n"] == 90
    assert Q.exact_quantiles(df.limit(0), [], "v", (0.5,)).collect() == []
    assert Q.exact_quantiles(df.limit(0), ["k"], "v", (0.5,)).collect() == []
    st, _ = Q.exact_quantiles_sized(df.withColumn("v", F.when(F.col("k") == "b", F.col("v"))).fillna("a", ["k"]), ["k"], "v",
                                    (0.5,), ["m"], stats={"rows": F.count("*")})
    assert [(r.k, r.rows, r.m) for r in st.collect()] == [("a", 100, None)]


def test_buckets_never_fall(spark):
    x = np.sort(np.concatenate([RNG.normal(0, 1, 500), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, np.inf, -np.inf], 2.0 ** np.arange(-80, 80)]))
    rows = spark.createDataFrame([(float(v),) for v in x], "v double").select("v", Q.size_bucket(F.col("v")).alias("b")).collect()
    b = [r.b for r in sorted(rows, key=lambda r: r.v)]
    assert b == sorted(b)


def test_values_are_not_shuffled(spark):
    """The exchanges of the plan carry buckets and wanted ranges, no distinct values of the whole table."""
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"))
    out = Q.exact_quantiles(df, ["k"], "v", (0.25, 0.5, 0.75))
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("partial_count(1)"):]
    assert "BroadcastHashJoin" in scan or "BroadcastNestedLoopJoin" in scan

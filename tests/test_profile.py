import numpy as np
import pandas as pd

from tabsense.operators import profile as P
from tabsense.functions.quantiles import approx_quantiles, exact_quantiles


def test_basic_and_missing(unit_df):
    assert P.basic_info(unit_df).first()["row_count"] == 200
    mv = {r["column"]: r for r in P.missing_values(unit_df).collect()}
    assert mv["daromad"]["missing_count"] == 5          # NaN counts as missing
    assert mv["daromad"]["missing_pct"] == 2.5
    top = P.top_missing(unit_df).collect()
    assert [r["column"] for r in top] == ["daromad"] and top[0]["total_missing"] == 5


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    assert P.duplicate_rows(df).first()[0] == 3


def test_numeric_summary_matches_pandas(unit_df, unit_pdf):
    ns = {r["column"]: r for r in P.numeric_summary(unit_df).collect()}
    desc = unit_pdf[["yosh", "daromad", "sotib_oldi"]].describe()
    for c in ["yosh", "daromad", "sotib_oldi"]:
        for m, k in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                     ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert abs(float(ns[c][m]) - float(desc.loc[k, c])) < 1e-6 * max(1, abs(desc.loc[k, c]))
    assert "shahar" not in ns


def test_categorical_top_and_distinct(unit_df, unit_pdf):
    top = P.categorical_top(unit_df, 10).where("column = 'shahar'").orderBy("rank").collect()
    vc = unit_pdf["shahar"].value_counts()
    assert [r["count"] for r in top] == sorted(vc.values.tolist(), reverse=True)
    d = P.categorical_distinct(unit_df).where("column = 'shahar'").first()
    assert d["distinct_count"] == 3


def test_correlation_matches_pandas(unit_df, unit_pdf):
    cols = ["yosh", "daromad", "sotib_oldi"]
    got = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation_matrix(unit_df, cols).collect()}
    exp = unit_pdf[cols].corr().fillna(0)
    for a in cols:
        for b in cols:
            assert abs(got[(a, b)] - exp.loc[a, b]) < 1e-9
    top = P.top_correlation(P.correlation_matrix(unit_df, cols)).first()
    assert {top["col_a"], top["col_b"]} == {"daromad", "sotib_oldi"} or abs(top["r"]) > 0


def test_constant_column_correlation_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation_matrix(df).collect()}
    assert got[("a", "b")] == 0.0 and got[("a", "a")] == 0.0 and abs(got[("b", "b")] - 1) < 1e-12


def test_exact_quantiles_vs_numpy_and_repartition(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.integers(0, 20, 3000), rng.normal(0, 1, 2000), np.full(2500, 7.0)])
    pdf = pd.DataFrame({"k": rng.integers(0, 3, len(vals)), "v": vals})
    df = spark.createDataFrame(pdf)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    for frame in (df, df.repartition(17)):
        got = {r["k"]: r for r in exact_quantiles(frame, ["k"], "v", probs).collect()}
        for k, g in pdf.groupby("k"):
            exp = np.quantile(g["v"].values, probs)
            for i, e in enumerate(exp):
                assert abs(got[k][f"q{i}"] - e) < 1e-9
    approx = approx_quantiles(df, ["k"], "v", (0.5,)).collect()
    assert len(approx) == 3


def test_full_profile_sections(unit_df):
    sections = {r["section"] for r in P.full_profile(unit_df.drop("rid")).select("section").distinct().collect()}
    assert sections == {"basic", "missing", "duplicates", "numeric", "correlation", "categorical", "top_values"}


def test_correlation_tiled_equals_single_block(spark, unit_df):
    """Tiling the Gram pass by column blocks gives the same matrix."""
    df = unit_df.withColumn("x2", unit_df["yosh"] * 2.5 - unit_df["daromad"]).withColumn(
        "x3", unit_df["daromad"] / 7.0 + 1.0)
    one = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation_matrix(df).collect()}
    tiled = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation_matrix(df, block=2).collect()}
    assert one.keys() == tiled.keys() and len(one) == 36
    for key, v in one.items():
        assert abs(v - tiled[key]) < 1e-12


def test_numeric_summary_all_null_column(spark, unit_df):
    """A column with no values keeps its row: count 0, NULL statistics."""
    from pyspark.sql import functions as F
    df = unit_df.withColumn("empty", F.lit(None).cast("double"))
    rows = {r["column"]: r for r in P.numeric_summary(df).collect()}
    assert rows["empty"]["count"] == 0
    assert rows["empty"]["p50"] is None and rows["empty"]["mean"] is None
    assert rows["yosh"]["count"] == 200

import pytest

from tabsense.operators import outliers as O


def test_planted_outlier_found(unit_df):
    iqr = O.outliers_iqr(unit_df, ["daromad"]).first()
    assert iqr["outlier_count"] >= 1
    z = O.outliers_zscore(unit_df, ["daromad"]).first()
    assert z["outlier_count"] >= 1


def test_non_numeric_is_error(unit_df):
    with pytest.raises(ValueError):
        O.outliers_iqr(unit_df, ["shahar"])


def test_all_only_numeric(unit_df):
    cols = {r["column"] for r in O.outliers_all(unit_df).collect()}
    assert "daromad" in cols and "shahar" not in cols


def test_method_names():
    assert O.normalise_method("z-score") == "zscore"
    assert O.normalise_method("ZScore") == "zscore"
    assert O.normalise_method("whatever") == "iqr"


def test_zero_std_left_out(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 30.0)], "c double, d double")
    got = {r["column"] for r in O.outliers_zscore(df).collect()}
    assert got == {"d"}


def test_row_flags(unit_df):
    flagged = O.outlier_rows(unit_df, "daromad").where("is_outlier").select("rid").collect()
    assert 5 in {r["rid"] for r in flagged}

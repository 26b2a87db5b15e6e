"""Repeated rows, mixed number types and awkward values."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabsense.operators import charts as C
from tabsense.operators import metrics as M
from tabsense.operators import models as MD
from tabsense.operators import outliers as O
from tabsense.operators.dbscan import connected_components, dbscan
from tabsense.operators.neighbors import knn_predict
from tabsense.plans import requests as Q
from tabsense.sources import readers as S


def test_dbscan_training_keeps_row_count(spark):
    rows = [(0.0, 0.0)] * 8 + [(9.0, 9.0)] * 3 + [(0.01, 0.0)] * 3
    df = spark.createDataFrame(rows, "x double, y double")
    _, out = MD.train_clustering(df, ["x", "y"], "dbscan")
    got = out.groupBy("x").agg(F.count("*").alias("n"), F.count_distinct("prediction").alias("d"),
                               F.max("prediction").alias("p")).orderBy("x").collect()
    assert [(r.n, r.d) for r in got] == [(8, 1), (3, 1), (3, 1)]
    assert got[0].p == got[1].p >= 0 and got[2].p == -1


@pytest.mark.parametrize("dims", [2, 6])
def test_weighted_points_equal_copies(spark, dims):
    spots = [(0, 3), (1, 2), (2, 4), (30, 1), (40, 5)]
    weighted = spark.createDataFrame([(i, [0.2 * x] + [0.0] * (dims - 1), w) for i, (x, w) in enumerate(spots)],
                                     "pid long, vec array<double>, w long")
    got = {r.pid: (r.cluster, r.is_core) for r in dbscan(weighted, 0.25, 5).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (-1, False), 4: (4, True)}


def test_knn_counts_copies(spark):
    ref = spark.createDataFrame([(1, [0.0], "A", 2), (2, [0.1], "B", 3), (3, [9.0], "A", 9)],
                                "rid long, vec array<double>, target string, w long")
    q = spark.createDataFrame([(7, [0.0])], "qid long, vec array<double>")
    assert [(r.qid, r.prediction) for r in knn_predict(q, ref, 5).collect()] == [(7, "B")]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(301).select(F.col("id").alias("node"))
    assert connected_components(edges, nodes).select("comp").distinct().count() == 1


def test_int_labels_and_double_predictions(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0)], "label int, prediction double")
    assert M.eval_classification(df).first()["accuracy"] == pytest.approx(2 / 3)
    assert {r["class"] for r in M.class_stats(df).collect()} == {"0", "1"}


def test_silhouette_does_not_move_with_the_data(spark):
    rows = [(c, 10.0 * c + 0.001 * i) for c in range(2) for i in range(20)]
    df = spark.createDataFrame(rows, "c int, x double").withColumn("v", F.array("x"))
    far = df.withColumn("x", F.col("x") + 1e9).withColumn("v", F.array("x"))
    for features in (["x"], "v"):
        near, moved = (M.silhouette(d, features, "c").first()[0] for d in (df, far))
        assert near > 0.99 and moved == pytest.approx(near, abs=1e-6)


def test_constant_column_has_no_outlier_rows(spark):
    df = spark.range(5).select(F.lit(2.0).alias("x"))
    assert O.outlier_rows(df, "x", "zscore").where("is_outlier").count() == 0


def test_histogram_of_a_heavy_tail(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 0, 1e13).otherwise(F.col("id") / 1e4).alias("x"))
    assert C.histogram(df, "x").agg(F.sum("count")).first()[0] == 1000


def test_target_among_names_that_differ_by_case(spark):
    df = spark.createDataFrame([("target id",)], "m string")
    cols = ["ID", "id", "z"]
    assert df.select(Q.pick_target(F.col("m"), cols, F.array().cast("array<string>"))).first()[0] == "id"


def test_codes_stay_text_and_bytes_decide_the_encoding(spark):
    d = tempfile.mkdtemp()
    for name, data in (("a.csv", "code,t\n10d,é\n22f,�\n".encode()), ("b.csv", "code,t\n1,é\n".encode("latin-1"))):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    a = S.read_csv(spark, os.path.join(d, "a.csv")).collect()
    assert [(r.code, r.t) for r in a] == [("10d", "é"), ("22f", "�")]
    assert [(r.code, r.t) for r in S.read_csv(spark, os.path.join(d, "b.csv")).collect()] == [(1, "é")]


def test_json_array_after_a_tab(spark):
    path = os.path.join(tempfile.mkdtemp(), "a.json")
    with open(path, "w") as f:
        f.write('\t[{"a": 1},\n{"a": 2}]')
    assert sorted(r.a for r in S.read_json(spark, path).collect()) == [1, 2]

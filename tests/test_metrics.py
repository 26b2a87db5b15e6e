import numpy as np
import pandas as pd

from tabsense.operators import metrics as M


def test_regression_metrics(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(10, 3, 500)
    y[:10] = 0.0
    p = y + rng.normal(0, 1, 500)
    got = M.eval_regression(spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))).first()
    e = y - p
    assert abs(got["mae"] - np.abs(e).mean()) < 1e-9
    assert abs(got["rmse"] - np.sqrt((e ** 2).mean())) < 1e-9
    assert abs(got["r2"] - (1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    nz = y != 0
    assert abs(got["mape"] - np.mean(np.abs(e[nz] / y[nz])) * 100) < 1e-9


def test_classification_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c"), ("c", "c")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    m = M.eval_classification(df).first()
    assert abs(m["accuracy"] - 4 / 6) < 1e-12
    # per class: a p=1 r=.5; b p=1/3 r=1; c p=1 r=2/3
    f1 = [2 * 1 * .5 / 1.5, 2 * (1 / 3) / (4 / 3), 2 * (2 / 3) / (5 / 3)]
    assert abs(m["f1_macro"] - np.mean(f1)) < 1e-12
    cm = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("c", "b")] == 1 and cm[("a", "c")] == 0


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "label string, prediction string")
    rep = {r["class"]: r for r in M.class_report(df).collect()}
    assert rep["b"]["precision"] == 0.0 and rep["a"]["recall"] == 0.0 and rep["a"]["f1"] == 0.0


def test_auc_with_ties_matches_rank_formula(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 2000)
    s = np.round(rng.normal(y * 0.5, 1, 2000), 1)        # many ties
    got = M.roc_auc(spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))).first()[0]
    ranks = pd.Series(s).rank().values
    pos = y == 1
    exp = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert abs(got - exp) < 1e-12


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(6, 1, (50, 2)), [[20.0, 20.0]]])
    lab = np.array([0] * 60 + [1] * 50 + [2])
    pdf = pd.DataFrame({"f1": x[:, 0], "f2": x[:, 1], "c": lab})
    got = M.silhouette(spark.createDataFrame(pdf), ["f1", "f2"], "c").first()[0]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-9


def test_silhouette_single_cluster_is_minus_one(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0)], "f double, c int")
    assert M.silhouette(df, ["f"], "c").first()[0] == -1.0

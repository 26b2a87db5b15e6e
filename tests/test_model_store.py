"""Every MLlib algorithm: train, save, load in another object, predict the same."""
import pytest
from pyspark.sql import functions as F

from tabsense.operators import explain as X
from tabsense.operators import models as MD


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(160).selectExpr(
        "id % 17 * 1.0 AS a", "pow(id % 5, 2) AS b", "CASE WHEN id % 3 = 0 THEN 'u' WHEN id % 3 = 1 THEN 'v' END AS c",
        "3.0 * (id % 17) - pow(id % 5, 2) + id / 100 AS y", "CASE WHEN id % 17 > 8 THEN 'yes' ELSE 'no' END AS flag").cache()


@pytest.mark.parametrize("task,name", [("regression", n) for n in ("linear_regression", "lasso", "decision_tree", "svm")] +
                         [("classification", n) for n in ("logistic_regression", "naive_bayes", "svm", "decision_tree")])
def test_round_trip(table, tmp_path, task, name):
    target = "y" if task == "regression" else "flag"
    df = table.drop("flag" if task == "regression" else "y")
    res = MD.train_supervised(df, target, algorithm=name, cv_folds=0)
    loaded = MD.load_model(MD.save_model(res, str(tmp_path / "model")))
    raw = df.withColumn("rid", F.monotonically_increasing_id())
    ours = {r.rid: r.prediction for r in res.model.transform(res.prep.model.transform(raw)).select("rid", "prediction").collect()}
    theirs = {r.rid: r.prediction for r in loaded.transform(raw).select("rid", "prediction").collect()}
    assert ours == pytest.approx(theirs) and len(set(ours.values())) > 1


def test_svm_is_explained(table):
    df = table.drop("y")
    res = MD.train_supervised(df, "flag", algorithm="svm", cv_folds=2)
    assert res.algorithm_used == "svm_rff" and res.metrics["accuracy"] > 0.8 and res.cv_error is None
    rank = {r.feature: r["rank"] for r in X.permutation_importance(res, df, repeats=2).collect()}
    assert rank["a"] == 1 and set(rank) == {"a", "b", "c"}


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_knn_has_a_cv_score_and_is_explained(table, task):
    df = table.drop("y" if task == "classification" else "flag")
    res = MD.train_supervised(df, "flag" if task == "classification" else "y", algorithm="knn", cv_folds=2)
    assert res.algorithm_used == "knn" and res.cv_error is None and res.metrics["cv_mean_score"] > 0.7
    rank = {r.feature: r["rank"] for r in X.permutation_importance(res, df, repeats=2).collect()}
    assert rank["a"] == 1 and set(rank) == {"a", "b", "c"}


def test_knn_tuning_takes_the_best_of_the_grid(table, monkeypatch):
    asked = {}
    monkeypatch.setattr(MD, "cv_score", lambda est, *a, neighbors=5, **kw: asked.setdefault(neighbors, neighbors == 3) * 1.0)
    res = MD.train_supervised(table.drop("y"), "flag", algorithm="knn", cv_folds=0, tuning=True)
    assert sorted(asked) == MD.KNN_GRID and res.neighbors == 3


def test_permuted_values_keep_their_type(spark):
    """Values travel as text: doubles, booleans, wide integers and nulls come back as they were."""
    df = spark.range(60).selectExpr("id / 7.0D AS d", "id % 2 = 0 AS t", "9223372036854775800 + id % 7 AS w",
                                    "CASE WHEN id % 4 > 0 THEN 'é' || id % 4 END AS s", "id % 2 AS y")
    res = MD.train_supervised(df, "y", task_type="classification", algorithm="decision_tree", cv_folds=0)
    got = {r.feature: r.importance for r in X.permutation_importance(res, df, repeats=2).collect()}
    assert got["t"] > 0.2 and set(got) == {"d", "t", "w", "s"}


def test_trained_here_explained_in_another_session(table, spark, tmp_path):
    """Saved and listed by the run, found as the session's newest, equal predictions and ranks."""
    from tabsense.operators import model_store as ST
    from tabsense.plans import report as H

    root, df = str(tmp_path / "store"), table.drop("y")
    ctx = H.StepContext(df, "007", "d1", store=root)
    status, out = H.run_steps(ctx, [{"tool": "train_model", "args": {"target": "flag", "algorithm": "decision_tree"}},
                                    {"tool": "train_model", "args": {"target": "flag", "algorithm": "knn"}},
                                    {"tool": "explain_model"}])
    assert [r.error for r in status.orderBy("step").collect()] == [None] * 3
    tree, knn = (o["result"]["model_id"] for o in out[:2])
    other = spark.newSession()
    assert ST.find_model(other, root, "007")["id"] == knn and ST.find_model(other, root, model_id=tree)["dataset_id"] == "d1"
    with pytest.raises(ValueError):
        ST.find_model(other, root, "7")
    for mid in (tree, knn):
        ours, theirs = ctx.models[mid], ST.load_result(other, ST.find_model(other, root, model_id=mid)["filepath"])
        raw = df.withColumn("rid", F.monotonically_increasing_id())
        got = [{r.rid: r.prediction for r in m.predict(m.prep.model.transform(raw)).select("rid", "prediction").collect()}
               for m in (ours, theirs)]
        assert got[0] == got[1] and len(set(got[0].values())) == 2 and theirs.classes == ["no", "yes"]
    native = [X.explain_top(ctx.models[tree], df), ST.explain_saved(other, root, df, model_id=tree)]
    assert native[0].collect() == native[1].collect() and native[1].first()["source"] == "native"
    later = H.StepContext(df, "007", "d1", store=root)
    _, again = H.run_steps(later, [{"tool": "explain_model"}])
    assert again[0]["result"] == out[2]["result"] and again[0]["result"]["model_id"] == knn

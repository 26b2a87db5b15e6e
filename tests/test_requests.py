from pyspark.sql import functions as F

from tabsense.plans import requests as Q

COLS = ["yosh", "daromad", "shahar", "sotib_oldi"]
CASES = [
    ("umumiy tahlil qil", ["eda"]),
    ("anomaliyalarni top", ["outliers"]),
    ("korrelyatsiya xaritasini chiz", ["chart"]),
    ("grafik chiz", ["auto_charts"]),
    ("sotib_oldi ni bashorat qiladigan model o'qit", ["train_model"]),
    ("model o'qit va qaysi ustunlar muhimligini ko'rsat", ["train_model", "explain_model"]),
    ("3 ta klasterga ajrat", ["cluster"]),
    ("PDF hisobot yarat", ["report"]),
    ("salom", []),
]


def _plans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, message string")
    return {r["i"]: r for r in Q.plan(df, "message", COLS).collect()}


def test_planner_tools(spark):
    got = _plans(spark, [t for t, _ in CASES])
    for i, (_, tools) in enumerate(CASES):
        assert list(got[i]["tools"]) == tools


def test_planner_arguments(spark):
    got = _plans(spark, ["yosh va daromad bo'yicha scatter chiz",
                         "sotib_oldi ni bashorat qil xgboost bilan",
                         "target: shahar, random forest bilan model o’qit",
                         "5 ta klaster, dbscan bilan guruhla"])
    assert dict(got[0]["steps"][0]["args"]) == {"chart_type": "scatter_plot", "x": "yosh", "y": "daromad"}
    args = dict(got[1]["steps"][0]["args"])
    assert args["target"] == "sotib_oldi" and args["algorithm"] == "xgboost"
    args = dict(got[2]["steps"][0]["args"])
    assert args["target"] == "shahar" and args["algorithm"] == "random_forest"
    args = dict(got[3]["steps"][0]["args"])
    assert args["algorithm"] == "dbscan" and args["n_clusters"] == "5"


def test_validate_plans(spark):
    plans = ['{"steps": [{"tool": "eda", "args": {}}, {"tool": "nope"}, '
             '{"tool": "chart", "args": {"chart_type": "radar"}}, {"tool": "chart", "args": [1]}]}',
             'not json']
    df = spark.createDataFrame([(p,) for p in plans], "plan string")
    out = Q.validate_plans(df, "plan").collect()
    assert [s["tool"] for s in out[0]["valid_steps"]] == ["eda", "chart"]
    assert dict(out[0]["valid_steps"][1]["args"]) == {}
    assert out[1]["valid_steps"] == []


def test_validate_plans_reads_chart_names_as_plans_write_them(spark):
    """An empty or null kind stays, any case is read, a name that only the chart call knows goes."""
    kinds = ['""', "null", '"Bar"', '"heatmap"', '"correlation_matrix"', '"DIST"', '"bar chart"']
    steps = ", ".join(f'{{"tool": "chart", "args": {{"chart_type": {k}, "x": "{i}"}}}}' for i, k in enumerate(kinds))
    out = Q.validate_plans(spark.createDataFrame([(f'{{"steps": [{steps}]}}',)], "plan string"), "plan").first()
    assert [dict(s["args"])["x"] for s in out["valid_steps"]] == ["0", "1", "2", "3", "5"]

"""Request tagging: a column of free-text analysis requests -> a column of plans.

The keyword planner of the reference, rebuilt as native column expressions (no
UDF), so a whole message log is tagged in one pass: normalisation, mentioned
columns in text order, target choice, the eight intent flags, chart kind,
algorithm, cluster settings, and the ordered list of at most six steps.  A
second operator validates JSON plans coming from elsewhere.

Word boundaries are written as explicit classes ``[\\p{L}\\p{N}_]`` so the Java
regex engine treats every script the same way as the reference does.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.operators.charts import CHART_ALIASES, CHART_TYPES

MAX_STEPS = 6
W = r"[\p{L}\p{N}_]"
NB = rf"(?<!{W})"     # start of a word
NA = rf"(?!{W})"      # end of a word

# Apostrophe variants folded to "'" by normalisation.
APOSTROPHES = "‘’ʻʼ`´"

# Intent patterns ("\b" written as NB / NA).
INTENTS = {
    "report": r"hisobot|report|pdf|otchet|отч[её]т",
    "explain": r"izoh|muhim|importance|explain|qaysi ustun|ta'sir",
    "cluster": r"klaster|cluster|guruhla|segment",
    "outliers": r"anomal|outlier|chetlan|g'alati|noodatiy",
    "explicit_train": rf"o'qit|oqit|train|yarat|qur{NA}|qurib|build|{NB}fit{NA}",
    "train_words": r"model|bashorat|predict|prognoz|klassifik|classif|regressiya|regression",
    "chart": (r"grafik|chart|plot|diagramma|gistogram|histogram|scatter|heatmap|korrelyatsiya|"
              r"korelyatsiya|correlation|chiz|vizual|pie|doira|taqsimot|distribution"),
    "eda": (rf"tahlil|{NB}eda{NA}|statistik|analy|umumiy|tavsif|describe|summary|ma'lumot haqida|"
            r"yo'qolgan|missing|takror|duplicate"),
}

# Algorithm patterns, first match wins.
ALGORITHMS = [
    (r"random\s*forest|tasodifiy o'rmon", "random_forest"),
    (r"xgboost", "xgboost"), (r"lightgbm|lgbm", "lightgbm"), (r"catboost", "catboost"),
    (r"gradient\s*boost", "gradient_boosting"),
    (r"logistic|logistik", "logistic_regression"),
    (r"linear\s*reg|chiziqli regressiya", "linear_regression"),
    (r"ridge", "ridge"), (r"lasso", "lasso"),
    (r"decision\s*tree|daraxt", "decision_tree"),
    (r"naive\s*bayes", "naive_bayes"), (r"knn", "knn"), (rf"{NB}svm{NA}", "svm"),
]

# Chart-kind patterns, first match wins.
CHART_KEYWORDS = [
    (r"heatmap|issiqlik|korrelyatsiya|korelyatsiya|correlation", "heatmap"),
    (r"scatter|nuqta", "scatter_plot"),
    (rf"box\s*plot|boxplot|{NB}box{NA}|qutichali", "box_plot"),
    (r"pie|doira|dumaloq", "pie_chart"),
    (r"violin", "violin_plot"),
    (r"pair\s*plot|pairplot", "pair_plot"),
    (r"line|chiziqli grafik|trend|dinamika", "line_chart"),
    (r"count|sanoq", "count_plot"),
    (r"bar|ustunli", "bar_chart"),
    (rf"taqsimot|distribution|{NB}kde{NA}", "distribution_plot"),
    (r"gistogram|histogram", "histogram"),
]

TOOLS = ["eda", "outliers", "chart", "auto_charts", "train_model", "cluster", "explain_model", "report"]
STRIP = "[.,;:!?'\"]"
STEP = T.StructType([T.StructField("tool", T.StringType()),
                     T.StructField("args", T.MapType(T.StringType(), T.StringType()))])


def u(p: str) -> str:
    """Unicode-aware Java pattern."""
    return "(?U)" + p


def normalize(c: Column) -> Column:
    """Q1: fold apostrophe variants to ' and lower-case."""
    return F.lower(F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES)))


def _lit_norm(s: str) -> str:
    return s.translate(str.maketrans({ch: "'" for ch in APOSTROPHES})).lower()


def mentioned(msg: Column, columns: Sequence[str]) -> Column:
    """Q2: dataset columns named as whole words, in order of first appearance."""
    if not columns:
        return F.array().cast("array<string>")
    hits = F.array(*[F.struct(F.regexp_instr(msg, F.lit(u(NB + re.escape(_lit_norm(c)) + NA))).alias("pos"),
                              F.lit(c).alias("col")) for c in columns])
    found = F.array_sort(F.filter(hits, lambda h: h["pos"] > 0))
    return F.transform(found, lambda h: h["col"])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{STRIP}+|{STRIP}+$", "")


def pick_target(msg: Column, columns: Sequence[str], mentions: Column) -> Column:
    """Q3: after target/maqsad/nishon; else the word before bashorat/predict/prognoz;
    else the first mentioned column; else the last column."""
    names = {_lit_norm(c): c for c in columns}      # of names that differ by case the last one wins
    low = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) \
        if columns else F.create_map().cast("map<string,string>")
    m1 = _strip(F.regexp_extract(msg, u(r"(?:target|maqsad|nishon)\w*\s*[:=]?\s*([^\s,;]+)"), 1))
    m2 = _strip(F.regexp_extract(msg, u(r"([^\s,;]+)\s+(?:ni\s+|ning\s+)?(?:bashorat|predict|prognoz)"), 1))
    last = F.lit(columns[-1]) if columns else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(low, m1), F.try_element_at(low, m2),
                      F.try_element_at(mentions, F.lit(1)), last)


def intents(msg: Column) -> dict[str, Column]:
    """Q4: the eight intent flags with the reference's two exclusions."""
    f = {k: msg.rlike(u(p)) for k, p in INTENTS.items()}
    train = f["train_words"] & ~f["cluster"]
    train = F.when(f["explain"] & ~f["explicit_train"], F.lit(False)).otherwise(train)
    return {"eda": f["eda"], "outliers": f["outliers"], "chart": f["chart"], "cluster": f["cluster"],
            "train": train, "explicit_train": f["explicit_train"], "explain": f["explain"],
            "report": f["report"]}


def _first_match(msg: Column, table: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pat, name in reversed(table):
        out = F.when(msg.rlike(u(pat)), F.lit(name)).otherwise(out)
    return out


def chart_kind(msg: Column) -> Column:
    """Q6: first matching chart pattern (NULL when none)."""
    return _first_match(msg, CHART_KEYWORDS)


def algorithm(msg: Column) -> Column:
    """Q7: first matching algorithm pattern (NULL when none)."""
    return _first_match(msg, ALGORITHMS)


def cluster_settings(msg: Column) -> tuple[Column, Column]:
    """Q7: cluster algorithm and k from "N ta klaster" (default 3)."""
    algo = (F.when(msg.contains("dbscan"), "dbscan")
            .when(msg.rlike(u("hierarch|ierarx")), "hierarchical").otherwise("kmeans"))
    k = F.regexp_extract(msg, u(r"(\d+)\s*(?:ta\s*)?(?:klaster|cluster|guruh)"), 1)
    return algo, F.coalesce(F.nullif(k, F.lit("")).try_cast("int"), F.lit(3))


def _args(*pairs) -> Column:
    """map<string,string> from (key, value column) pairs, NULL values left out."""
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))]) if pairs \
        else F.create_map().cast("map<string,string>")
    return F.map_filter(m, lambda k, v: v.isNotNull())


def plan(df: DataFrame, text_col: str, columns: Sequence[str], dataset_col: str | None = None) -> DataFrame:
    """Q5 (+Q1-Q4, Q6, Q7, Q9): tag every request with its ordered steps."""
    msg = normalize(F.col(text_col))
    base = df.withColumn("_msg", msg)
    m = F.col("_msg")
    base = base.withColumn("mentioned", mentioned(m, columns))
    men = F.col("mentioned")
    flags = intents(m)
    for k, v in flags.items():
        base = base.withColumn(f"want_{k}", v)
    ck = chart_kind(m)
    calgo, k = cluster_settings(m)
    nmen = F.size(men)
    eda = F.struct(F.lit("eda").alias("tool"), _args().alias("args"))
    outl = F.struct(F.lit("outliers").alias("tool"),
                    _args(("method", F.when(m.rlike(u("z-?score")), "zscore").otherwise("iqr"))).alias("args"))
    no_xy = ck.isin("heatmap", "pair_plot")
    chart_step = F.when(
        ck.isNull() & (nmen == 0), F.struct(F.lit("auto_charts").alias("tool"), _args().alias("args"))
    ).otherwise(F.struct(F.lit("chart").alias("tool"), _args(
        ("chart_type", F.coalesce(ck, F.lit("histogram"))),
        ("x", F.when(~F.coalesce(no_xy, F.lit(False)), F.try_element_at(men, F.lit(1)))),
        ("y", F.when(~F.coalesce(no_xy, F.lit(False)) & (nmen > 1), F.try_element_at(men, F.lit(2)))),
        ("hue", F.when(~F.coalesce(no_xy, F.lit(False)) & (nmen > 2), F.try_element_at(men, F.lit(3))))).alias("args")))
    cluster = F.struct(F.lit("cluster").alias("tool"), _args(
        ("algorithm", calgo), ("n_clusters", k),
        ("features", F.when(nmen >= 2, F.array_join(men, ",")))).alias("args"))
    train = F.struct(F.lit("train_model").alias("tool"), _args(
        ("target", pick_target(m, columns, men)), ("algorithm", algorithm(m))).alias("args"))
    explain = F.struct(F.lit("explain_model").alias("tool"), _args().alias("args"))
    report = F.struct(F.lit("report").alias("tool"), _args().alias("args"))
    steps = F.array(
        F.when(F.col("want_eda"), eda), F.when(F.col("want_outliers"), outl),
        F.when(F.col("want_chart"), chart_step), F.when(F.col("want_cluster"), cluster),
        F.when(F.col("want_train"), train), F.when(F.col("want_explain"), explain),
        F.when(F.col("want_report"), report))
    out = base.withColumn("steps", F.slice(F.filter(steps, lambda s: s.isNotNull()), 1, MAX_STEPS))
    out = out.withColumn("tools", F.transform("steps", lambda s: s["tool"]))
    if dataset_col:
        out = out.withColumn("needs_dataset", (F.size("steps") > 0) & F.col(dataset_col).isNull())
    return out.drop("_msg")


def validate_plans(df: DataFrame, json_col: str) -> DataFrame:
    """Q8: keep steps naming a known tool; non-object args become {}; a step whose
    chart_type is not a known kind or a short name of one is dropped (an empty one counts
    as none, and ``correlation_matrix`` is no plan's name for a heatmap); at most six steps."""
    raw = F.from_json(F.col(json_col), "struct<steps: array<string>>")
    known_charts = F.array(*[F.lit(c) for c in [*CHART_TYPES, *CHART_ALIASES] if c != "correlation_matrix"])
    tools = F.array(*[F.lit(t) for t in TOOLS])

    def parse(e: Column) -> Column:
        args_raw = F.get_json_object(e, "$.args")
        args = F.when(F.ltrim(args_raw).startswith("{"),
                      F.from_json(args_raw, "map<string,string>")).otherwise(
            F.create_map().cast("map<string,string>"))
        return F.struct(F.get_json_object(e, "$.tool").alias("tool"),
                        F.coalesce(args, F.create_map().cast("map<string,string>")).alias("args"))

    parsed = F.transform(F.coalesce(raw["steps"], F.array().cast("array<string>")), parse)
    ok = F.filter(parsed, lambda s: F.array_contains(tools, s["tool"]) & (
        (F.coalesce(s["args"]["chart_type"], F.lit("")) == "") | F.array_contains(known_charts, F.lower(s["args"]["chart_type"]))))
    return df.withColumn("valid_steps", F.slice(ok, 1, MAX_STEPS))

"""Request-tagging queries (Q1-Q9) over the user messages of ``conversations``.

The generated messages never hit an intent pattern, so every message gets one of
the reference's test phrases appended, chosen by ``conv_id % 11`` (the same
expression in query and oracle); the dataset columns are the test frame's.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.plans import requests as Q
from tabsense.workload.base import register, table

COLS = ["yosh", "daromad", "shahar", "sotib_oldi"]
# Request phrases of the reference's planner tests, in order.
PHRASES = [
    "umumiy tahlil qil",
    "anomaliyalarni top",
    "korrelyatsiya xaritasini chiz",
    "grafik chiz",
    "sotib_oldi ni bashorat qiladigan model o'qit",
    "model o'qit va qaysi ustunlar muhimligini ko'rsat",
    "3 ta klasterga ajrat",
    "PDF hisobot yarat",
    "salom",
    "yosh va daromad bo'yicha scatter chiz",
    "sotib_oldi ni bashorat qil xgboost bilan",
]
WC = r"[^\p{L}\p{N}_]"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PHRASE_CASE = "CASE conv_id % 11 " + " ".join(
    f"WHEN {i} THEN {_sql_str(p)}" for i, p in enumerate(PHRASES)) + " END"
MSG_SQL = (f"(SELECT conv_id, turn, lower(translate(text || ' ' || {PHRASE_CASE}, "
           f"{_sql_str(Q.APOSTROPHES)}, {_sql_str(chr(39) * len(Q.APOSTROPHES))})) AS msg "
           "FROM conversations WHERE role = 'user')")


def messages(spark, sf):
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]),
                          (F.pmod(F.col("conv_id"), F.lit(11)) + 1).cast("int"))
    return conv.select("conv_id", "turn", F.concat_ws(" ", "text", phrase).alias("message"))


def re2(p: str) -> str:
    """The same pattern for DuckDB's RE2 (no lookaround): word-boundary lookarounds
    become boundary classes, which is equivalent for a yes/no match."""
    return "(?s)" + p.replace(Q.NB, f"(?:^|{WC})").replace(Q.NA, f"(?:$|{WC})")


def _match(p: str) -> str:
    return f"regexp_matches(msg, {_sql_str(re2(p))})"


def _intents_sql() -> str:
    f = {k: _match(p) for k, p in Q.INTENTS.items()}
    train = (f"(CASE WHEN {f['explain']} AND NOT {f['explicit_train']} THEN false "
             f"ELSE {f['train_words']} AND NOT {f['cluster']} END)")
    return (f"SELECT conv_id, turn, {f['eda']} AS want_eda, {f['outliers']} AS want_outliers, "
            f"{f['chart']} AS want_chart, {f['cluster']} AS want_cluster, {train} AS want_train, "
            f"{f['explain']} AS want_explain, {f['report']} AS want_report FROM {MSG_SQL}")


@register("request_intents", _intents_sql())
def q_request_intents(spark, sf):
    p = Q.plan(messages(spark, sf), "message", COLS)
    return p.select("conv_id", "turn", "want_eda", "want_outliers", "want_chart", "want_cluster",
                    "want_train", "want_explain", "want_report")


def _mentions_sql() -> str:
    pos = []
    for c in COLS:
        word = c.lower()
        hit = _sql_str("(?s)" + f"(?:^|{WC}){word}(?:$|{WC})")
        start = _sql_str(f"(?s)^{word}(?:$|{WC})")
        pre = _sql_str(f"(?s)^(.*?){WC}{word}(?:$|{WC})")
        pos.append(f"CASE WHEN NOT regexp_matches(msg, {hit}) THEN NULL WHEN regexp_matches(msg, {start}) "
                   f"THEN 1 ELSE length(regexp_extract(msg, {pre}, 1)) + 2 END")
    values = ", ".join(f"({_sql_str(c)}, p{i})" for i, c in enumerate(COLS))
    cols = ", ".join(f"{e} AS p{i}" for i, e in enumerate(pos))
    return (f"WITH m AS (SELECT conv_id, turn, {cols} FROM {MSG_SQL}) "
            f"SELECT conv_id, turn, coalesce((SELECT string_agg(name, ',' ORDER BY p) FROM (VALUES {values}) "
            f"v(name, p) WHERE p IS NOT NULL), '') AS mentioned FROM m")


@register("mentioned_columns", _mentions_sql())
def q_mentioned_columns(spark, sf):
    p = Q.plan(messages(spark, sf), "message", COLS)
    return p.select("conv_id", "turn", F.array_join("mentioned", ",").alias("mentioned"))


def _first_sql(table_: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_match(p)} THEN {_sql_str(n)}" for p, n in table_) + " END"


@register("request_charts", f"SELECT conv_id, turn, {_first_sql(Q.CHART_KEYWORDS)} AS chart_kind FROM {MSG_SQL}")
def q_request_charts(spark, sf):
    msg = Q.normalize(F.col("message"))
    return messages(spark, sf).select("conv_id", "turn", Q.chart_kind(msg).alias("chart_kind"))


@register("request_models", f"""
SELECT conv_id, turn, {_first_sql(Q.ALGORITHMS)} AS algorithm,
  CASE WHEN contains(msg, 'dbscan') THEN 'dbscan' WHEN {_match('hierarch|ierarx')} THEN 'hierarchical'
       ELSE 'kmeans' END AS cluster_algorithm,
  coalesce(TRY_CAST(nullif(regexp_extract(msg, '(\\d+)\\s*(?:ta\\s*)?(?:klaster|cluster|guruh)', 1), '') AS INTEGER), 3)
    AS n_clusters
FROM {MSG_SQL}""")
def q_request_models(spark, sf):
    msg = Q.normalize(F.col("message"))
    algo, k = Q.cluster_settings(msg)
    return messages(spark, sf).select("conv_id", "turn", Q.algorithm(msg).alias("algorithm"),
                                      algo.alias("cluster_algorithm"), k.alias("n_clusters"))


@register("request_plans")
def q_request_plans(spark, sf):
    m = messages(spark, sf).withColumn(
        "dataset_id", F.when(F.col("turn") >= 2, F.concat(F.lit("d"), F.col("conv_id").cast("string"))))
    p = Q.plan(m, "message", COLS, dataset_col="dataset_id")
    return p.select("conv_id", "turn", F.array_join("tools", ",").alias("tools"),
                    F.to_json("steps").alias("steps"), "needs_dataset")


def _plan_validate_sql() -> str:
    """Every planned step names a known tool and chart kind, so validation keeps
    them all and drops only the appended unknown step; both counts are the number
    of raised intents, capped at six."""
    n = ("least(6, CAST(want_eda AS INTEGER) + CAST(want_outliers AS INTEGER) + CAST(want_chart AS INTEGER)"
         " + CAST(want_cluster AS INTEGER) + CAST(want_train AS INTEGER) + CAST(want_explain AS INTEGER)"
         " + CAST(want_report AS INTEGER))")
    return f"SELECT conv_id, turn, {n} AS n_steps, {n} AS n_valid FROM ({_intents_sql()}) i"


@register("plan_validate", _plan_validate_sql())
def q_plan_validate(spark, sf):
    p = Q.plan(messages(spark, sf), "message", COLS)
    bogus = F.struct(F.lit("bogus").alias("tool"), F.create_map().cast("map<string,string>").alias("args"))
    js = F.to_json(F.struct(F.concat("steps", F.array(bogus)).alias("steps")))
    v = Q.validate_plans(p.select("conv_id", "turn", "steps", js.alias("plan_json")), "plan_json")
    return v.select("conv_id", "turn", F.size("steps").alias("n_steps"),
                    F.size("valid_steps").alias("n_valid"))

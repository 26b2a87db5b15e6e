"""Report tables, one-line summaries, and a step runner that isolates failures.

The report is data, not a PDF: one long frame ``(section, ord, column, metric,
value, text)`` holding the overview, per-column types and missing values (first
40 columns), numeric statistics (first 25), IQR outliers (first 25 with any),
the auto-chart tables' kinds, and the newest five models of the dataset.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions import kinds as K
from tabsense.operators import catalog as R
from tabsense.operators import charts as C
from tabsense.operators import outliers as O
from tabsense.operators import profile as P

REPORT_COLS = ["section", "ord", "column", "metric", "value", "text"]


def _row(df: DataFrame, section: int, ord_, column, metric, value, text=None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), ord_.cast("int").alias("ord"),
                     column.cast("string").alias("column"), F.lit(metric).alias("metric"),
                     value.cast("double").alias("value"),
                     (text if text is not None else F.lit(None)).cast("string").alias("text"))


def _stacked(df: DataFrame, section: int, metrics: Sequence[str], text: str | None = None) -> DataFrame:
    """One section row per (input row, metric) with a single ``stack``: the input
    aggregate is evaluated once, not once per metric."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return df.selectExpr(f"{section} AS section", "CAST(ord AS INT) AS ord", "CAST(column AS STRING) AS column",
                         f"stack({len(metrics)}, {pairs}) AS (metric, value)",
                         f"CAST({text or 'NULL'} AS STRING) AS text")


def report_tables(df: DataFrame, models: DataFrame | None = None, dataset_id: str | None = None,
                  max_columns: int | None = None, max_numeric: int | None = None, max_outliers: int | None = None,
                  with_charts: bool = True) -> DataFrame:
    """H1: the six report sections as one long frame."""
    mv = P.missing_values(df)
    cnt = df.agg(F.count(F.lit(1)).alias("rows"))
    overview = (cnt.select("rows", F.lit(len(df.columns)).alias("columns"),
                           P.duplicate_rows(df).scalar().alias("duplicate_rows"),
                           mv.agg(F.sum("missing_count")).scalar().alias("total_missing")))
    overview = overview.select(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("column"), "*")
    parts = [_stacked(overview, 1, ["rows", "columns", "duplicate_rows", "total_missing"])]
    parts[0] = parts[0].withColumn("ord", F.expr(
        "CASE metric WHEN 'rows' THEN 0 WHEN 'columns' THEN 1 WHEN 'duplicate_rows' THEN 2 ELSE 3 END"))
    parts.append(_stacked(mv if max_columns is None else mv.where(F.col("ord") < max_columns), 2, ["missing_count", "missing_pct"], "dtype"))
    num = K.numeric_columns(df)[:max_numeric]
    if num:
        summary = P.numeric_summary(df, num)
        parts.append(_stacked(summary, 3, ["mean", "std", "min", "p50", "max"]))
        all_num = K.numeric_columns(df)
        # the summary already holds the quartiles of these columns: one quantile job, not two
        shared = O.fences(summary.select("ord", "column", F.col("p25").alias("q1"),
                                         F.col("p75").alias("q3"))) if all_num == num else None
        out = O.outliers_iqr(df, all_num, bounds=shared).where("outlier_count > 0")
        out = out if max_outliers is None else out.orderBy("ord").limit(max_outliers)
        parts.append(_stacked(out, 4, ["outlier_count", "outlier_pct", "lower_bound", "upper_bound"]))
    if with_charts:
        try:
            ac = C.auto_charts(df, 4).select("chart", "chart_type", "x").distinct()
            parts.append(_row(ac, 5, F.col("chart"), F.col("x"), "chart", F.lit(None), F.col("chart_type")))
        except ValueError:
            pass
    if models is not None and dataset_id is not None:
        md = R.models_of_dataset(models, dataset_id).withColumn("ord", F.lit(0)).withColumnRenamed(
            "algorithm", "column")
        parts.append(_stacked(md, 6, list(R.REPORT_METRICS), "id").where(F.col("value").isNotNull()))
    res = parts[0].select(*REPORT_COLS)
    for p in parts[1:]:
        res = res.unionByName(p.select(*REPORT_COLS))
    return res


def summary_lines(outputs: Sequence[dict]) -> list[str]:
    """H2: one line per step result (bounded by the number of steps)."""
    lines = []
    for o in outputs:
        tool = o.get("tool")
        if not o.get("success"):
            lines.append(f"{tool} failed: {o.get('error', 'unknown error')}")
            continue
        r = o.get("result", {})
        if tool == "eda":
            lines.append(f"profile: {r.get('rows')} rows, {r.get('columns')} columns, "
                         f"{r.get('duplicate_rows')} duplicate rows")
        elif tool == "outliers":
            top = ", ".join(f"{c} {n}" for c, n in r.get("top", []))
            lines.append(f"outliers ({r.get('method')}): {top or 'none found'}")
        elif tool in ("chart", "auto_charts"):
            lines.append(f"{tool}: {r.get('chart_type', r.get('charts'))}")
        elif tool in ("train_model", "cluster"):
            met = ", ".join(f"{k}={v:.3f}" for k, v in sorted(r.get("metrics", {}).items()))
            lines.append(f"{tool}: {r.get('algorithm')} ({r.get('task_type')}) {met}")
        elif tool == "explain_model":
            lines.append("top features: " + ", ".join(f"{f} ({v:.3f})" for f, v in r.get("top", [])[:5]))
        else:
            lines.append(f"{tool} done")
    return lines


@dataclass
class StepContext:
    df: DataFrame
    session_id: str = "default"
    dataset_id: str | None = None
    store: str | None = None                # shared folder: trained models are saved and listed there
    models: dict[str, Any] = field(default_factory=dict)
    last_model: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)


def _keep(ctx: StepContext, res) -> None:
    """Remember a trained model for this run and, with a store, for later sessions."""
    from tabsense.operators.model_store import register
    ctx.models[res.model_id] = res
    ctx.last_model = res.model_id
    if ctx.store:
        register(res, ctx.df.sparkSession, ctx.store, ctx.session_id, ctx.dataset_id)


def _eda(ctx: StepContext, **_):
    prof = P.full_profile(ctx.df)
    ctx.frames["eda"] = prof
    basic = {r["metric"]: r["value"] for r in prof.where("section in ('basic', 'duplicates')").collect()}
    return {"rows": int(basic["row_count"]), "columns": int(basic["column_count"]),
            "duplicate_rows": int(basic["duplicate_rows"])}


def _outliers(ctx: StepContext, method: str = "iqr", **_):
    m = O.normalise_method(method)
    res = O.outliers_all(ctx.df, m)
    ctx.frames["outliers"] = res
    top = [(r["column"], int(r["outlier_count"])) for r in O.top_outliers(res).collect()]
    return {"method": m, "top": top}


def _chart(ctx: StepContext, chart_type: str = "histogram", x=None, y=None, hue=None, **_):
    kind = C.chart_kind(chart_type)
    ctx.frames[f"chart:{kind}"] = C.chart(ctx.df, kind, x, y, hue)
    return {"chart_type": kind, "x": x, "y": y, "hue": hue}


def _auto(ctx: StepContext, max_charts: int = 4, **_):
    t = C.auto_charts(ctx.df, int(max_charts))
    ctx.frames["auto_charts"] = t
    return {"charts": sorted({r["chart_type"] for r in t.select("chart_type").distinct().collect()})}


def _train(ctx: StepContext, target=None, algorithm="random_forest", features=None, **_):
    from tabsense.operators import models as MD
    from tabsense.operators import prep as PR
    target = PR.need_col(ctx.df, target, "target")
    PR.check_training_input(ctx.df, target)
    feats, dropped = PR.feature_select(ctx.df, target, features)
    res = MD.train_supervised(ctx.df, target, feats, algorithm=algorithm)
    res.excluded_features = dropped
    _keep(ctx, res)
    return {"model_id": res.model_id, "algorithm": res.algorithm_requested, "task_type": res.task_type,
            "metrics": res.metrics, "excluded_features": dropped}


def _cluster(ctx: StepContext, features=None, algorithm="kmeans", n_clusters=3, **_):
    from tabsense.operators import models as MD
    feats = features.split(",") if isinstance(features, str) else features
    res, labelled = MD.train_clustering(ctx.df, feats, algorithm, int(n_clusters))
    last = ctx.last_model                   # a clustering is not what explain_model means
    _keep(ctx, res)
    ctx.last_model = last
    ctx.frames["cluster"] = labelled
    return {"model_id": res.model_id, "algorithm": res.algorithm_requested, "task_type": "clustering",
            "metrics": res.metrics}


def _explain(ctx: StepContext, model_id=None, **_):
    from tabsense.operators import explain as X
    from tabsense.operators.model_store import find_model, load_result
    mid = model_id or ctx.last_model
    if mid in ctx.models:
        res = ctx.models[mid]
    elif ctx.store:                         # by its id, else the session's newest
        spark = ctx.df.sparkSession
        res = load_result(spark, find_model(spark, ctx.store, ctx.session_id, mid)["filepath"])
        mid = res.model_id
    else:
        raise ValueError("no trained model to explain; train a model first")
    t = X.explain_top(res, ctx.df)
    ctx.frames["explain_model"] = t
    return {"model_id": mid, "top": [(r["feature"], r["importance"]) for r in t.collect()]}


def _report(ctx: StepContext, **_):
    ctx.frames["report"] = report_tables(ctx.df)
    return {"sections": 6}


TOOLS: dict[str, Callable[..., dict]] = {
    "eda": _eda, "outliers": _outliers, "chart": _chart, "auto_charts": _auto,
    "train_model": _train, "cluster": _cluster, "explain_model": _explain, "report": _report,
}


def run_steps(ctx: StepContext, steps: Sequence[dict]) -> tuple[DataFrame, list[dict]]:
    """H3: run each step; a failing step is recorded and the rest still run.
    Returns a status frame ``(step, tool, success, error)`` and the raw outputs."""
    outputs = []
    for s in steps:
        name, args = s.get("tool"), dict(s.get("args") or {})
        fn = TOOLS.get(name)
        if fn is None:
            outputs.append({"tool": name, "success": False, "args": args, "error": f"unknown tool {name}"})
            continue
        try:
            outputs.append({"tool": name, "success": True, "args": args, "result": fn(ctx, **args)})
        except Exception as exc:  # noqa: BLE001  (a failed step must not stop the rest)
            outputs.append({"tool": name, "success": False, "args": args, "error": str(exc)})
    status = ctx.df.sparkSession.createDataFrame(
        [(i, o["tool"], o["success"], o.get("error")) for i, o in enumerate(outputs)],
        "step int, tool string, success boolean, error string")
    return status, outputs

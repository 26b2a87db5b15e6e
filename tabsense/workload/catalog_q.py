"""Run-catalog queries (R2-R10) over the driver tables: ``conversations`` plays
the message log (conv_id = session, turn = insertion order), ``events`` the
session activity."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import catalog as R
from tabsense.workload.base import register, table


def _msgs(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role")


@register("history_first", """
SELECT conv_id, turn, role, CAST(pos AS INTEGER) AS pos FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
WHERE pos <= 50""")
def q_history_first(spark, sf):
    return R.history_first(_msgs(spark, sf), "conv_id", ["turn"], 50).withColumn(
        "pos", F.col("pos").cast("int"))


@register("history_recent", """
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
WHERE back <= 12""")
def q_history_recent(spark, sf):
    return R.history_recent(_msgs(spark, sf), "conv_id", "turn", 12).withColumn(
        "pos", F.col("pos").cast("int"))


@register("catalog_latest", """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def q_catalog_latest(spark, sf):
    return R.latest_per(_msgs(spark, sf), ["conv_id"], "turn", "turn")


@register("catalog_get", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7")
def q_catalog_get(spark, sf):
    return R.get_by_id(_msgs(spark, sf), 7, "conv_id")


@register("catalog_insert_new", """
WITH ex AS (SELECT conv_id, turn, role FROM conversations WHERE turn < 2),
inc AS (SELECT conv_id, turn, role FROM conversations WHERE role = 'user')
SELECT * FROM ex UNION ALL
SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.conv_id = inc.conv_id AND ex.turn = inc.turn)""")
def q_catalog_insert_new(spark, sf):
    m = _msgs(spark, sf)
    return R.upsert_ignore(m.where("turn < 2"), m.where("role = 'user'"), ["conv_id", "turn"], "turn")


@register("catalog_cascade", """
SELECT conv_id AS session_id, turn, role FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def q_catalog_cascade(spark, sf):
    m = _msgs(spark, sf).withColumnRenamed("conv_id", "session_id")
    sessions = m.select(F.col("session_id").alias("id")).distinct()
    doomed = m.where("role = 'system'").select(F.col("session_id").alias("id"))
    out = R.delete_sessions({"sessions": sessions, "conversations": m}, doomed)
    return out["conversations"]


@register("session_touch", """
SELECT CAST(user_id AS VARCHAR) AS id, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id""")
def q_session_touch(spark, sf):
    ev = table(spark, sf, "events")
    sessions = ev.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.min("ts").alias("created_at"), F.min("ts").alias("updated_at"))
    touches = ev.select(F.col("user_id").cast("string").alias("session_id"), "ts")
    return R.touch(sessions, touches).select("id", "created_at", "updated_at")

"""Source, sink and ingest queries (S1-S13).  Files are derived from the driver
tables and written under the session's shared checkpoint folder."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabsense.session import ensure_checkpoint_dir
from tabsense.sources import readers as S
from tabsense.streaming.ingest import ingest_folder
from tabsense.workload.base import register, table


def _scratch(spark, tag: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


@register("safe_names", r"""
SELECT page_id, CASE WHEN t = '' THEN 'dataset.csv' ELSE t END AS safe_name FROM (
  SELECT page_id, regexp_replace(regexp_replace(string_split(replace(url, '\', '/'), '/')[-1],
         '[^A-Za-z0-9_.\- ]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS t FROM pages)""")
def q_safe_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.safe_name(F.col("url")).alias("safe_name"))


@register("csv_roundtrip", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_csv_roundtrip(spark, sf):
    out = _scratch(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(out)
    return S.read_csv(spark, out)


@register("csv_folder", """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN c_name END AS c_name, c_acctbal,
       CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def q_csv_folder(spark, sf):
    """One folder of files with three headers: two column orders, some columns missing."""
    out, c = _scratch(spark, "csv"), table(spark, sf, "customer")
    kinds = [["c_custkey", "c_name", "c_acctbal"], ["c_acctbal", "c_custkey"], ["c_mktsegment", "c_acctbal", "c_name", "c_custkey"]]
    for k, cols in enumerate(kinds):
        c.where(F.col("c_custkey") % 3 == k).select(*cols).write.mode("append").option("header", True).csv(out)
    return S.read_csv(spark, out).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@register("tsv_roundtrip", """
SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier""")
def q_tsv_roundtrip(spark, sf):
    out = _scratch(spark, "tsv")
    table(spark, sf, "supplier").write.option("header", True).option("sep", "\t").csv(out)
    return S.read_csv(spark, out, sep="\t")


@register("json_roundtrip", """
SELECT event_id, user_id, event_type, value FROM events""")
def q_json_roundtrip(spark, sf):
    out = _scratch(spark, "json")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(out)
    return S.read_json(spark, out).select("event_id", "user_id", "event_type", "value")


@register("json_rows", """
SELECT CAST(to_json({'event_id': event_id, 'ts': CAST(ts AS VARCHAR), 'user_id': user_id,
  'event_type': event_type, 'value': CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END,
  'props': props}) AS VARCHAR) AS json FROM events""")
def q_json_rows(spark, sf):
    return S.json_rows(table(spark, sf, "events"))


@register("ingest_catalog", """
SELECT '.csv' AS ext, 'registered' AS status, CAST(NULL AS VARCHAR) AS reason,
       CAST(count(*) AS BIGINT) AS row_count, CAST(5 AS BIGINT) AS column_count FROM customer
UNION ALL
SELECT '.json', 'registered', NULL, CAST(count(*) AS BIGINT), CAST(6 AS BIGINT) FROM orders
UNION ALL
SELECT '.parquet', 'rejected', 'unsupported file type .parquet', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)""")
def q_ingest_catalog(spark, sf):
    landing = _scratch(spark, "landing")
    table(spark, sf, "customer").coalesce(1).write.option("header", True).csv(f"{landing}/a")
    table(spark, sf, "orders").coalesce(1).write.json(f"{landing}/b")
    table(spark, sf, "region").coalesce(1).write.parquet(f"{landing}/c")
    cat = ingest_folder(spark, landing, _scratch(spark, "catalog"), "s1")
    return cat.select(F.regexp_extract("filename", r"(\.[a-z]+)$", 1).alias("ext"), "status", "reason",
                      "row_count", "column_count")


@register("ingest_schemas", """
WITH c AS (SELECT count(*) AS n FROM customer), o AS (SELECT count(*) AS n FROM orders)
SELECT 'csv' AS file_type, k AS key, t AS type, CAST(n AS BIGINT) AS row_count FROM c, (VALUES
  ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) v(k, t)
UNION ALL
SELECT 'json', k, t, CAST(n AS BIGINT) FROM o, (VALUES
  ('o_orderkey', 'bigint'), ('o_totalprice', 'double'), ('o_orderstatus', 'string')) v(k, t)""")
def q_ingest_schemas(spark, sf):
    """Columns and types of many files of two types, read together and told apart by file."""
    landing = _scratch(spark, "landing")
    (table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").repartition(4)
     .write.option("header", True).csv(f"{landing}/a"))
    (table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").repartition(4)
     .write.json(f"{landing}/b"))
    cat = ingest_folder(spark, landing, _scratch(spark, "catalog"), "s1").where("status = 'registered'")
    return (cat.select("file_type", "row_count", F.explode("schema_json").alias("key", "type"))
            .groupBy("file_type", "key", "type").agg(F.sum("row_count").alias("row_count")))

"""Query registry and shared helpers for the registered workload."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (the oracle compares at 6 decimals)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        out.append(c)
    return df.select(*out)


# Null-injected projection of lineitem shared by query and oracle (no driver table
# holds a NULL, so both sides make them with the same CASE expression).
LINEITEM_NULLS_SQL = """(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_quantity < 3 THEN NULL ELSE l_discount END AS l_discount,
  l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_quantity") < 3, None).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

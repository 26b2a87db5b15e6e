"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: 64-bit words of a bit filter: 2**20 rows of 12 bytes, so at most about 16 MB are broadcast.
FILTER_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes ``df`` once; the table
    survives a lost executor because every executor sees that folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def bind(value: Column, body) -> Column:
    """``let v = value in body(v)``: evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _slot(keys: list[Column]) -> tuple[Column, Column]:
    h = F.xxhash64(*keys)
    word = F.pmod(h, F.lit(FILTER_WORDS)).cast("int")
    bit = F.shiftrightunsigned(h, 58).cast("int")
    return word, bit


def bit_filter(keys: DataFrame) -> DataFrame:
    """Bounded approximate set of the rows of ``keys``: (word, mask)."""
    word, bit = _slot([F.col(f"`{c}`") for c in keys.columns])
    return (keys.select(word.alias("word"), bit.alias("bit"))
            .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")))


def probe(df: DataFrame, bits: DataFrame, keys: list[str], hit: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter (``hit=False``: surely is not).

    There are false hits, never false misses; nothing of ``df`` is shuffled, the
    broadcast side has at most FILTER_WORDS rows.
    """
    word, bit = _slot([F.col(f"`{c}`") for c in keys])
    out = (df.withColumns({"_word": word, "_bit": bit})
           .join(F.broadcast(bits.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))),
                 "_word", "left"))
    found = F.expr("coalesce(shiftrightunsigned(_mask, _bit) & 1L, 0L) = 1L")
    return out.where(found if hit else ~found).select(*[f"`{c}`" for c in df.columns])

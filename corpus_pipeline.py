"""From raw documents to packed sequences: quality, line dedup, near-dedup, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one reads;
all but the last return the columns of ``documents``.  ``run`` writes every stage's
rows as Parquet in the shared folder and reads them again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm.common import documents, materialize
from tabsense.llm.host_quality import keep_documents
from tabsense.llm.line_dedup import line_dedup
from tabsense.llm.mixing import mixed_documents
from tabsense.llm.packing import pack
from tabsense.llm.simhash import keep_one_per_component
from tabsense.llm.tokens import packing_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` is that of the text that stays; a null one stays null."""
    out = line_dedup(docs, inside_lines=True)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), size))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs, shingle=3, max_bits=2)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, packing_vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]

#: Fingerprints, dependent rounding and tokens are not SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

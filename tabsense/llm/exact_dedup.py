"""Exact duplicates by progressive refinement (DataFrame functions only).

Three passes, each over the survivors of the one before: texts whose length
occurs once are unique; among the others, those whose (length, prefix hash)
occurs once are unique; only the rest is hashed in full.  A pass hands the next
one its surviving keys as a bit filter of bounded size, so texts are never
shuffled.  Groups are aggregated map-side, so a text held by a third of all rows
costs one partial row per task.

Defined results: null text equals empty text; a null id is smaller than any
other; rows repeating an id and its text share one decision and count in
``group_size``; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import bit_filter, materialize, probe, text_of

PREFIX_CHARS = 64


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha, keep_id, group_size) of every text held by two or more rows."""
    text = text_of(text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    keyed = base.select("id", "text", F.octet_length("text").alias("len"),
                        F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"))
    many = F.col("n") > 1
    lengths = keyed.groupBy("len").agg(F.count("*").alias("n")).where(many).select("len")
    prefixes = (probe(keyed.select("len", "prefix"), bit_filter(lengths), ["len"])
                .groupBy("len", "prefix").agg(F.count("*").alias("n")).where(many)
                .select("len", "prefix"))
    return (probe(keyed, bit_filter(prefixes), ["len", "prefix"])
            .select("id", F.unhex(F.sha2("text", 256)).alias("sha"))
            .groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays.  The join on the digest is the only
    shuffle of all rows (id and digest); a hot group is split by AQE's skew join.
    """
    groups = materialize(duplicate_groups(docs, id_col, text_col))   # else no skew split in the join
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"),
                       F.unhex(F.sha2(text_of(text_col), 256)).alias("sha"))
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return (rows.join(groups, "sha", "left")
            .select(F.col("_id").alias(id_col), keep.alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.col("_id").eqNullSafe(keep).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))

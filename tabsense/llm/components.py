"""Connected components by alternating large-star and small-star rounds.

Edges stay a distributed table of (u, v) longs; each round is two grouped minima
(partial sums first) and two joins, written to the shared folder.  It ends when a
round changes nothing, which the algorithm guarantees; there is no round cap.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import materialize


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"),
                           F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge; label is the smallest node reached."""
    cur = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                                   F.least("u", "v").alias("v")).distinct())
    seen = _digest(cur)
    if not seen[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        cur = materialize(small.where("u <> v").distinct())
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return nodes.union(roots)

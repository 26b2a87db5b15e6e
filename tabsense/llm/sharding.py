"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Equal texts form an indivisible group.  A partial partition holds one sum per
shard; the two with the largest spread are combined again and again, the heaviest
shard of one with the lightest of the other.  Groups are dealt by hash into leaves
of about ``LEAF_GROUPS``; each leaf is differenced to one partial partition, and
those are differenced in a tree of fan-in ``FAN_IN`` until one is left.  Only sums
go up the tree; the way from (leaf, bin) to shard comes back as a small table.

Defined results: null text has no bytes (size is the fixed 8) and groups with empty
text; null ids are ordinary rows; rows repeating an id keep slots of their own;
an empty table gives an empty result.
"""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import materialize, text_of

ROW_BYTES = 8
LEAF_GROUPS = 2048
FAN_IN = 256
SLOT_ROWS = 1024       # rows of one shard numbered together


def difference(parts: list[list[tuple[int, object]]], k: int) -> list[tuple[object, int]]:
    """Difference partial partitions (lists of at most k pairs (sum, label)) to one.

    Returns the bin, 0 to k - 1, of every label.
    """
    names: list = []

    def tip(label) -> int:
        names.append(label)
        return len(names) - 1

    heap = []
    for order, part in enumerate(parts):
        bins = sorted(((s, tip(label)) for s, label in part), key=lambda x: -x[0])
        bins += [(0, None)] * (k - len(bins))
        heap.append((bins[-1][0] - bins[0][0], order, bins))
    heapq.heapify(heap)
    order = len(parts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        bins = sorted(((x + y, q if p is None else p if q is None else (p, q))
                       for (x, p), (y, q) in zip(a, reversed(b))), key=lambda x: -x[0])
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], order, bins))
        order += 1
    out = []
    for i, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [] if tree is None else [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                out.append((names[node], i))
    return out


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) from groups of (key, bytes)."""
    leaves = max(1, -(-groups.count() // LEAF_GROUPS))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        bins = difference([[(int(s), i)] for i, s in enumerate(pdf["bytes"])], shards)
        at = pd.Series(dict(bins)).reindex(range(len(pdf))).to_numpy()
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "node": pdf["node"].to_numpy(),
                             "bin": at, "bytes": pdf["bytes"].to_numpy()})

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "bin"])
        parts = [[(int(s), (n, b)) for s, b in zip(g["bytes"], g["bin"])] for n, g in pdf.groupby("node")]
        rows = [(n, b, i) for (n, b), i in difference(parts, shards)]
        out = pd.DataFrame(rows, columns=["node", "bin", "up_bin"])
        return out.merge(pdf[["node", "bin", "bytes"]], on=["node", "bin"]).assign(
            up=pdf["up"].iloc[0])[["node", "bin", "up", "up_bin", "bytes"]]

    dealt = materialize(groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(leaves)))
                        .groupBy("node").applyInPandas(leaf, "key binary, node long, bin int, bytes long"))
    sums = dealt.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"))
    way = sums.select("node", "bin", F.col("node").alias("up"), F.col("bin").alias("up_bin"))
    while leaves > 1:
        leaves = -(-leaves // FAN_IN)
        step = materialize(sums.withColumn("up", F.floor(F.col("node") / FAN_IN))
                           .groupBy("up").applyInPandas(
                               inner, "node long, bin int, up long, up_bin int, bytes long"))
        link = step.select(F.col("node").alias("_n"), F.col("bin").alias("_b"),
                           F.col("up").alias("_u"), F.col("up_bin").alias("_ub"))
        way = materialize(way.join(link, (way["up"] == link["_n"]) & (way["up_bin"] == link["_b"]))
                          .select("node", "bin", F.col("_u").alias("up"), F.col("_ub").alias("up_bin")))
        sums = step.groupBy(F.col("up").alias("node"), F.col("up_bin").alias("bin")).agg(
            F.sum("bytes").alias("bytes"))
    return dealt.join(way, ["node", "bin"]).select("key", F.col("up_bin").alias("shard"))


def slots(rows: DataFrame, shard: str, order: list[str], total: int, shards: int) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each shard.

    A shard is numbered in blocks of about SLOT_ROWS rows; block offsets are running
    sums over the small table of block sizes.
    """
    blocks = max(1, -(-total // (shards * SLOT_ROWS)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    inside = Window.partitionBy(shard, "_block").orderBy(*order)
    numbered = rows.withColumn("_in", F.row_number().over(inside) - 1)
    sizes = rows.groupBy(F.col(shard).alias("_s"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    return (numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_block") == F.col("_b")))
            .withColumn("slot", F.col("_at") + F.col("_in")).drop("_s", "_b", "_at", "_in", "_block"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    text = text_of(text_col)
    rows = materialize(docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = rows.join(materialize(assign_groups(groups.select("key", "bytes"), shards)), "key")
    out = slots(placed.select("id", "size", "crc", "shard"), "shard", ["id", "size", "crc"],
                rows.count(), shards)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

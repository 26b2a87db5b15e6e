"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most ``max_repeat`` times
its own words; what is cut is dealt out again by weight.  Every document then wants
target / source_size copies.  The whole part is taken as it is; the fractional parts
are rounded dependently: two documents meet, mass (copies times words) moves at
random from one to the other until one of them is integral, the other carries on.
The moves keep every document's expectation and the source's words exactly.  A document that
all lighter ones of its group can balance meets them all at once and is settled, heaviest
first, so that a light document carries the fraction on.

Documents meet in leaves of about ``LEAF_ROWS`` rows of one source (hash of the id,
so a source with a third of all rows is many leaves), larger ones first; each leaf
leaves at most one fractional document, and these residuals meet in a reduction
tree of fan-in ``FAN_IN``.  The last residual of a source is rounded either way and
balanced by the documents of its group that fit, larger ones first, whichever comes nearer.  All randomness comes from hashes of the leaf, so reruns agree.

Defined results: null or wordless text has size 0 and is taken 0 times; a null
source is the last source; rows that repeat id, source and size are one unit and
get the same copies; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import WORD, materialize, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
LEAF_ROWS = 512
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, rank, n_rows, source_size, target) from rows of (source, size).

    Weights go round by code point of the source, null last.  The shares are found
    by filling: sources above their limit are held there and the rest is dealt
    again, one small aggregate a round, until none is above.
    """
    spark = sized.sparkSession
    totals = materialize(sized.groupBy("source").agg(F.count("*").alias("n_rows"),
                                                     F.sum("size").alias("source_size")))
    order = totals.orderBy(F.col("source").asc_nulls_last())
    ranked = (order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1], float(weights[x[1] % len(weights)]))))
    kind = totals.schema["source"].dataType.simpleString()
    cur = materialize(spark.createDataFrame(
        ranked, f"source {kind}, n_rows long, source_size long, rank long, weight double")
        .withColumn("limit", max_repeat * F.col("source_size").cast("double"))
        .withColumn("full", F.col("source_size") == 0))
    total = float(cur.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        held, open_weight = cur.agg(
            F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)),
            F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).first()
        rate = (total - (held or 0.0)) / open_weight if open_weight else 0.0
        above = ~F.col("full") & (rate * F.col("weight") > F.col("limit"))
        if cur.where(above).isEmpty():
            break
        cur = materialize(cur.withColumn("full", F.col("full") | above))
    return cur.select("source", "rank", "n_rows", "source_size",
                      F.when(F.col("full"), F.col("limit")).otherwise(rate * F.col("weight")).alias("target"))


def _whole(p):
    return np.where(np.abs(p - np.round(p)) < 1e-9, np.round(p), p)


def _against_all(mass: np.ndarray, part: np.ndarray, i: int, lighter: int, draw: float) -> bool:
    """Make ``part[i]`` integral at once: its mass goes to, or comes from, all documents from
    ``lighter`` on, in proportion to how far each can move either way, so that every
    expectation stays.  False if they cannot take it."""
    room = np.minimum(part[lighter:], 1 - part[lighter:])
    able = room @ mass[lighter:]
    if max(part[i], 1 - part[i]) * mass[i] > able:
        return False
    up = draw < part[i]
    part[lighter:] = _whole(part[lighter:] + room * ((part[i] - up) * mass[i] / able))
    part[i] = up
    return True


def settle(mass: np.ndarray, part: np.ndarray, seed: int) -> np.ndarray:
    """Pivotal rounding of ``part`` in the given order (heaviest first); at most one value
    stays fractional.  A document that all lighter ones together can balance is settled
    against them, so that it is a light one that stays; others meet in pairs."""
    part = part.astype(float).copy()
    draw, again = np.random.default_rng(seed).random((2, len(part)))
    carry = -1
    for i in range(len(part)):
        if not 0 < part[i] < 1:
            continue
        if carry >= 0:
            mc, mi, pc, pi = mass[carry], mass[i], part[carry], part[i]
            up = min((1 - pc) * mc, pi * mi)      # mass that can move from i to the carried one
            down = min(pc * mc, (1 - pi) * mi)
            move = up if draw[i] * (up + down) < down else -down
            part[carry], part[i] = _whole(np.array([pc + move / mc, pi - move / mi]))
        now = next((k for k in (carry, i) if k >= 0 and 0 < part[k] < 1), -1)
        carry = now if now < 0 or not _against_all(mass, part, now, i + 1, again[i]) else -1
    return part


def finish(mass: np.ndarray, wanted: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Round the last fractional value of a source, either way, and make up for what that
    adds or leaves out with the documents that fit, larger ones first; the nearer result."""
    left = np.flatnonzero((part > 0) & (part < 1))
    if not len(left):
        return part
    tries = []
    for end in (0.0, 1.0):
        now = part.copy()
        short = (part[left] - end) @ mass[left]          # words still to take (or, below 0, to give back)
        now[left] = end
        movable = (wanted > 0) & (wanted < 1) & (now == (0 if short > 0 else 1))
        movable[left] = False
        for i in np.flatnonzero(movable):                # heaviest first
            if mass[i] <= abs(short):
                now[i] = 1 - now[i]
                short -= np.sign(short) * mass[i]
        tries.append((abs(short), end, now))
    return min(tries, key=lambda t: t[:2])[2]


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mass", "id", "size"], ascending=[False, True, True], kind="stable",
                              na_position="last")
        key = [seed, level, int(pdf["rank"].iloc[0]), int(pdf["leaf"].iloc[0])]
        mass, wanted = pdf["mass"].to_numpy(float), pdf["part"].to_numpy(float)
        part = settle(mass, wanted, key)
        return pdf.assign(part=finish(mass, wanted, part) if pdf["leaves"].iloc[0] == 1 else part)

    return materialize(rows.groupBy("rank", "leaf").applyInPandas(leaf, rows.schema))


def copies(sized: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT,
           seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, copies): one row per unit of (id, source, size)."""
    targets = materialize(source_targets(sized, weights, max_repeat))
    units = sized.groupBy("id", "source", "size").agg(F.count("*").alias("m"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("_s"), "rank", "n_rows", "source_size", "target",
                       ratio.alias("ratio"),
                       F.ceil(F.col("n_rows") / F.lit(LEAF_ROWS)).cast("long").alias("leaves"))
    rows = (units.join(t, F.col("source").eqNullSafe(F.col("_s")))
            .select("id", "source", "size", "rank", "source_size", "target",
                    (F.col("m") * F.col("size")).cast("double").alias("mass"),
                    F.floor("ratio").cast("long").alias("whole"),
                    F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0).alias("part"),
                    F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.col("leaves")).alias("leaf"), "leaves"))
    most = t.agg(F.max("leaves")).first()[0] or 0
    done, level, cur = [], 0, _level(rows, 0, seed)
    fractional = (F.col("part") > 0) & (F.col("part") < 1)
    while most > 1:
        done.append(cur.where(~fractional))
        most, level = -(-most // FAN_IN), level + 1
        cur = _level(cur.where(fractional).withColumns({"leaf": F.floor(F.col("leaf") / FAN_IN),
                                                        "leaves": F.ceil(F.col("leaves") / FAN_IN)}), level, seed)
    done.append(cur)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("id", "source", "size", "source_size", "target",
                      F.when(F.col("size") > 0, F.col("whole") + F.col("part").cast("long"))
                      .otherwise(0).cast("long").alias("copies"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                       word_count(text_of(text_col)).alias("size"))


def _with_copies(rows: DataFrame, cop: DataFrame, keys: tuple, extra: tuple = ()) -> DataFrame:
    c = cop.select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_n"),
                   *extra, "copies")
    same = (F.col(keys[0]).eqNullSafe(F.col("_i")) & F.col(keys[1]).eqNullSafe(F.col("_s"))
            & (F.col(keys[2]) == F.col("_n")))
    return rows.join(c, same).drop("_i", "_s", "_n")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken."""
    sized = materialize(_sized(docs, id_col, text_col, source_col))
    out = _with_copies(sized, copies(sized, weights, max_repeat, seed), ("id", "source", "size"),
                       ("source_size", "target"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", weights: tuple = WEIGHTS,
                    max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns."""
    sized = materialize(_sized(docs, id_col, text_col, source_col))
    cop = copies(sized, weights, max_repeat, seed).where("copies > 0")
    whole = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                        F.col(f"`{source_col}`").alias("_source"),
                        word_count(text_of(text_col)).alias("_size"))
    return (_with_copies(whole, cop, ("_id", "_source", "_size"))
            .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_k"))
            .select("_row.*"))

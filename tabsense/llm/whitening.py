"""Whitening of embeddings: blockwise QR, then the singular values of its factor.

Scans of the vectors, each in numpy blocks inside tasks:

1. exact sums (whole numbers, so any order gives the same);
2. a running QR factor a task of the centred rows, merged in a tree of bounded groups;
   the driver gets one d x d factor, reduces it to bidiagonal form by Householder
   reflectors, finds all singular values by dqds and the wanted directions by twisted
   factorisations (``qd.py``);
3. the covariance of the whitened rows, to measure how far it is from the identity;
4. the whitened rows themselves, never shuffled.

What a task or the driver holds grows with the vectors' width only.

Defined results: a row whose vector is null or holds a null, NaN or infinite entry is
dropped; a shorter vector ends in zeros (the longest sets the width), an empty one is all
zeros; scaled entries beyond 2**53 are held there; a component whose eigenvalue is zero up
to rounding has null ``whitened`` and stays out of ``identity_error``; ``explained`` is null
if all vectors are equal; a null or repeated id is kept as it is; no vectors give no rows;
other columns, whatever their names, are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.llm.common import materialize
from tabsense.llm.qd import EPS, right_vectors
from tabsense.llm.vectors import blocks, finite_vectors, scaled_floor

#: The whole number of entry c is floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024.0, 100_000
LOW_BITS = 26                     # sums are kept in two parts, so that no long overflows
#: One merging group holds factors of so many entries together at most (two factors at least).
MERGE_ENTRIES = 1 << 23


def whole(rows: np.ndarray) -> np.ndarray:
    return scaled_floor(rows, SCALE) + OFFSET


class Fit:
    """Exact count and sums, and the directions; its size depends on the width only."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.width = n, sums, len(sums)
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part subtracted exactly."""
        return (x - self.base) - self.rest

    def solve(self, factor: np.ndarray, components: int) -> None:
        r = np.zeros((self.width, self.width))
        r[:len(factor)] = factor
        squares, directions = right_vectors(r, min(components, self.width))
        values = squares / self.n
        self.values = values[:directions.shape[1]]
        positive = self.values > self.width * EPS * values[0]
        self.known = positive if values[0] > 0 else np.zeros(len(self.values), bool)
        total = float(values.sum())
        self.explained = self.values / total if total > 0 else np.full(len(self.values), np.nan)
        self.turn = np.where(self.known, directions / np.sqrt(np.where(self.known, self.values, 1)), 0)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n*x - S)**2, exact; null past 38 digits."""
        kind = pa.decimal128(38, 0)
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if self.width * far * far < 1 << 63:
            away = self.n * x - np.array(self.sums, dtype=np.int64)
            return pa.array((away * away).sum(axis=1)).cast(kind)
        away = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return pa.array([Decimal(v) if v < 10 ** 38 else None for v in (away * away).sum(axis=1)], kind)


def exact_sums(vectors: DataFrame) -> Fit | None:
    """Count and per-dimension sums of the whole numbers of ``vec``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            wide = int(np.diff(batch.column("vec").offsets.to_numpy()).max(initial=0))
            if wide > len(held):
                held, high, low = (np.pad(a, (0, wide - len(a))) for a in (held, high, low))
            for part, c in blocks([batch], wide):
                x = whole(c)
                sizes = np.diff(part.column("vec").offsets.to_numpy())
                inside = np.arange(wide) < sizes[:, None]
                rows += len(x)
                held[:wide] += inside.sum(axis=0)
                high[:wide] += ((x >> LOW_BITS) * inside).sum(axis=0)
                low[:wide] += ((x & (1 << LOW_BITS) - 1) * inside).sum(axis=0)
        if rows:
            at = np.arange(-1, len(held))     # row -1 counts the vectors
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.concatenate([[rows], held])),
                 pa.array(np.concatenate([[0], high])), pa.array(np.concatenate([[0], low]))],
                names=["pos", "held", "high", "low"])

    got = (vectors.mapInArrow(run, "pos long, held long, high long, low long").groupBy("pos")
           .agg(F.sum("held").alias("held"), F.sum("high").alias("high"), F.sum("low").alias("low"))
           .orderBy("pos").collect())
    if not got:
        return None
    n = got[0].held
    return Fit(n, [(r.high << LOW_BITS) + r.low + (n - r.held) * OFFSET for r in got[1:]])


def qr_factor(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """The triangular factor of all centred rows: a factor a task, merged in a tree."""
    width = fit.width

    def fold(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([factor, rows]), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, width))
        for _, c in blocks(batches, width):
            factor = fold(factor, fit.centred(whole(c)))
        if len(factor):
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(factor), pa.int64()), pa.array(range(len(factor)), pa.int64()),
                 pa.array(list(factor), pa.list_(pa.float64()))], names=["part", "at", "row"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        factor = np.zeros((0, width))
        for _, one in rows.sort_values(["part", "at"]).groupby("part", sort=True):
            factor = fold(factor, np.vstack(list(one["row"])))
        return pd.DataFrame({"part": key[0], "at": range(len(factor)), "row": list(factor)})

    layout = "part long, at long, row array<double>"
    fan = max(2, min(64, MERGE_ENTRIES // (width * width)))
    level = materialize(vectors.mapInArrow(run, layout))
    last = level.agg(F.max("part")).first()[0]
    while last > 0:
        level = materialize(level.groupBy(F.floor(F.col("part") / fan).alias("g")).applyInPandas(merge, layout))
        last //= fan
    return np.array([r.row for r in level.orderBy("part", "at").collect()]).reshape(-1, width)


def identity_error(vectors: DataFrame, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    turn = fit.turn[:, fit.known]
    k = turn.shape[1]
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, c in blocks(batches, fit.width):
            w = fit.centred(whole(c)) @ turn
            sums += w.sum(axis=0)
            products += w.T @ w
        both = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["pos", "v"])

    got = vectors.mapInArrow(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()
    both = np.array([r.v for r in got]) / fit.n      # rows are centred already; their mean is rounding only
    return float(np.abs(both[k:].reshape(k, k) - np.outer(both[:k], both[:k]) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a kept vector and component: (id, component, n, deviation decimal(38,0),
    whitened, explained, identity_error)."""
    id_type = df.schema[id_col].dataType
    vectors = finite_vectors(df, vec_col, id=F.col(f"`{id_col}`"))
    layout = T.StructType([
        T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    only = vectors.select("vec")
    fit = exact_sums(only)
    if fit is None or fit.width == 0:
        return df.sparkSession.createDataFrame([], layout)
    fit.solve(qr_factor(only, fit), components)
    error = identity_error(only, fit)
    k = len(fit.values)
    shown = [x if np.isfinite(x) else None for x in fit.explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c in blocks(batches, fit.width):
            x, rows = whole(c), part.num_rows
            w = fit.centred(x) @ fit.turn
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fit.n)), fit.deviation(x).take(each),
                pa.array(w.ravel(), mask=np.tile(~fit.known, rows)), pa.array(shown * rows, pa.float64()),
                pa.array([error] * (rows * k), pa.float64())], names=layout.names)

    return vectors.mapInArrow(run, layout)

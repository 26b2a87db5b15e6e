"""Vector codes: every part of a vector becomes the index of its nearest codebook entry.

Distances are compared in the Walsh-Hadamard domain: parts and entries, zero-padded to a
power of two m, are transformed in whole numbers, which multiplies every squared distance
by m exactly.  Squared differences are added coefficient by coefficient in sequency order
(few sign changes first, where most of the energy lies); an entry goes as soon as its sum
passes the full distance of the entry that is best on the first coefficient.  All in whole
numbers, so ties are exact and go to the lower index.

A round is one scan: tasks assign their parts and keep sums and counts an entry; these
(at most parts x entries rows a task) are added up by Spark, and the driver gets one row
an entry.  Vectors are never shuffled; the codes are written once, then grouped by label
with partial sums and joined back (a hot label is split by AQE).

Defined results: a row whose vector is null or holds a null, NaN or infinite component is
dropped; the longest vector sets the width, shorter ones end in zeros, and so does the
last part where the width does not divide; scaled components beyond 2**53 are held there;
fewer kept rows than entries give that many entries; first entries go by id (null last),
then by content; null and repeated ids are kept; null labels are one label; no vectors
give no rows; other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.llm.common import materialize
from tabsense.llm.vectors import blocks, finite_vectors, scaled_floor

SCALE = 256.0
LOW_BITS = 26
SAFE = 1 << 62


def sequency_transform(m: int) -> np.ndarray:
    """The m x m Walsh-Hadamard matrix (m a power of two), rows by their sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


class Codebooks:
    """Whole-number entries (part, entry, position); assigns rows to nearest entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.size, self.length = entries.shape
        self.m = 1 << max(0, self.length - 1).bit_length()
        self.h = sequency_transform(self.m)
        self.turned = self._transform(entries)

    def _transform(self, x: np.ndarray) -> np.ndarray:
        """Transformed coefficients of the last axis, as Python integers where longs might overflow."""
        top = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
        padded = np.zeros(x.shape[:-1] + (self.m,), np.int64 if top * self.m < SAFE else object)
        padded[..., :self.length] = x
        return padded @ self.h.T.astype(padded.dtype)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(row, part, position) of whole-number vectors; missing positions are zero."""
        out = np.zeros((len(x), self.parts * self.length), np.int64)
        out[:, :x.shape[1]] = x
        return out.reshape(len(x), self.parts, self.length)

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of codebook ``part``."""
        t, c = self._transform(x), self.turned[part]
        far = max((abs(int(v)) for v in (t.min(initial=0), t.max(initial=0), c.min(), c.max())), default=0)
        if self.m * (2 * far) ** 2 >= SAFE:          # whole numbers of any length, only slower
            t, c = t.astype(object), c.astype(object)
        first = t[:, :1] - c[:, 0]
        first = first * first
        best = first.argmin(axis=1)
        bound = ((t - c[best]) ** 2).sum(axis=1)     # full distance of one entry: none beyond it can win
        row, entry = np.nonzero(first <= bound[:, None])
        so_far = first[row, entry]
        for j in range(1, self.m):
            away = t[row, j] - c[entry, j]
            so_far = so_far + away * away
            alive = so_far <= bound[row]
            row, entry, so_far = row[alive], entry[alive], so_far[alive]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        least = np.minimum.reduceat(so_far, starts) if len(row) else so_far
        wins = np.flatnonzero(so_far == least[np.cumsum(np.r_[0, row[1:] != row[:-1]])]) if len(row) else starts
        keep = wins[np.r_[True, row[wins][1:] != row[wins][:-1]]] if len(wins) else wins
        return entry[keep], so_far[keep] // self.m   # rows in order, lowest index of equals first

    def text(self) -> str:
        return ",".join(str(int(v)) for v in self.entries.ravel())


def first_entries(vectors: DataFrame, width: int, parts: int, size: int) -> np.ndarray:
    length = -(-width // parts)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(size).select("vec").collect()
    out = np.zeros((len(first), parts * length), np.int64)
    for row, r in zip(out, first):
        row[:len(r.vec)] = scaled_floor(np.array(r.vec, dtype=float), SCALE)
    return out.reshape(len(first), parts, length).swapaxes(0, 1).copy()


def updated(vectors: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round: every used entry becomes the floored mean of its parts."""
    p, k, w = books.parts, books.size, books.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((p, k), np.int64)
        high, low = np.zeros((p, k, w), np.int64), np.zeros((p, k, w), np.int64)
        for _, c in blocks(batches, width):
            x = books.split(scaled_floor(c, SCALE))
            for part in range(p):
                at, _ = books.nearest(part, x[:, part])
                count[part] += np.bincount(at, minlength=k)
                np.add.at(high[part], at, x[:, part] >> LOW_BITS)
                np.add.at(low[part], at, x[:, part] & (1 << LOW_BITS) - 1)
        part, entry = np.nonzero(count)
        for pos in range(w):
            yield pa.RecordBatch.from_arrays(
                [pa.array((part * k + entry) * w + pos), pa.array(count[part, entry]),
                 pa.array(high[part, entry, pos]), pa.array(low[part, entry, pos])], names=["at", "n", "high", "low"])

    sums = (vectors.mapInArrow(run, "at long, n long, high long, low long").groupBy("at")
            .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    new = books.entries.copy().reshape(-1)
    for r in sums:
        new[r["at"]] = ((r.high << LOW_BITS) + r.low) // r.n
    return Codebooks(new.reshape(books.entries.shape))


def train(vectors: DataFrame, parts: int, size: int, rounds: int) -> tuple[Codebooks | None, int]:
    width = vectors.agg(F.max(F.size("vec"))).first()[0]
    if width is None:
        return None, 0
    books = Codebooks(first_entries(vectors, width, parts, size)) if width else None
    for _ in range(rounds if books else 0):
        books = updated(vectors.select("vec"), books, width)
    return books, width


def encode(df: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, id_col: str = "vec_id",
           vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector; the errors
    are decimal(38,0), ``label_error`` null past 38 digits."""
    if not 1 <= size <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    vectors = finite_vectors(df, vec_col, id=F.col(f"`{id_col}`"), label=F.col(f"`{label_col}`"))
    layout = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("label", df.schema[label_col].dataType),
                           T.StructField("code", T.StringType()), T.StructField("error", T.DecimalType(38, 0))])
    books, width = train(vectors, parts, size, rounds)
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c in blocks(batches, width):
            x = books.split(scaled_floor(c, SCALE))
            error, codes = 0, np.zeros((len(x), books.parts), np.uint8)
            for p in range(books.parts):
                codes[:, p], away = books.nearest(p, x[:, p])
                error = error + away.astype(object)
            text = codes.tobytes().hex()
            each = 2 * books.parts
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"),
                 pa.array([text[i:i + each] for i in range(0, len(text), each)], pa.string()),
                 pa.array([Decimal(int(v)) for v in error], kind)], names=["id", "label", "code", "error"])

    if books is None and not width:
        coded = vectors.select("id", "label", F.repeat(F.lit("00"), F.lit(parts)).alias("code"),
                               F.lit(0).cast(T.DecimalType(38, 0)).alias("error"))
    else:
        coded = vectors.mapInArrow(run, layout)
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    coded = materialize(coded)
    labels = (coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"))
              .withColumnRenamed("label", "of"))
    return (coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))

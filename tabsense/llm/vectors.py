"""Vectors of a table as numpy blocks inside tasks (shared by whitening and vector codes)."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries are held within +-2**53, where doubles stop being whole numbers.
HELD = 2.0 ** 53
#: A block of rows has so many entries at most.
BLOCK_ENTRIES = 1 << 20


def is_finite_vector(vec: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite entry (an empty one holds none)."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def finite_vectors(df: DataFrame, vec_col: str, **keep: Column) -> DataFrame:
    """Columns ``keep`` and ``vec`` (array<double>) of the rows with a finite vector."""
    rows = df.select(*[c.alias(name) for name, c in keep.items()], F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    return rows.where(is_finite_vector(F.col("vec")))


def scaled_floor(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as int64, held within +-2**53."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(values * scale, -HELD, HELD)).astype(np.int64)


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """One row a vector; a shorter vector ends in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(batches, width: int):
    """(batch, rows) in blocks of bounded size: ``width`` entries a row."""
    step = max(1, BLOCK_ENTRIES // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, matrix(part.column("vec"), width)

"""Cross-validation of linear and ridge regression from leave-one-fold-out statistics.

Imputing by median or mode, standard scaling and one-hot encoding are linear in a raw row
u = (1, values, missing flags, category flags, missing-category flags).  So one pass that
sums u u', u y and y*y per fold holds all that refitting every fold would find: a fold's
training statistics are the totals minus its own, its preprocessor follows from counts,
means and the fold's medians, its coefficients from the normal equations (MLlib's own
objective), and its error is a quadratic form of its own sums.  Tasks keep one matrix a
fold; Spark adds them up row by row; the driver solves matrices of the features' size.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions import kinds as K
from tabsense.operators import prep as P

#: As wide as MLlib's normal-equation solver takes them.
MAX_FEATURES = 4096


def category_lists(df: DataFrame, cols: Sequence[str], most: int) -> list[list[str]] | None:
    """Sorted values of each column; None if there are more than ``most`` in all."""
    if not cols:
        return []
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), K.col(c).cast("string").alias("value"))
                                for i, c in enumerate(cols)])).alias("r")
    rows = df.select(pairs).select("r.*").where("value IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        return None
    return [sorted(r.value for r in rows if r.ord == i) for i in range(len(cols))]


def fold_sums(folds: DataFrame, num: Sequence[str], cat: Sequence[str], lists: list[list[str]],
              centre: np.ndarray, spread: np.ndarray, label_centre: float, fold_col: str = "fold") -> dict[int, np.ndarray]:
    """{fold: sums of z z'} with z = (u, y - label_centre), values standardised by centre and spread."""
    p, sizes = len(num), [len(x) for x in lists]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int) + 1 + 2 * p
    width = 1 + 2 * p + sum(sizes) + len(cat) + 1

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.zeros((len(pdf), width))
            z[:, 0], z[:, -1] = 1, pdf["y"].to_numpy(float) - label_centre
            x = pdf[[f"n{j}" for j in range(p)]].to_numpy(float).reshape(len(pdf), p)
            gone = np.isnan(x)
            z[:, 1:1 + p], z[:, 1 + p:1 + 2 * p] = np.where(gone, 0, (x - centre) / spread), gone
            for j in range(len(cat)):
                code = pdf[f"c{j}"].to_numpy(float)
                has = np.flatnonzero(~np.isnan(code))
                z[has, first[j] + code[has].astype(int)] = 1
                z[np.isnan(code), first[-1] + j] = 1
            fold = pdf["fold"].to_numpy()
            for f in np.unique(fold):
                part = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ part
        for f, s in sums.items():
            yield pd.DataFrame({"fold": f, "at": np.arange(width), "row": list(s)})

    codes = [(F.array_position(F.array(*[F.lit(v) for v in names]), K.col(c).cast("string")) - 1) if names
             else F.lit(None) for c, names in zip(cat, lists)]
    rows = folds.select(F.col(fold_col).cast("int").alias("fold"), F.col("label").cast("double").alias("y"),
                        *[K.as_double(folds, c).alias(f"n{j}") for j, c in enumerate(num)],
                        *[c.cast("double").alias(f"c{j}") for j, c in enumerate(codes)])
    got = (rows.mapInPandas(run, "fold int, at int, row array<double>").select("fold", "at", array_to_vector("row").alias("row"))
           .groupBy("fold", "at").agg(vector_to_array(Summarizer.sum(F.col("row"))).alias("row")).collect())
    out = {f: np.zeros((width, width)) for f in {r.fold for r in got}}
    for r in got:
        out[r.fold][r["at"]] = r.row
    return out


def _features(train: np.ndarray, p: int, sizes: list[int], medians: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """u -> features as a matrix, by the training rows' counts and means."""
    n, start, sparse = train[0, 0], 1 + 2 * p, 1 + 2 * p + sum(sizes)
    turn = np.zeros((len(train) - 1, p + sum(sizes)))
    for j in range(p):
        value = np.zeros(len(train) - 1)
        value[1 + j], value[1 + p + j] = 1, medians[j]
        mean = value @ train[:-1, 0] / n
        value[0] = -mean
        std = np.sqrt(max(value @ train[:-1, :-1] @ value / n, 0.0))
        raw = std * spread[j]
        turn[:, j] = value * spread[j] / (raw if raw > 1e-9 * spread[j] else 1.0)
    at = p
    for j, size in enumerate(sizes):
        counts = train[0, start:start + size]
        known = np.flatnonzero(counts > 0)
        turn[start + known, at + known] = 1
        if len(known):
            turn[sparse + j, at + int(counts.argmax())] = 1      # the most frequent, first of equals
        start, at = start + size, at + size
    return turn


def _solve(cov: np.ndarray, target: np.ndarray, penalty: float) -> np.ndarray:
    if penalty > 0:
        return np.linalg.solve(cov + penalty * np.eye(len(cov)), target)
    return np.linalg.lstsq(cov, target, rcond=1e-12)[0]


def linear_cv_scores(data: DataFrame, keys: Sequence[str], k: int, num: Sequence[str], cat: Sequence[str],
                     reg: float, seed: int) -> list[float] | None:
    """r2 of every hash fold for (ridge) regression refitted without it, standard scaling;
    None if the one-hot vector is too wide for normal equations."""
    folds = P.with_folds(data, keys, k, seed)
    lists = category_lists(data, cat, MAX_FEATURES - len(num))
    if lists is None:
        return None
    stats = data.agg(F.avg("label"), *[a(K.as_double(data, c)) for c in num for a in (F.avg, F.stddev_pop)],
                     F.count(F.lit(1)), *[F.count(K.as_double(data, c)) for c in num]).first()
    centre = np.array([stats[1 + 2 * j] or 0.0 for j in range(len(num))], float)
    spread = np.array([stats[2 + 2 * j] or 1.0 for j in range(len(num))], float)
    sums = fold_sums(folds, num, cat, lists, centre, spread, stats[0] or 0.0)
    counts = stats[1 + 2 * len(num):]
    gaps = [c for c, n in zip(num, counts[1:]) if n < counts[0]]      # medians fill nothing elsewhere
    medians = P.fold_medians(folds, gaps, k)
    total, scores = sum(sums.values()), []
    for f, own in sorted(sums.items()):
        train = total - own
        n = train[0, 0]
        if n < 1:
            continue
        fill = np.array([medians[f][c] if medians[f].get(c) is not None else 0.0 for c in num], float)
        turn = _features(train, len(num), [len(x) for x in lists], (fill - centre) / spread, spread)
        mean, y_mean = turn.T @ train[:-1, 0] / n, train[0, -1] / n
        cov = turn.T @ train[:-1, :-1] @ turn / n - np.outer(mean, mean)
        with_y = turn.T @ train[:-1, -1] / n - mean * y_mean
        y_std = np.sqrt(max(train[-1, -1] / n - y_mean ** 2, 0.0))
        w = _solve(cov, with_y, reg / y_std if reg and y_std else 0.0)
        line = turn @ w
        line[0] += y_mean - mean @ w
        error = line @ own[:-1, :-1] @ line - 2 * line @ own[:-1, -1] + own[-1, -1]
        spread_y = own[-1, -1] - own[0, -1] ** 2 / own[0, 0]
        if spread_y > 0:
            scores.append(float(1 - error / spread_y))
    return scores

"""Exact nearest neighbours and radius neighbours without a cross join.

A pivot (Voronoi-cell) index: a bounded hash sample of the reference points are
pivots; every reference point is assigned to its nearest pivot's cell, keeping
its distance to the pivot; each cell keeps its size and radius (one row per
cell, read as a scalar subquery).  By the triangle inequality a point ``x`` in
cell ``c`` satisfies ``d(q, x) >= d(q, p_c) - r_c``, so a query only has to be
equi-joined to the cells whose lower bound is within its search radius.

* radius search: the radius is given (DBSCAN's eps);
* k nearest: the radius is an upper bound on the k-th distance taken from the
  cells alone: the k-th smallest ``d(q, p_c) + d(x, p_c)`` over each cell's k
  points nearest to its pivot.

For k nearest, cells are put together to blocks and compared by matrix products (see
``knn``).  For a radius, points also carry a ring id (their pivot distance in bands of r_c / 32).  A
query is sent once to each cell its radius can reach, with the ring interval of
the annulus ``|d(q, p_c) - d(x, p_c)| <= radius``; inside a cogrouped numpy block
the cell's points are sorted by ring and each query computes exact distances only
over its interval.

Both are exact.  The top-k per query is a ``row_number() <= k`` filter, which
Spark turns into a partial group limit before the shuffle.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.session import cut_lineage

SLACK = 1e-9


def sq_dist(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance of two array<double> columns.  ``dim`` unrolls the
    sum for short vectors only: a long unrolled sum makes a generated method too
    large for the JIT and is slower than the higher-order ``aggregate``."""
    if dim:
        terms = [(a[i] - b[i]) * (a[i] - b[i]) for i in range(dim)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0),
                       lambda acc, x: acc + x)


def dist(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(sq_dist(a, b, dim))


def vector_dim(df: DataFrame, col: str = "vec") -> int | None:
    """Length of the vectors (one row read); unrolling is skipped above 256."""
    r = df.select(F.size(col).alias("d")).where("d > 0").limit(1).collect()
    d = int(r[0]["d"]) if r else None
    return d if d and d <= 256 else None


def vectorize(df: DataFrame, features: list[str] | str) -> Column:
    """array<double> from a list of numeric columns or from an array column."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


RINGS = 32


def _pivot_distances(pivots, vec_col: str = "vec"):
    """Arrow-batch numpy distances of every vector to every pivot, in row chunks
    of bounded size (rows x pivots x dim <= 4M doubles)."""
    import numpy as np

    piv = np.asarray(pivots, dtype="float64")
    if piv.ndim != 2 or piv.shape[0] == 0:
        return lambda vecs: np.zeros((len(vecs), 0))
    step = max(1, (1 << 22) // max(1, piv.shape[0] * piv.shape[1]))

    def dists(vecs) -> "np.ndarray":
        v = np.stack(vecs).astype("float64") if len(vecs) else np.zeros((0, piv.shape[1]))
        out = np.empty((v.shape[0], piv.shape[0]))
        for s0 in range(0, v.shape[0], step):
            diff = v[s0:s0 + step, None, :] - piv[None, :, :]
            out[s0:s0 + step] = np.sqrt(np.einsum("rpd,rpd->rp", diff, diff))
        return out
    return dists


def build_index(ref: DataFrame, n_pivots: int | None = None, seed: int = 7,
                keep_k: int = 0) -> tuple[DataFrame, list, Column]:
    """ref: (rid, vec).  Returns (assigned ref (rid, vec, cell, dcell, ring),
    pivots (a list of at most 512 vectors), cells scalar column
    array<struct<cell, n, r, w, kd>>).

    ``ring`` = floor(dcell / w) with w = r / RINGS: a query at distance dq from the
    pivot only meets points whose ring lies in [(dq - U) / w, (dq + U) / w].
    ``kd`` holds the ``keep_k`` smallest pivot distances of the cell (for k-NN
    bounds); it is filled by a ``row_number() <= k`` filter, never a full sort.
    Pivot distances are numpy blocks inside ``mapInPandas`` tasks; the pivots
    themselves are a bounded hash sample brought to the driver once.
    """
    base, pivots, stats = _assigned_cells(ref, n_pivots, seed, keep_k)
    # one row per cell (at most p rows): a bounded broadcast
    assigned = base.join(F.broadcast(stats.select("cell", "w")), on="cell").select(
        "rid", "vec", "cell", "dcell", F.floor(F.col("dcell") / F.col("w")).cast("bigint").alias("ring"))
    cells = stats.agg(F.array_sort(F.collect_list(F.struct("cell", "n", "r", "w", "kd"))).alias("cs"))
    return assigned, pivots, cells.scalar()


def _assigned_cells(ref: DataFrame, n_pivots: int | None, seed: int,
                    keep_k: int) -> tuple[DataFrame, list, DataFrame]:
    """(rid, vec, cell, dcell), the pivots, and (cell, n, r, w, kd) a cell (see ``build_index``)."""
    import numpy as np
    import pandas as pd

    ref = ref.where(F.col("vec").isNotNull())
    n = ref.count()
    p = n_pivots or int(min(512, max(4, round(math.sqrt(max(n, 1)) / 2))))
    # Deterministic hash sample of about 4p candidates, then the p smallest hashes.
    h = F.xxhash64(F.col("rid"), F.lit(seed))
    frac = max(1, n // max(1, 4 * p))
    cand = ref.where(F.pmod(h, F.lit(frac)) == 0).select("vec", h.alias("_h"))
    pivots = [list(r["vec"]) for r in cand.orderBy("_h", "vec").limit(p).collect()]
    dists = _pivot_distances(pivots)

    def assign(it):
        for pdf in it:
            d = dists(pdf["vec"].to_numpy())
            if d.shape[1] == 0:          # no pivots: one cell
                cell, dcell = np.zeros(d.shape[0], "int32"), np.zeros(d.shape[0])
            else:
                cell = d.argmin(axis=1).astype("int32")
                dcell = d[np.arange(d.shape[0]), cell]
            yield pd.DataFrame({"rid": pdf["rid"], "vec": pdf["vec"], "cell": cell, "dcell": dcell})

    base = cut_lineage(ref.select("rid", F.col("vec").cast("array<double>").alias("vec"))
                       .mapInPandas(assign, "rid long, vec array<double>, cell int, dcell double"))
    stats = base.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dcell").alias("r"))
    stats = stats.withColumn("w", F.when(F.col("r") > 0, F.col("r") / RINGS).otherwise(F.lit(1.0)))
    if keep_k > 0:
        wk = Window.partitionBy("cell").orderBy("dcell", "rid")
        near = (base.select("cell", "dcell", "rid").withColumn("_k", F.row_number().over(wk))
                .where(F.col("_k") <= keep_k).groupBy("cell")
                .agg(F.array_sort(F.collect_list("dcell")).alias("kd")))
        stats = stats.join(near, on="cell", how="left")
    else:
        stats = stats.withColumn("kd", F.array().cast("array<double>"))
    return base, pivots, cut_lineage(stats)


def _query_pivot_dists(queries: DataFrame, pivots: list) -> DataFrame:
    """(qid, qvec, dq): the distance of every query to every pivot."""
    import pandas as pd

    dists = _pivot_distances(pivots)

    def run(it):
        for pdf in it:
            d = dists(pdf["vec"].to_numpy())
            yield pd.DataFrame({"qid": pdf["qid"], "qvec": pdf["vec"], "dq": list(d)})

    return (queries.where(F.col("vec").isNotNull())
            .select("qid", F.col("vec").cast("array<double>").alias("vec"))
            .mapInPandas(run, "qid long, qvec array<double>, dq array<double>"))


BLOCK = 2048
PAIR_SCHEMA = "qid long, rid long, d double"


def _block_topk(k: int | None):
    """Per cogrouped (cell, sub-block) pair: each query's k best reference points
    (distance, then rid) within its search radius (every one when ``k`` is None).  Reference points are sorted by
    ring, so every query binary-searches its annulus ``[rlo, rhi]`` and computes
    exact distances (numpy differences, not |q|^2 + |r|^2 - 2 q.r) only there."""
    import numpy as np
    import pandas as pd

    def run(_key, qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"),
                              "d": pd.Series([], dtype="float64")})
        if qpdf.empty or rpdf.empty:
            return empty
        ring = rpdf["ring"].to_numpy()
        order = np.argsort(ring, kind="stable")
        ring = ring[order]
        rv = np.stack(rpdf["vec"].to_numpy()).astype("float64")[order]
        rid = rpdf["rid"].to_numpy()[order]
        qv = np.stack(qpdf["qvec"].to_numpy()).astype("float64")
        lim = qpdf["_lim"].to_numpy()
        starts = np.searchsorted(ring, qpdf["rlo"].to_numpy(), "left")
        ends = np.searchsorted(ring, qpdf["rhi"].to_numpy(), "right")
        qids = qpdf["qid"].to_numpy()
        rows_q, rows_r, rows_d = [], [], []
        for i in range(qv.shape[0]):
            a, b = starts[i], ends[i]
            if a >= b:
                continue
            diff = rv[a:b] - qv[i]
            d = np.sqrt(np.einsum("rd,rd->r", diff, diff))
            keep = d <= lim[i]
            if not keep.any():
                continue
            d, ids = d[keep], rid[a:b][keep]
            if k is not None and len(d) > k:
                # ties at the k-th distance: keep every candidate with that distance
                kth = np.partition(d, k - 1)[k - 1]
                sel = d <= kth
                d, ids = d[sel], ids[sel]
            rows_q.append(np.full(len(d), qids[i]))
            rows_r.append(ids)
            rows_d.append(d)
        if not rows_q:
            return empty
        return pd.DataFrame({"qid": np.concatenate(rows_q).astype("int64"),
                             "rid": np.concatenate(rows_r).astype("int64"),
                             "d": np.concatenate(rows_d)})
    return run


def _cell_sides(q: DataFrame, assigned: DataFrame, lim: Column,
                block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Send each query (qid, qvec, dq, _cs) once to every cell its radius ``lim``
    can reach, with that cell's ring interval; returns the query side, the
    reference side (every column of ``assigned``) and the cogroup keys.  A cell
    with more than ``block`` points on either side is split into hash sub-blocks."""
    cand = F.filter("_cs", lambda c: F.col("dq")[c["cell"]] - c["r"] <= lim)
    hit = F.transform(cand, lambda c: F.struct(
        c["cell"].alias("cell"),
        F.greatest(F.lit(0).cast("bigint"),
                   F.floor((F.col("dq")[c["cell"]] - lim) / c["w"]).cast("bigint")).alias("rlo"),
        F.least(F.floor(c["r"] / c["w"]).cast("bigint"),
                F.floor((F.col("dq")[c["cell"]] + lim) / c["w"]).cast("bigint")).alias("rhi")))
    probes = (q.select("qid", "qvec", lim.alias("_lim"), F.explode(hit).alias("_s"))
              .select("qid", "qvec", "_lim", "_s.cell", "_s.rlo", "_s.rhi")
              .where(F.col("rlo") <= F.col("rhi")))
    probes = cut_lineage(probes)
    # sub-block counts per cell (one row per cell: at most 512 rows)
    rsz = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("nr"))
    qsz = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    sub = (rsz.join(qsz, on="cell")
           .select("cell", F.ceil(F.col("nr") / block).cast("int").alias("rs"),
                   F.ceil(F.col("nq") / block).cast("int").alias("qs")))
    sub = F.broadcast(sub)
    r_side = (assigned.join(sub, on="cell")
              .withColumn("_rb", F.pmod(F.xxhash64("rid"), F.col("rs")).cast("int"))
              .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
              .drop("rs", "qs"))
    q_side = (probes.join(sub, on="cell")
              .withColumn("_qb", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int"))
              .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
              .select("cell", "_rb", "_qb", "qid", "qvec", "_lim", "rlo", "rhi"))
    return q_side, r_side, ["cell", "_rb", "_qb"]


def _cell_blocks(q: DataFrame, assigned: DataFrame, lim: Column, k: int | None,
                 block: int = BLOCK) -> DataFrame:
    """(qid, rid, d): each query's k best (or all) points within ``lim``, from the
    cogrouped cell blocks of ``_cell_sides``."""
    q_side, r_side, keys = _cell_sides(q, assigned, lim, block)
    r_side = r_side.select(*keys, "rid", "vec", "ring")
    return q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInPandas(
        _block_topk(k), PAIR_SCHEMA)


def _block_reduce(radius: float, mode: str):
    """Per cogrouped block, one row per query with at least one reference point
    within ``radius``: the sum (``sum``) or the smallest (``minlab``) of their
    ``lab``.  No pair leaves the task."""
    import numpy as np
    import pandas as pd

    def run(_key, qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or rpdf.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64")})
        ring = rpdf["ring"].to_numpy()
        order = np.argsort(ring, kind="stable")
        ring = ring[order]
        rv = np.stack(rpdf["vec"].to_numpy()).astype("float64")[order]
        lab = rpdf["lab"].to_numpy()[order]
        qv = np.stack(qpdf["qvec"].to_numpy()).astype("float64")
        starts = np.searchsorted(ring, qpdf["rlo"].to_numpy(), "left")
        ends = np.searchsorted(ring, qpdf["rhi"].to_numpy(), "right")
        qids = qpdf["qid"].to_numpy()
        out_q, out_v = [], []
        for i in range(qv.shape[0]):
            a, b = starts[i], ends[i]
            if a >= b:
                continue
            diff = rv[a:b] - qv[i]
            keep = np.sqrt(np.einsum("rd,rd->r", diff, diff)) <= radius
            if not keep.any():
                continue
            out_q.append(qids[i])
            near = lab[a:b][keep]
            out_v.append(int(near.sum() if mode == "sum" else near.min()))
        return pd.DataFrame({"qid": np.asarray(out_q, dtype="int64"), "v": np.asarray(out_v, dtype="int64")})
    return run


def block_reduce(q_side: DataFrame, r_side: DataFrame, keys: list[str], radius: float,
                 mode: str) -> DataFrame:
    """(qid, v) summed (sum) or minimised (minlab) over the query's blocks."""
    cols = ["rid", "vec", "ring", "lab"]
    part = q_side.groupBy(*keys).cogroup(r_side.select(*keys, *cols).groupBy(*keys)).applyInPandas(
        _block_reduce(float(radius), mode), "qid long, v long")
    agg = F.sum("v") if mode == "sum" else F.min("v")
    return part.groupBy("qid").agg(agg.alias("v"))


def range_pairs(queries: DataFrame, index: tuple, radius: float, block: int = BLOCK) -> DataFrame:
    """All (qid, rid, d) with d <= radius.  queries: (qid, vec).  Exact distances in
    the cogrouped cell blocks; only pairs within the radius leave a task."""
    assigned, pv, cs = index
    q = _query_pivot_dists(queries, pv).withColumn("_cs", cs)
    lim = F.lit(float(radius) * (1 + SLACK) + SLACK)
    pairs = _cell_blocks(q, assigned, lim, None, block)
    return pairs.where(F.col("d") <= F.lit(float(radius)))


#: Sides of a k-NN task: a sixteenth of the points, at most so many rows and bytes.
KNN_SIDES, KNN_ROWS, KNN_BYTES = 16, 1 << 16, 32 << 20
#: Queries and points multiplied at once.
TILE_QUERIES, TILE_POINTS = 512, 2048


def _matrices():
    """A function for tasks (which need not import this module): Arrow lists of doubles as
    a matrix; a missing entry is NaN."""
    import numpy as np

    def matrix(vecs):
        vecs = vecs.combine_chunks() if hasattr(vecs, "combine_chunks") else vecs
        if not len(vecs):
            return np.zeros((0, 0))
        sizes = vecs.value_lengths().to_numpy()
        if (sizes != sizes[0]).any():
            raise ValueError("vectors of different lengths")
        return vecs.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(vecs), -1)
    return matrix


def _blocks(cells: list, pivots: list, block: int):
    """(first block of every cell, its number of blocks): neighbouring cells share a block
    of about ``block`` points, a cell with more has several of its own."""
    import numpy as np

    piv = np.asarray(pivots, dtype="float64")
    left, chain = {c["cell"]: c["n"] for c in cells}, []
    at = min(left)
    while left:                                             # a walk to the nearest cell not yet seen
        ids = np.array(sorted(left))
        at = int(ids[np.argmin(((piv[ids] - piv[at]) ** 2).sum(axis=1))])
        chain.append((at, left.pop(at)))
    first, parts = np.zeros(len(piv), "int32"), np.ones(len(piv), "int32")
    no, held = 0, 0
    for cell, n in chain:
        if held and held + n > block:
            no, held = no + 1, 0
        first[cell], parts[cell] = no, max(1, -(-n // block))
        no, held = (no + int(parts[cell]), 0) if parts[cell] > 1 else (no, held + n)
    return first, parts


def _reached_blocks(queries: DataFrame, pivots: list, cells: list, first, parts, need: int) -> DataFrame:
    """(qid, qvec, lim, blocks): every query with its search radius and the blocks it reaches."""
    import numpy as np
    import pyarrow as pa

    dists, matrix = _pivot_distances(pivots), _matrices()
    ids = np.array([c["cell"] for c in cells])
    radii = np.array([c["r"] for c in cells], dtype="float64")
    owner = np.array([i for i, c in enumerate(cells) for _ in c["kd"] or []], dtype="int64")
    offset = np.array([v for c in cells for v in c["kd"] or []], dtype="float64")
    n_blocks = int((first + parts).max())
    member = np.zeros((len(ids), n_blocks), "float32")
    for i, c in enumerate(ids):
        member[i, first[c]:first[c] + parts[c]] = 1

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                dq = dists(matrix(part.column(1)))[:, ids]
                if len(offset) >= need:
                    bounds = dq[:, owner] + offset
                    lim = np.partition(bounds, need - 1, axis=1)[:, need - 1] * (1 + SLACK) + SLACK
                else:
                    lim = np.full(len(dq), np.inf)
                near = (~(dq - radii > lim[:, None])).astype("float32") @ member > 0
                row, block = np.nonzero(near)
                blocks = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(len(dq) + 1)).astype("int32")), pa.array(block.astype("int32")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lim), blocks],
                                                 ["qid", "qvec", "lim", "blocks"])

    return (queries.where(F.col("vec").isNotNull())
            .select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec"))
            .mapInArrow(run, "qid long, qvec array<double>, lim double, blocks array<int>"))


def _block_nearest(pivots: list, cells: list, k: int, exclude_self: bool):
    """Per pair of a query block and a point block: each query's k best points (distance,
    then id) within its radius.

    Matrix products of tiles, centred on the block, give every squared distance up to a
    known rounding error; only points that could be among the k best by it get the exact
    distance (of differences).  A query skips cells that its k best so far rule out."""
    import numpy as np
    import pyarrow as pa

    radius = np.full(len(pivots), np.inf)
    for c in cells:
        radius[c["cell"]] = c["r"]
    piv, matrix = np.asarray(pivots, dtype="float64"), _matrices()

    def best_exact(qv, rv, rid, lim, i, j):
        """The k best (i, j) of each i, with distances."""
        d = np.empty(len(i))
        for a in range(0, len(i), 1 << 15):
            diff = rv[j[a:a + (1 << 15)]] - qv[i[a:a + (1 << 15)]]
            d[a:a + (1 << 15)] = np.sqrt(np.einsum("rd,rd->r", diff, diff))
        keep = d <= lim[i]
        i, j, d = i[keep], j[keep], d[keep]
        order = np.lexsort((rid[j], d, i))
        i, j, d = i[order], j[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], j[keep], d[keep]

    def tile(qv, qid, lim, qx, slack, q2, dq, segments, rv, rid, rx):
        """(query, point, distance) of one tile of queries against all points."""
        best = np.full((len(qv), k), np.inf, qx.dtype)
        bound = lim * lim - q2 + slack
        got = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, qx.dtype)]
        for c in np.argsort(dq.mean(axis=0)):
            cell, start, end = segments[c]
            reach = np.minimum(lim, np.sqrt(np.maximum(bound + q2, 0)) * (1 + SLACK) + SLACK)
            act = np.flatnonzero(~(dq[:, c] - radius[cell] > reach))
            for a in range(start, end if len(act) else start, TILE_POINTS):
                b = min(a + TILE_POINTS, end)
                sq = qx[act] @ rx[a:b].T
                hit = sq <= bound[act, None]
                rows = np.flatnonzero(hit.any(axis=1))
                if not len(rows):
                    continue
                sq, hit = sq[rows], hit[rows]
                i, j = np.nonzero(hit)
                if exclude_self:
                    own = rid[a + j] == qid[act[rows[i]]]
                    hit[i[own], j[own]] = False
                    i, j = i[~own], j[~own]
                rows = act[rows]
                best[rows] = np.partition(np.concatenate([best[rows], np.where(hit, sq, np.inf)], axis=1),
                                          k - 1, axis=1)[:, :k]
                bound[rows] = np.minimum(bound[rows], best[rows].max(axis=1) + 2 * slack[rows])
                sq = sq[i, j]
                keep = sq <= bound[rows[i]]
                for held, new in zip(got, (rows[i], a + j, sq)):
                    held.append(new[keep])
                if sum(map(len, got[0])) > 1 << 20:         # many equal distances: settle them now
                    i, j, sq = (np.concatenate(x) for x in got)
                    keep = sq <= bound[i]
                    i, j, _ = best_exact(qv, rv, rid, lim, i[keep], j[keep])
                    got = [i], [j], [np.full(len(i), -np.inf, qx.dtype)]
        i, j, sq = (np.concatenate(x) for x in got)
        keep = sq <= bound[i]
        return best_exact(qv, rv, rid, lim, i[keep], j[keep])

    def run(_key, qt: pa.Table, rt: pa.Table) -> pa.Table:
        out = [], [], []
        if qt.num_rows and rt.num_rows:
            cell = rt["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cell, rv, rid = cell[order], matrix(rt["vec"])[order], rt["rid"].to_numpy()[order]
            ids, starts = np.unique(cell, return_index=True)
            segments = list(zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)]))
            qv, qid, lim = matrix(qt["qvec"]), qt["qid"].to_numpy(), qt["lim"].to_numpy()
            dq = np.stack([np.sqrt(np.einsum("rd,rd->r", qv - p, qv - p)) for p in piv[ids]], axis=1)
            order = np.argsort(dq.argmin(axis=1), kind="stable")
            qv, qid, lim, dq = qv[order], qid[order], lim[order], dq[order]
            with np.errstate(all="ignore"):
                whole = np.isfinite(rv).all(axis=1)
                centre = rv[whole].mean(axis=0) if whole.any() else np.zeros(rv.shape[1])
                qc, rc = qv - centre, rv - centre
                q2, r2 = np.einsum("rd,rd->r", qc, qc), np.einsum("rd,rd->r", rc, rc)
                top = np.sqrt(r2[whole].max(initial=0.0))
                size = (np.sqrt(np.nan_to_num(q2).max()) + top) ** 2
                kind = np.float32 if 1e-30 < size < 1e30 else np.float64
                slack = 4 * (rv.shape[1] + 8) * float(np.finfo(kind).eps) * (np.sqrt(q2) + top) ** 2
                qx = np.c_[-2 * qc, np.ones(len(qc))].astype(kind)
                rx = np.c_[rc, r2].astype(kind)
                for a in range(0, len(qv), TILE_QUERIES):
                    t = slice(a, a + TILE_QUERIES)
                    i, j, d = tile(qv[t], qid[t], lim[t], qx[t], slack[t], q2[t], dq[t], segments, rv, rid, rx)
                    for held, new in zip(out, (qid[t][i], rid[j], d)):
                        held.append(new)
        none = np.zeros(0)
        return pa.table({n: pa.array(np.concatenate([none, *x]) if n == "d" else np.concatenate([none.astype("int64"), *x]))
                         for n, x in zip(("qid", "rid", "d"), out)})
    return run


def knn(queries: DataFrame, ref: DataFrame, k: int = 5, exclude_self: bool = False,
        n_pivots: int | None = None, block: int | None = None) -> DataFrame:
    """Exact k nearest reference points per query: (qid, rid, d, rank).

    queries: (qid, vec); ref: (rid, vec).  With ``exclude_self`` a reference point
    whose rid equals the qid is skipped (leave-one-out).  Distance ties are broken
    by rid.  The search radius U of a query is the k-th smallest of
    d(q, p_c) + d(x, p_c) over the cells' nearest-to-pivot points, an upper bound
    on the k-th neighbour distance by the triangle inequality.

    Neighbouring cells form blocks of ``block`` points (a sixteenth of the points; at
    most 65,536 rows and 32 MB); a query is sent once to every block its radius can
    reach.  Queries and points meet per block in a cogrouped ``applyInArrow``; a block
    that more than ``block`` queries reach is sent to several tasks.  Where nothing can
    be pruned (unit vectors of many dimensions) a row is so sent to 16 tasks, and the
    pairs cost a matrix product each.  Of equal points only the least ids take part.
    """
    ids = ref.where(F.col("vec").isNotNull()).select(F.col("rid").cast("long").alias("rid"),
                                                     F.col("vec").cast("array<double>").alias("vec"))
    need = k
    if exclude_self:                                        # an id may stand on several rows
        queries = queries.where(F.col("qid").isNotNull())
        ids = ids.where(F.col("rid").isNotNull())
        need += ids.groupBy("rid").count().agg(F.max("count")).first()[0] or 0
    least = Window.partitionBy("vec").orderBy("rid")
    points = cut_lineage(ids.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= need).drop("_n"))
    base, pivots, stats = _assigned_cells(points, n_pivots, 7, min(need, k + 8))
    cells = stats.orderBy("cell").collect()                 # at most 512 rows
    if not cells:
        return points.sparkSession.createDataFrame([], "qid long, rid long, d double, rank int")
    n = sum(c["n"] for c in cells)
    block = block or max(1, min(max(1024, -(-n // KNN_SIDES)), KNN_ROWS, KNN_BYTES // (8 * max(1, len(pivots[0])))))
    first, parts = _blocks(cells, pivots, block)
    spark = points.sparkSession
    probes = cut_lineage(_reached_blocks(queries, pivots, cells, first, parts, need))
    asked = probes.select(F.explode("blocks").alias("blk")).groupBy("blk").count().collect()
    shares = F.broadcast(spark.createDataFrame([(r["blk"], -(-r["count"] // block)) for r in asked], "blk int, qs int"))
    layout = F.broadcast(spark.createDataFrame(
        [(c["cell"], int(first[c["cell"]]), int(parts[c["cell"]])) for c in cells], "cell int, first int, parts int"))
    r_side = (base.join(layout, on="cell")
              .withColumn("blk", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))).cast("int"))
              .join(shares, on="blk")
              .select("blk", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("_qb"), "rid", "vec", "cell"))
    q_side = (probes.select("qid", "qvec", "lim", F.explode("blocks").alias("blk")).join(shares, on="blk")
              .select("blk", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int").alias("_qb"), "qid", "qvec", "lim"))
    pairs = q_side.groupBy("blk", "_qb").cogroup(r_side.groupBy("blk", "_qb")).applyInArrow(
        _block_nearest(pivots, cells, k, exclude_self), PAIR_SCHEMA)
    w = Window.partitionBy("qid").orderBy("d", "rid")
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "rid", "d", "rank"))


def knn_predict(queries: DataFrame, ref: DataFrame, k: int = 5, task: str = "classification",
                exclude_self: bool = False) -> DataFrame:
    """M7: kNN prediction.  ref: (rid, vec, target[, w]).  Classification = majority
    vote, ties to the smallest label; regression = mean of the neighbours.  ``w`` is the
    number of equal rows a reference point stands for: the nearest points are taken
    until their weights make k."""
    if "w" not in ref.columns:
        ref = ref.withColumn("w", F.lit(1).cast("bigint"))
    nb = knn(queries, ref.select("rid", "vec"), k, exclude_self)
    nearer = Window.partitionBy("qid").orderBy("d", "rid").rowsBetween(Window.unboundedPreceding, -1)
    lab = (nb.join(ref.select("rid", "target", "w"), on="rid")
           .withColumn("w", F.least("w", F.lit(k) - F.coalesce(F.sum("w").over(nearer), F.lit(0))))
           .where("w > 0"))
    if task == "regression":
        return lab.groupBy("qid").agg(
            (F.sum(F.col("target").cast("double") * F.col("w")) / F.sum("w")).alias("prediction"))
    votes = lab.groupBy("qid", "target").agg(F.sum("w").alias("_v"))
    best = votes.groupBy("qid").agg(
        F.max_by("target", F.struct(F.col("_v"), -F.col("target").cast("double"))).alias("prediction")) \
        if _numeric_target(ref) else votes.groupBy("qid").agg(
        F.min_by("target", F.struct(-F.col("_v"), F.col("target"))).alias("prediction"))
    return best


def _numeric_target(ref: DataFrame) -> bool:
    from pyspark.sql.types import NumericType
    return isinstance(ref.schema["target"].dataType, NumericType)

"""DBSCAN (eps, min_samples; noise = -1) as Spark joins and an iterative
connected-components job.

Grid of side ``eps / sqrt(d)``: two points in one cell are always within eps.

* core points: a cell holding >= min_samples points makes all of them core with
  no pair enumerated.  Points of the other ("sparse") cells are compared with the
  points of the neighbouring cells only; a sparse cell has fewer than min_samples
  points, so this emits at most (#neighbour cells x min_samples) pairs per point
  of any cell, linear in the input even when one cell holds a third of the rows.
* clusters: core cells are the nodes; a core cell is linked to a neighbouring
  core cell when some pair of their core points is within eps.  Most links are
  settled without any point pair: sub-cells of half the cell side whose farthest
  points are within eps link their cells when both hold a core point (a join of
  distinct sub-cells).  Neighbouring core cells that these links leave in different
  components are decided by the boxes of their points, halved until they decide or
  few point pairs are left.  Components come from min-label
  propagation with pointer jumping, checkpointed into ``spark.checkpoint.dir``.
* border points (non-core, within eps of a core point; always in sparse cells)
  take the smallest neighbouring cluster label.

The cluster label is the smallest point id among the cluster's core points.
Above ``grid_max_dims`` dimensions the neighbour stencil grows as 5^d, so the
radius pairs come from the pivot index instead (exact, but without the dense-
cell shortcut).
"""
from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.operators.neighbors import (SLACK, _cell_sides, _query_pivot_dists, block_reduce,
                                          build_index, dist)
from tabsense.session import cut_lineage


def _stencil(d: int) -> list[list[int]]:
    """Cell offsets whose closest approach is within eps (cell side eps/sqrt(d))."""
    reach = int(math.ceil(math.sqrt(d)))
    out = []
    for off in itertools.product(range(-reach, reach + 1), repeat=d):
        gap = sum(max(0, abs(o) - 1) ** 2 for o in off)
        if gap <= d:   # (gap * side^2) <= eps^2  <=>  gap <= d
            out.append(list(off))
    return out


def _sure_stencil(d: int) -> list[list[int]]:
    """Sub-cell offsets (sub-cell side eps / (2 sqrt(d))) whose farthest points are
    within eps: sum((|o_i| + 1)^2) <= 4 d."""
    out = []
    for off in itertools.product(range(-2 * d, 2 * d + 1), repeat=d):
        if sum((abs(o) + 1) ** 2 for o in off) <= 4 * d:
            out.append(list(off))
    return out


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node id per component.  edges: (a, b) undirected; nodes: (node).
    Returns (node, comp).

    Each round takes the smallest label among a node's neighbours, then jumps to
    the label of that label (pointer jumping), so long chains converge in few
    rounds; it goes on until a round changes nothing.  Every round is checkpointed into the shared checkpoint folder, so the
    plan stays one round deep and a lost executor costs one round at most.
    """
    sym = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sym = cut_lineage(sym.distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("comp")))
    while True:
        nb = (sym.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("bc")), on="b")
              .groupBy(F.col("a").alias("node")).agg(F.min("bc").alias("nc")))
        step = (labels.join(nb, on="node", how="left")
                .select("node", F.col("comp").alias("old"),
                        F.least("comp", F.coalesce("nc", "comp")).alias("comp")))
        jump = step.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("cc")),
                         on="comp", how="left")
        new = cut_lineage(jump.select("node", "old",
                                      F.least("comp", F.coalesce("cc", "comp")).alias("comp")))
        changed = new.agg(F.count_if(F.col("comp") != F.col("old"))).first()[0]
        labels = new.select("node", "comp")
        if changed == 0:
            return labels


#: Open cell pairs compare their points when that is at most so many pairs a core point.
PAIRS_A_POINT = 16
#: Boxes are halved so often at most; what is then open lies within side / 2**20 of eps.
BOX_LEVELS = 20


def _close_cells(core_pts: DataFrame, pairs: DataFrame, d: int, side: float, eps: float) -> DataFrame | None:
    """The (home, cell) of ``pairs`` that hold core points within eps of each other; None
    without pairs.

    Dual refinement: two boxes (least and greatest coordinates of the points of a
    sub-cell) link their cells if their farthest corners are within eps and are dropped
    if their nearest ones are not; the others are halved.  Every round is one pass over
    the points of the open cells.  Once the open boxes hold at most ``PAIRS_A_POINT``
    pairs a core point, their points are compared."""
    n = core_pts.count()
    at = lambda level: F.transform("vec", lambda x: F.floor(x / F.lit(side / 2 ** level)).cast("bigint"))
    open_ = cut_lineage(pairs.select("home", "cell", F.col("home").alias("hsub"), F.col("cell").alias("csub")))
    if open_.isEmpty():
        return None
    found = None
    for level in range(BOX_LEVELS + 1):
        cells = open_.select("cell").unionByName(open_.select(F.col("home").alias("cell"))).distinct()
        pts = (core_pts.select("cell", "vec").join(cells, on="cell", how="left_semi")
               .withColumn("up", at(max(level - 1, 0))).withColumn("sub", at(level)))
        box = pts.groupBy("cell", "up", "sub").agg(
            F.array(*[F.min(F.col("vec")[i]) for i in range(d)]).alias("lo"),
            F.array(*[F.max(F.col("vec")[i]) for i in range(d)]).alias("hi"), F.count(F.lit(1)).alias("n"))
        near, far = F.lit(0.0), F.lit(0.0)
        for i in range(d):
            gap = F.greatest(F.col("lo")[i] - F.col("hhi")[i], F.col("hlo")[i] - F.col("hi")[i], F.lit(0.0))
            span = F.greatest(F.col("hi")[i] - F.col("hlo")[i], F.col("hhi")[i] - F.col("lo")[i])
            near, far = near + gap * gap, far + span * span
        met = (open_.join(box.select(F.col("cell").alias("home"), F.col("up").alias("hsub"), F.col("sub").alias("hsub2"),
                                     F.col("lo").alias("hlo"), F.col("hi").alias("hhi"), F.col("n").alias("hn")),
                          on=["home", "hsub"])
               .join(box.withColumnRenamed("up", "csub"), on=["cell", "csub"])
               .where(F.sqrt(near) <= F.lit(eps))
               .select("home", "cell", F.col("hsub2").alias("hsub"), F.col("sub").alias("csub"),
                       (F.sqrt(far) <= F.lit(eps)).alias("sure"), (F.col("hn") * F.col("n")).alias("work")))
        met = cut_lineage(met)
        linked = met.where("sure").select("home", "cell").distinct()
        found = linked if found is None else found.unionByName(linked)
        open_ = cut_lineage(met.join(linked, on=["home", "cell"], how="left_anti").drop("sure"))
        work = open_.agg(F.sum(F.col("work").cast("double"))).first()[0] or 0.0
        open_ = open_.drop("work")
        if work <= PAIRS_A_POINT * n:
            break
    if work:
        last = core_pts.select("cell", "vec", at(level).alias("csub"))
        found = found.unionByName(
            open_.join(last.select(F.col("cell").alias("home"), F.col("csub").alias("hsub"), F.col("vec").alias("pvec")),
                       on=["home", "hsub"])
            .join(last, on=["cell", "csub"])
            .where(dist(F.col("pvec"), F.col("vec")) <= F.lit(eps)).select("home", "cell").distinct())
    return found


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5,
           grid_max_dims: int = 4) -> DataFrame:
    """points: (pid bigint, vec array<double>[, w bigint]).  Returns (pid, cluster, is_core).

    ``w`` is the number of rows a point stands for (1 without the column): repeated
    rows are one weighted point, so they never meet as pairs."""
    if "w" not in points.columns:
        points = points.withColumn("w", F.lit(1).cast("bigint"))
    d = points.select(F.size("vec").alias("d")).first()
    if d is None:
        return points.sparkSession.createDataFrame([], "pid bigint, cluster bigint, is_core boolean")
    d = int(d["d"])
    if d > grid_max_dims:
        return _dbscan_pivot(points, eps, min_samples)
    side = eps / math.sqrt(d)
    cell = F.transform("vec", lambda x: F.floor(x / F.lit(side)).cast("bigint"))
    pts = points.select("pid", "vec", "w", cell.alias("cell"))
    sizes = pts.groupBy("cell").agg(F.sum("w").alias("csize"))
    pts = pts.join(sizes, on="cell")
    dense = F.col("csize") >= min_samples
    stencil = F.array(*[F.array(*[F.lit(o) for o in off]) for off in _stencil(d)])

    # sparse points probe their neighbour cells (including their own)
    def near(sparse: DataFrame, others: DataFrame) -> DataFrame:
        probes = sparse.select("pid", F.col("vec").alias("pvec"),
                               F.explode(F.transform(stencil, lambda off: F.zip_with(
                                   F.col("cell"), off, lambda c, o: c + o))).alias("cell"))
        return probes.join(others, on="cell").where(dist(F.col("pvec"), F.col("vec")) <= F.lit(float(eps)))

    degree = near(pts.where(~dense), pts.select("cell", "vec", "w")).groupBy("pid").agg(F.sum("w").alias("deg"))
    core = (pts.join(degree, on="pid", how="left")
            .select("pid", "cell", "vec", (dense | (F.coalesce("deg", F.lit(0)) >= min_samples))
                    .alias("is_core")))
    core = cut_lineage(core)
    core_pts = core.where("is_core")

    # core cells and links between neighbouring core cells
    core_cells = core_pts.groupBy("cell").agg(F.min("pid").alias("node"))
    # 1. certain links without point pairs: non-empty core sub-cells (half the cell
    #    side) whose farthest points are within eps link their two cells; this is a
    #    join of distinct sub-cells, so two adjacent dense cells cost no pairs.
    half = side / 2.0
    sub = F.transform("vec", lambda x: F.floor(x / F.lit(half)).cast("bigint"))
    core_sub = core_pts.select("cell", sub.alias("sub")).distinct()
    sure_st = F.array(*[F.array(*[F.lit(o) for o in off]) for off in _sure_stencil(d)])
    sure = (core_sub.select(F.col("cell").alias("home"), F.explode(F.transform(
                sure_st, lambda off: F.zip_with(F.col("sub"), off, lambda c, o: c + o))).alias("sub"))
            .join(core_sub, on="sub").where(F.col("home") != F.col("cell"))
            .select("home", "cell").distinct())
    ids = core_cells.select(F.col("cell").alias("home"), F.col("node").alias("a"))
    edges = (sure.join(ids, on="home")
             .join(core_cells.select("cell", F.col("node").alias("b")), on="cell").select("a", "b"))
    comps = connected_components(edges, core_cells.select("node"))
    # 2. of the neighbouring core cells only pairs that the links above leave in
    #    different components are open: the boxes of their points decide, and the links
    #    found join whole components.
    cell_comp = cut_lineage(core_cells.join(comps, on="node").select("cell", "comp"))
    home_comp = cell_comp.select(F.col("cell").alias("home"), F.col("comp").alias("hcomp"))
    cell_pairs = (cell_comp.select(F.col("cell").alias("home"), F.col("comp").alias("hcomp"), F.explode(F.transform(
                      stencil, lambda off: F.zip_with(F.col("cell"), off, lambda c, o: c + o))).alias("cell"))
                  .where(F.col("home") < F.col("cell"))
                  .join(cell_comp, on="cell").where("comp <> hcomp").select("home", "cell"))
    checked = _close_cells(core_pts, cell_pairs, d, side, float(eps))
    cell_label = cell_comp.withColumnRenamed("comp", "cluster")
    if checked is not None:
        edges = (checked.join(home_comp, on="home").join(cell_comp, on="cell")
                 .select(F.col("hcomp").alias("a"), F.col("comp").alias("b")))
        whole = connected_components(edges, cell_comp.select(F.col("comp").alias("node")).distinct())
        cell_label = cell_comp.join(whole.select(F.col("node").alias("comp"), F.col("comp").alias("cluster")),
                                    on="comp").select("cell", "cluster")
    labelled = core_pts.join(cell_label, on="cell")
    core_lab = labelled.select("pid", "cluster")

    # border points: smallest label among core neighbours
    border = (near(core.where(~F.col("is_core")), labelled.select("cell", "vec", "cluster"))
              .groupBy("pid").agg(F.min("cluster").alias("bl")))
    out = (core.select("pid", "is_core").join(core_lab, on="pid", how="left")
           .join(border, on="pid", how="left")
           .select("pid", F.coalesce("cluster", F.when(~F.col("is_core"), F.col("bl")), F.lit(-1))
                   .cast("bigint").alias("cluster"), "is_core"))
    return out


def _dbscan_pivot(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """DBSCAN above ``grid_max_dims`` dimensions on the pivot index, without
    emitting point pairs: degrees are counted inside the cogrouped cell blocks,
    clusters come from min-label propagation through the same blocks (each round
    every core point takes the smallest label of its core neighbours within eps,
    then jumps to its label's label), and border points take the smallest label of
    a core neighbour.  Every round emits one row per point and is checkpointed."""
    ref = points.select(F.col("pid").alias("rid"), "vec")
    assigned, pv, cs = build_index(ref)
    q = _query_pivot_dists(points.select(F.col("pid").alias("qid"), "vec"), pv).withColumn("_cs", cs)
    lim = F.lit(float(eps) * (1 + SLACK) + SLACK)
    q_side, r_side, keys = _cell_sides(q, assigned, lim)
    weights = points.select(F.col("pid").alias("rid"), F.col("w").alias("lab"))
    deg = block_reduce(q_side, r_side.join(weights, on="rid"), keys, eps, "sum")
    core = (points.select("pid").join(deg.select(F.col("qid").alias("pid"), F.col("v").alias("deg")),
                                      on="pid", how="left")
            .select("pid", (F.coalesce("deg", F.lit(0)) >= min_samples).alias("is_core")))
    core = cut_lineage(core)
    core_ids = core.where("is_core").select("pid")
    q_core = q_side.join(core_ids.withColumnRenamed("pid", "qid"), on="qid", how="left_semi")
    r_core = r_side.join(core_ids.withColumnRenamed("pid", "rid"), on="rid", how="left_semi")
    labels = cut_lineage(core_ids.select(F.col("pid").alias("node"), F.col("pid").alias("comp")))

    def with_labels(lab: DataFrame) -> DataFrame:
        return r_core.join(lab.select(F.col("node").alias("rid"), F.col("comp").alias("lab")), on="rid")

    while True:
        nb = block_reduce(q_core, with_labels(labels), keys, eps, "minlab")
        step = (labels.join(nb.select(F.col("qid").alias("node"), F.col("v").alias("nc")), on="node", how="left")
                .select("node", F.col("comp").alias("old"),
                        F.least("comp", F.coalesce("nc", "comp")).alias("comp")))
        jump = step.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("cc")),
                         on="comp", how="left")
        new = cut_lineage(jump.select("node", "old", F.least("comp", F.coalesce("cc", "comp")).alias("comp")))
        changed = new.agg(F.count_if(F.col("comp") != F.col("old"))).first()[0]
        labels = new.select("node", "comp")
        if changed == 0:
            break
    q_border = q_side.join(core.where(~F.col("is_core")).select(F.col("pid").alias("qid")),
                           on="qid", how="left_semi")
    border = block_reduce(q_border, with_labels(labels), keys, eps, "minlab")
    core_lab = labels.select(F.col("node").alias("pid"), F.col("comp").alias("cluster"))
    return (core.join(core_lab, on="pid", how="left")
            .join(border.select(F.col("qid").alias("pid"), F.col("v").alias("bl")), on="pid", how="left")
            .select("pid", F.coalesce("cluster", F.when(~F.col("is_core"), F.col("bl")), F.lit(-1))
                    .cast("bigint").alias("cluster"), "is_core"))

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsense.operators.dbscan import connected_components, dbscan
from tabsense.operators.neighbors import knn


def test_knn_exact_with_duplicates(spark):
    rng = np.random.default_rng(11)
    ref = np.round(rng.normal(0, 1, (300, 3)), 1)
    ref[:40] = ref[0]                                   # a heavy duplicate group
    qry = rng.normal(0, 1, (60, 3))
    r = spark.createDataFrame(pd.DataFrame({"rid": range(300), "vec": list(ref)}))
    q = spark.createDataFrame(pd.DataFrame({"qid": range(60), "vec": list(qry)}))
    got = knn(q, r, 4, n_pivots=8).toPandas()
    d = np.sqrt(((qry[:, None, :] - ref[None, :, :]) ** 2).sum(-1))
    ids = np.arange(300)
    for i in range(60):
        exp = ids[np.lexsort((ids, d[i]))][:4].tolist()
        assert got[got.qid == i].sort_values("rank").rid.tolist() == exp


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, .15, (80, 2)), rng.normal(2, .2, (60, 2)), rng.uniform(-3, 5, (20, 2))])
    pdf = pd.DataFrame({"pid": range(len(x)), "vec": list(x)})
    got = dbscan(spark.createDataFrame(pdf), 0.3, 5).toPandas().sort_values("pid")
    n = len(x)
    nb = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.3
    core = nb.sum(1) >= 5
    comp = -np.ones(n, dtype=int)
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack, members = [i], []
            comp[i] = 0
            while stack:
                j = stack.pop()
                members.append(j)
                for k in np.where(nb[j] & core & (comp < 0))[0]:
                    comp[k] = 0
                    stack.append(k)
            for j in members:
                comp[j] = min(members)
    exp = np.where(core, comp, -1)
    for i in range(n):
        if not core[i]:
            cs = [comp[k] for k in np.where(nb[i] & core)[0]]
            exp[i] = min(cs) if cs else -1
    assert (got.cluster.values == exp).all()
    assert (got.is_core.values == core).all()


def test_connected_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    nodes = spark.range(0, 31).withColumnRenamed("id", "node").union(
        spark.createDataFrame([(100,), (101,), (200,)], "node long"))
    cc = {r["node"]: r["comp"] for r in connected_components(edges, nodes).collect()}
    assert all(cc[i] == 0 for i in range(31)) and cc[101] == 100 and cc[200] == 200


def test_knn_sub_blocks_leave_one_out_vs_brute_force(spark):
    """Tiny blocks force every cell into hash sub-blocks on both sides; the
    leave-one-out result must still equal brute force (ties by rid)."""
    rng = np.random.default_rng(21)
    pts = np.round(rng.normal(0, 1, (400, 16)), 2)
    pts[100:160] = pts[100]                             # a third-of-a-cell duplicate group
    df = pd.DataFrame({"id": range(400), "vec": list(pts)})
    r = spark.createDataFrame(df.rename(columns={"id": "rid"}))
    q = spark.createDataFrame(df.rename(columns={"id": "qid"}))
    got = knn(q, r, 3, exclude_self=True, n_pivots=6, block=16).toPandas()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    ids = np.arange(400)
    for i in range(400):
        row = np.where(ids == i, np.inf, d[i])
        exp = ids[np.lexsort((ids, row))][:3].tolist()
        assert got[got.qid == i].sort_values("rank").rid.tolist() == exp


def _dbscan_brute(x, eps, min_samples):
    n = len(x)
    nb = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = nb.sum(1) >= min_samples
    comp = -np.ones(n, dtype=int)
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack, members = [i], []
            comp[i] = 0
            while stack:
                j = stack.pop()
                members.append(j)
                for k in np.where(nb[j] & core & (comp < 0))[0]:
                    comp[k] = 0
                    stack.append(k)
            for j in members:
                comp[j] = min(members)
    exp = np.where(core, comp, -1)
    for i in range(n):
        if not core[i]:
            cs = [comp[k] for k in np.where(nb[i] & core)[0]]
            exp[i] = min(cs) if cs else -1
    return exp, core


def test_dbscan_3d_dense_blobs_and_bridge(spark):
    """Two dense 3-D blobs (most links settled by sub-cells), a thin bridge of
    single points (links that need point checks), a far blob and noise."""
    rng = np.random.default_rng(17)
    a = rng.normal(0, .1, (150, 3))
    b = rng.normal(0, .1, (150, 3)) + [1.2, 0, 0]
    bridge = np.column_stack([np.linspace(0.25, 0.95, 8), np.zeros(8), np.zeros(8)])
    far = rng.normal(0, .1, (40, 3)) + [0, 3, 0]
    noise = rng.uniform(-2, 4, (25, 3))
    x = np.concatenate([a, b, bridge, far, noise])
    pdf = pd.DataFrame({"pid": range(len(x)), "vec": list(x)})
    got = dbscan(spark.createDataFrame(pdf), 0.25, 4).toPandas().sort_values("pid")
    exp, core = _dbscan_brute(x, 0.25, 4)
    assert (got.is_core.values == core).all()
    assert (got.cluster.values == exp).all()


def test_dbscan_pivot_path_5d(spark):
    """Above four dimensions DBSCAN takes the pivot radius search (cell blocks)."""
    rng = np.random.default_rng(23)
    x = np.concatenate([rng.normal(0, .15, (120, 5)), rng.normal(1.5, .15, (80, 5)),
                        rng.uniform(-1, 3, (20, 5))])
    pdf = pd.DataFrame({"pid": range(len(x)), "vec": list(x)})
    got = dbscan(spark.createDataFrame(pdf), 0.45, 5).toPandas().sort_values("pid")
    exp, core = _dbscan_brute(x, 0.45, 5)
    assert (got.is_core.values == core).all()
    assert (got.cluster.values == exp).all()


def test_dbscan_pivot_path_long_chain(spark):
    """A 6-D chain of points spaced just under eps needs many propagation rounds;
    its single cluster label must be the smallest core id."""
    rng = np.random.default_rng(29)
    t = np.arange(60) * 0.09
    chain = np.column_stack([t, np.zeros(60), np.zeros(60), np.zeros(60), np.zeros(60), np.zeros(60)])
    x = np.concatenate([chain[::-1], rng.uniform(10, 20, (10, 6))])
    pdf = pd.DataFrame({"pid": range(len(x)), "vec": list(x)})
    got = dbscan(spark.createDataFrame(pdf), 0.1, 2).toPandas().sort_values("pid")
    exp, core = _dbscan_brute(x, 0.1, 2)
    assert (got.is_core.values == core).all()
    assert (got.cluster.values == exp).all()


def test_dbscan_far_apart_dense_cells_cost_no_point_pairs(spark, monkeypatch):
    """Dense cells that touch are one component by their boxes; every point pair of theirs
    (2.6 billion here) was compared before.  Two blobs a hair within and beyond eps of each
    other are told apart by refined boxes."""
    import time

    from tabsense.operators import dbscan as D

    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (60000, 2))
    begun = time.time()
    pts = spark.createDataFrame(pd.DataFrame({"pid": range(len(x)), "vec": list(x)})).repartition(8)
    got = dbscan(pts, 0.3, 5).groupBy("cluster", "is_core").count().collect()
    assert [(r.cluster, r.is_core, r["count"]) for r in got] == [(0, True, 60000)]
    assert time.time() - begun < 90

    monkeypatch.setattr(D, "PAIRS_A_POINT", 0)              # boxes are refined to the end
    for gap, clusters in ((0.2999, 1), (0.3, 1), (0.3001, 2)):
        left = [(0.0, 0.01 * i) for i in range(-20, 20)]
        y = np.array(left + [(gap + a, b) for a, b in left])
        pts = spark.createDataFrame(pd.DataFrame({"pid": range(len(y)), "vec": list(y)}))
        assert dbscan(pts, 0.3, 5).select("cluster").distinct().count() == clusters


def test_knn_repeated_ids_and_many_equal_points(spark):
    """A row's own id stands on several rows and most points are equal: neighbours are the
    nearest rows of other ids, far from the origin too."""
    rng = np.random.default_rng(8)
    pts = np.concatenate([np.round(rng.normal(0, 1, (120, 12)), 2), np.full((200, 12), 0.5)]) + 1e6
    ids = np.r_[np.arange(310), np.arange(10)]
    pts[310:] = pts[:10]
    df = pd.DataFrame({"id": ids, "vec": list(pts)})
    r = spark.createDataFrame(df.rename(columns={"id": "rid"}))
    q = spark.createDataFrame(df.iloc[:310].rename(columns={"id": "qid"}))
    got = knn(q, r, 3, exclude_self=True, block=40).toPandas()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    for i in range(310):
        row = np.where(ids == i, np.inf, d[i])
        exp = ids[np.lexsort((ids, row))][:3].tolist()
        assert got[got.qid == i].sort_values("rank").rid.tolist() == exp


def test_knn_sends_a_row_to_few_tasks(spark):
    """Where no cell can be ruled out a row goes to 16 blocks, not to every cell."""
    from tabsense.operators import neighbors as N

    x = np.random.default_rng(9).normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = [{"cell": c, "n": 40, "r": 1.3, "kd": [0.9] * 5} for c in range(500)]
    pivots = x[:500].tolist()
    first, parts = N._blocks(cells, pivots, 1250)
    assert parts.max() == 1 and first.max() < 20
    q = spark.createDataFrame(pd.DataFrame({"qid": range(50), "vec": list(x[500:550])}))
    sent = N._reached_blocks(q, pivots, cells, first, parts, 5).select(F.size("blocks")).distinct().collect()
    assert [r[0] for r in sent] == [int(first.max()) + 1]

import re
from collections import Counter, defaultdict

import numpy as np

from tabsense.llm import mixing as M

WEIGHTS = (5, 2, 1)


def brute_targets(sizes):
    """sizes: source -> words; the filling written from its definition."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        above = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not above:
            w = sum(weight[x] for x in open_)
            return target | {s: rest * weight[s] / w for s in open_}
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(df, rows, slack):
    """rows: (doc_id, text, source)."""
    out = M.mix(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    by_id = {r[0]: r for r in rows}
    taken = defaultdict(int)
    for r in out:
        _, t, s = by_id[r.doc_id]
        assert r["size"] == words(t) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack(s)
    return out


def test_targets_and_words_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    sizes = defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(words(t))
    want = brute_targets({s: sum(n) for s, n in sizes.items()})
    assert min(map(len, sizes.values())) >= 20
    out = check(docs, rows, lambda s: max(0.01 * want[s], np.median(sizes[s]) / 2))
    again = M.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_several_leaves_and_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF_ROWS", 8)
    monkeypatch.setattr(M, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(n), "ab"[i % 7 == 0]) for i, n in enumerate(rng.integers(0, 60, 700))]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows, lambda s: 30)


def test_one_heavy_document_among_light_ones(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        rows = [(0, "w " * 3000, "a")] + [(i, "w " * int(n), "a") for i, n in enumerate(rng.integers(1, 200, 60), 1)]
        rows += [(100 + i, "w " * int(n), "b") for i, n in enumerate(rng.integers(1, 900, 40))]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        check(df, rows, lambda s: 100)


def test_last_residual_is_balanced():
    mass, wanted = np.array([100.0, 40, 30, 20, 9, 2]), np.full(6, 0.5)
    part = np.array([0.45, 0, 1, 1, 0, 0])
    got = M.finish(mass, wanted, part)
    assert set(got) <= {0, 1} and abs(got @ mass - part @ mass) <= 4
    assert (M.finish(mass, wanted, np.zeros(6)) == 0).all()


def test_edges(spark):
    rows = [(1, None, "a"), (2, "x y", None), (3, " \t", "a"), (4, "a b c d", "b"), (5, "q " * 5000, "c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows],
                               "doc_id long, text string, source string, size int, copies int")
    check(df, rows, lambda s: 2500)
    assert M.mix(df.limit(0)).count() == 0
    twice = df.union(df)
    out = M.mix(twice).collect()
    assert len(out) == 10 and len({(r.doc_id, r.copies) for r in out}) == 5
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    want = {r.doc_id: r.copies for r in M.mix(df).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want


def test_rounding_keeps_words_and_expectation():
    mass = np.array([9.0, 7.0, 5.0, 3.0, 1.0])
    part = np.array([0.3, 0.6, 0.2, 0.5, 0.9])
    got = np.array([M.settle(mass, part, s) for s in range(4000)])
    assert np.allclose(got @ mass, part @ mass)
    assert ((got > 1e-9) & (got < 1 - 1e-9)).sum(axis=1).max() <= 1
    assert np.abs(got.mean(axis=0) - part).max() < 0.03

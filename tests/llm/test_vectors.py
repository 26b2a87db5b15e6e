"""Whitening and vector codes against plain numpy and plain Python."""
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.llm.vector_codes import Codebooks, encode, sequency_transform
from tabsense.llm.whitening import OFFSET, whiten
from tabsense.llm.workload import QUERIES

EXTRA = ["id", "vec", "code", "error", "of", "label_error", "n", "component", "part", "at", "pos", "whitened", "held"]
RNG = np.random.default_rng(9)
VALUES = RNG.standard_normal((150, 20)) * np.linspace(1, 0.2, 20)


def rows():
    out = [(i, [float(x) for x in v], i % 3 if i % 7 else None) for i, v in enumerate(VALUES)]
    out += [(3, out[3][1], 1), (3, out[3][1], 1), (None, out[8][1], 2), (500, None, 1), (501, [1.0, None], 1),
            (502, [math.nan] * 20, 1), (503, [math.inf] + [0.0] * 19, 2), (504, [], 0), (505, [0.5, -0.5], 1)]
    return out


def frame(spark, data, extra=True):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                         T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(data, kind).repartition(5)
    return df.select("*", *[F.lit("text").alias(c) for c in EXTRA]) if extra else df


def kept(data):
    good = [r for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in good), default=0)
    return [(i, list(v) + [0.0] * (width - len(v)), label) for i, v, label in good]


def test_whitening_against_numpy(spark):
    data = kept(rows())
    x = [[math.floor(1024 * c) + OFFSET for c in v] for _, v, _ in data]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array(x) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:8], turn[:, ::-1][:, :8]
    out = whiten(frame(spark, rows())).collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-10
    far = {(i, d) for i, d in zip([r[0] for r in data], [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x])}
    assert {(r.vec_id, int(r.deviation)) for r in out} == far
    for k in range(8):
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in out if r.component == k + 1)
        want = sorted((-1 if i is None else i, w) for (i, _, _), w in zip(data, centred @ turn[:, k] / math.sqrt(values[k])))
        got, want = np.array([w for _, w in mine]), np.array([w for _, w in want])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        share = next(r.explained for r in out if r.component == k + 1)
        assert abs(share / (values[k] / np.trace(cov)) - 1) < 1e-9


def test_whitening_without_spread(spark):
    same = whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None for r in same)
    line = whiten(frame(spark, [(i, [float(i), 2.0 * i, 7.0], 0) for i in range(50)])).collect()
    assert len(line) == 150 and {r.component for r in line if r.whitened is None} == {2, 3}
    assert max(r.identity_error for r in line) < 1e-9
    assert whiten(frame(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    wild = whiten(frame(spark, [(1, [1e300, 1.0], 0), (2, [-1e300, 2.0], 0), (3, [0.0, 3.0], 0)])).collect()
    assert len(wild) == 6 and all(r.deviation > 10 ** 30 for r in wild if r.vec_id < 3)


def brute_codes(data, parts, size, rounds):
    """Plain Python: all distances, one by one."""
    x = [[math.floor(256 * c) for c in v] for _, v, _ in data]
    length = -(-len(x[0]) // parts)
    x = [v + [0] * (parts * length - len(v)) for v in x]
    cut = [[v[p * length:(p + 1) * length] for p in range(parts)] for v in x]
    first = sorted(range(len(x)), key=lambda i: (data[i][0] is None, data[i][0] or 0, data[i][1]))[:size]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[near(p, v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if (g := groups.get(e)) else old for e, old in enumerate(books[p])]
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in f) for f in found]
    label = Counter()
    for (_, _, name), e in zip(data, error):
        label[name] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in f), err, label[name], digest)
                   for (i, _, name), f, err in zip(data, found, error))


@pytest.mark.parametrize("parts,size", [(16, 64), (4, 8), (3, 200), (7, 1)])
def test_codes_against_brute_force(spark, parts, size):
    out = encode(frame(spark, rows()), parts=parts, size=size, rounds=2).collect()
    got = Counter((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in out)
    assert got == brute_codes(kept(rows()), parts, size, 2)


def test_codes_of_odd_tables(spark):
    assert encode(frame(spark, [(1, None, 0), (2, [math.nan], 0)])).count() == 0
    empty = encode(frame(spark, [(1, [], 0), (2, [], None)])).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 16, 0)] * 2
    wild = [(i, [c * 10.0 ** 300] * 3, 0) for i, c in enumerate((1, -1, 0.5, 0))]
    out = encode(frame(spark, wild), parts=1, size=2, rounds=0).collect()
    assert sorted((r.vec_id, r.code) for r in out) == [(0, "00"), (1, "01"), (2, "00"), (3, "00")]
    assert sum(int(r.error) for r in out) == 3 * 2 ** 106


def test_nearest_is_exact_for_any_length():
    for m in (1, 2, 4, 8, 16):
        h = sequency_transform(m)
        assert (h @ h.T == m * np.eye(m)).all() and list((h[:, 1:] != h[:, :-1]).sum(axis=1)) == list(range(m))
    for length, top in ((1, 3), (4, 2), (5, 1000), (11, 1 << 52)):
        books = Codebooks(RNG.integers(-top, top, (2, 30, length)))
        x = RNG.integers(-top, top, (200, length))
        at, away = books.nearest(1, x)
        for v, i, d in zip(x.tolist(), at, away):
            assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books.entries[1].tolist()))


@pytest.mark.parametrize("name", ["op11_whitening", "op12_vector_codes"])
def test_queries_take_odd_tables(spark, tmp_path, name):
    for k, data in enumerate(([], rows())):
        frame(spark, data).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/0").count() == 0
    got = Counter(r.vec_id for r in QUERIES[name](spark, f"{tmp_path}/1").collect())
    each = 8 if name.startswith("op11") else 1
    assert got == Counter({i: each * n for i, n in Counter(r[0] for r in kept(rows())).items()})

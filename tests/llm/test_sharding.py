import zlib
from collections import defaultdict

import numpy as np

from tabsense.llm import sharding as S


def check(df, shards=24):
    rows = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    out = S.shard_documents(df, shards).collect()
    assert len(out) == df.count()
    place, sums, slot = {}, defaultdict(int), defaultdict(list)
    for r in out:
        data = (rows[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert place.setdefault(data, r.shard) == r.shard
        sums[r.shard] += r["size"]
        slot[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slot.values())
    return [sums[i] for i in range(shards)]


def test_documents_balanced(spark):
    sums = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert max(sums) - min(sums) < 0.01 * np.mean(sums)


def test_tree_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF_GROUPS", 20)
    monkeypatch.setattr(S, "FAN_IN", 3)
    monkeypatch.setattr(S, "SLOT_ROWS", 4)
    sums = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 6)
    assert max(sums) - min(sums) < 0.05 * np.mean(sums)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é"), (4, "é"), (5, "x" * 100_000), (5, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, shard int, size int")
    check(df)
    assert S.shard_documents(df.limit(0)).count() == 0


def test_differencing_beats_greedy_example():
    bins = dict(S.difference([[(s, i)] for i, s in enumerate([8, 7, 6, 5, 4])], 2))
    sums = [sum(s for i, s in enumerate([8, 7, 6, 5, 4]) if bins[i] == b) for b in (0, 1)]
    assert sorted(sums) == [14, 16]
    assert S.difference([], 3) == []

from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tabsense.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(rows):
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i][1] ^ fp[j][1]).count("1") <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(fp):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(fp))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(S.simhash_components(docs)) == brute_components(rows)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one  two"), (7, base), (8, base + " x"),
            (8, base + " x"), (10, "É é"), (11, "é É")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    assert got(S.simhash_components(docs)) == brute_components(rows)
    assert S.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("root", [4096, 7])
def test_links_match_brute_force(spark, monkeypatch, root):
    """Also with roots split several times over."""
    monkeypatch.setattr(S, "MAX_ROOT", root)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 12, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
            for s in seeds for _ in range(25)]
    fps = sorted({int(x) - (1 << 64) * (int(x) >> 63) for x in [*seeds, *near]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    parent = {x: x for x in fps}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 2:
                u, v = find(parent, x), find(parent, y)
                parent[max(u, v)] = min(u, v)
    want = {x: find(parent, x) for x in fps}
    labels = S.connected_components(S.fingerprint_links(df, 2))
    have = {x: x for x in fps} | {r.node: r.label for r in labels.collect()}
    assert have == want


def test_spark_hash_is_the_contracts(spark):
    row = spark.sql("select xxhash64('ab cd ef') h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"ab cd ef", 42)


def test_one_row_of_each_component_stays(spark):
    t, u = "one two three four five", "other words that share nothing at all here"
    rows = [(1, t, "a"), (1, t, "a"), (2, t, "b"), (None, u, "c"), (None, u, "d"), (None, u, "d"), (7, u, "e"),
            (8, None, "f"), (9, "", "g"), (3, t + " six seven", "h"), (3, t + " six seven", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    out = S.keep_one_per_component(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, t), (None, u), (8, None), (3, t + " six seven")], key=str)
    assert S.keep_one_per_component(df.limit(0)).count() == 0

"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Fingerprints are computed inside the tasks (one Arrow pass over the texts, no
shuffle) and collapsed to distinct values, so copies never meet as pairs.  Two
fingerprints within ``max_bits`` differing bits agree in at least one of
``max_bits + 1`` bit blocks; each block value is the root of a trie over the other
bits.  A trie is joined with itself level by level: pairs of nodes are followed
together, their differing bits added up, and a pair is dropped as soon as the sum
exceeds the budget.  Roots with more than ``MAX_ROOT`` fingerprints are first
split, by the same rule, into pairs of nodes eight levels further down (repeated
until none is too large), so no root is ever one task's burden.  Each task emits a
spanning forest of the links it finds, not the links; components come from the
distributed star algorithm.

Defined results: null, empty or blank text has fingerprint 0, linked like any
other; fewer words than a shingle hash as one sequence; a null id is never the
smallest unless it is alone; rows repeating an id are rows of their own; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import bit_filter, materialize, probe, text_of
from tabsense.llm.components import connected_components

BITS = 64
MAX_ROOT = 4096        # fingerprints below one trie root in one task
TASK_ROWS = 32768      # rows of one grouped task
STEP = 8               # levels by which a too large root is split
_HASHES = 1 << 15      # hashes whose bits are counted at a time


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of a text, A-Z taken in lower case."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return digest(b" ".join(words), seed)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    first = (ends - size)[:n - shingle + 1].tolist()
    last = ends[shingle - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), _HASHES):
        part = [digest(flat[a:b], seed) for a, b in zip(first[at:at + _HASHES], last[at:at + _HASHES])]
        grid = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += grid.sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n - shingle + 1, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)),
                             np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return base.mapInArrow(scan, f"id {kind}, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(low bit, width) of max_bits + 1 blocks of nearly equal width."""
    k = max_bits + 1
    edges = [BITS * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _roots(fps: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and block: root (block, value), remaining bits."""
    parts = []
    for i, (low, width) in enumerate(_blocks(max_bits)):
        top = f"shiftleft(shiftrightunsigned(shiftrightunsigned(fp, {low}), {width}), {low})" \
            if low + width < BITS else "0L"
        rest = f"({top}) | (fp & {(1 << low) - 1}L)"
        parts.append(F.struct(
            F.lit(i).alias("block"),
            F.expr(f"shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L").alias("value"),
            F.expr(rest).alias("rest"), F.lit(BITS - width).alias("width")))
    return (fps.select("fp", F.explode(F.array(*parts)).alias("r"))
            .select("fp", "r.*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"),
                    F.lit(0).cast("long").alias("b")))


KEY = ["block", "value", "depth", "a", "b"]


def _split(hot: DataFrame, max_bits: int) -> DataFrame:
    """Rows of too large node pairs, dealt to the pairs of nodes STEP levels below."""
    step = F.expr(f"least({STEP}, width - depth)")
    masks = [sum(1 << i for i in c) for k in range(max_bits + 1) for c in combinations(range(STEP), k)]
    return (hot
            .withColumn("step", step)
            .withColumn("own", F.expr("shiftrightunsigned(rest, width - depth)"))
            .withColumn("next", F.expr("shiftrightunsigned(rest, width - depth - step)"))
            .withColumn("other", F.expr("CASE WHEN own = a THEN b ELSE a END"))
            .withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
            .where("mask < shiftleft(1L, step)")
            .where(f"bit_count(a ^ b) + bit_count(mask) <= {max_bits}")
            .withColumn("mate", F.expr(
                "shiftleft(other, step) | ((next & (shiftleft(1L, step) - 1L)) ^ mask)"))
            .select("fp", "block", "value", "rest", "width", F.expr("depth + step").alias("depth"),
                    F.least("next", "mate").alias("a"), F.greatest("next", "mate").alias("b")))


def join_tries(rest: np.ndarray, root: np.ndarray, depth: np.ndarray, a: np.ndarray, b: np.ndarray,
               width: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of rows below one root within the budget.

    Rows must be sorted by (root, rest).  Node pairs of all roots are followed
    together, one level at a time; a node is a range of rows.
    """
    bounds = np.flatnonzero(np.r_[True, root[1:] != root[:-1], True])
    lo, hi = bounds[:-1], bounds[1:]
    w, d = width[lo].astype(np.int64), depth[lo].astype(np.int64)
    cross = a[lo] != b[lo]
    # of a pair of two nodes, the rows of the lower one come first
    own = rest >> (width - depth).astype(np.uint64)
    mine = np.concatenate([[0], np.cumsum(own == a)])
    mid = np.where(cross, lo + mine[hi] - mine[lo], hi)
    err = np.bitwise_count(a[lo] ^ b[lo]).astype(np.int64)
    l1, h1 = lo, mid
    l2, h2 = np.where(cross, mid, lo), hi
    left = w - d                                     # levels still to go
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for level in range(int(left.max(initial=0)), -1, -1):
        done = left == 0
        if done.any():
            pair = done & (l1 != l2) & (h1 > l1) & (h2 > l2)
            found.append((l1[pair], l2[pair]))
        go = ~done & (h1 > l1) & (h2 > l2) & ((l1 != l2) | (h1 - l1 > 1))
        l1, h1, l2, h2, err, left = (x[go] for x in (l1, h1, l2, h2, err, left))
        if not len(l1):
            break
        now = left == level                          # roots of unequal height join in later
        if not now.any():
            continue
        wait = [x[~now] for x in (l1, h1, l2, h2, err, left)]
        l1, h1, l2, h2, err, left = (x[now] for x in (l1, h1, l2, h2, err, left))
        ones = np.concatenate([[0], np.cumsum((rest >> np.uint64(level - 1)) & np.uint64(1), dtype=np.int64)])
        m1 = h1 - (ones[h1] - ones[l1])
        m2 = h2 - (ones[h2] - ones[l2])
        same = l1 == l2
        diff = ~same
        near = err < max_bits
        nxt = [(l1, m1, l2, m2, err), (m1, h1, m2, h2, err)]
        nxt.append(tuple(x[near] for x in (l1, m1, m2, h2, err + 1)))
        far = near & diff
        nxt.append(tuple(x[far] for x in (m1, h1, l2, m2, err + 1)))
        l1, h1, l2, h2, err = (np.concatenate([w_, *(x[i] for x in nxt)]) for i, w_ in enumerate(wait[:5]))
        left = np.concatenate([wait[5], np.full(len(l1) - len(wait[5]), level - 1, np.int64)])
    i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return i, j


def _forest(fp: list[int], pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spanning forest of the links: (fingerprint, its root)."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        u, v = find(fp[i]), find(fp[j])
        if u != v:
            parent[max(u, v)] = min(u, v)
    return [(x, r) for x in parent if (r := find(x)) != x]


def fingerprint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): a spanning forest per task of all pairs of distinct fingerprints (column
    ``fp``) that differ in 1 to max_bits bits."""
    ready = []
    tasks = materialize(_roots(fps, max_bits))
    while True:
        counts = materialize(tasks.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"))
        sized = tasks.join(counts, KEY)
        ready.append(sized.where(F.col("n") <= MAX_ROOT).drop("n"))
        tasks = materialize(_split(sized.where(F.col("n") > MAX_ROOT).drop("n"), max_bits))
        if tasks.isEmpty():
            break
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.union(more)
    rows = materialize(rows)
    buckets = max(1, -(-rows.count() // TASK_ROWS))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rest=pdf["rest"].to_numpy().view(np.uint64)).sort_values([*KEY, "rest"])
        root = pdf.groupby(KEY, sort=False).ngroup().to_numpy()
        col = {c: pdf[c].to_numpy().astype(np.uint64) for c in ("rest", "a", "b")}
        i, j = join_tries(col["rest"], root, pdf["depth"].to_numpy(), col["a"], col["b"],
                          pdf["width"].to_numpy(), max_bits)
        return pd.DataFrame(_forest(pdf["fp"].tolist(), zip(i.tolist(), j.tolist())), columns=["u", "v"])

    return (rows.withColumn("task", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
            .groupBy("task").applyInPandas(join, "u long, v long").distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id
    reachable over links of at most max_bits differing bits), component_size (rows)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    fps = rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    fps = materialize(fps)
    labels = connected_components(fingerprint_links(fps.select("fp"), max_bits))
    labelled = (fps.join(labels, fps["fp"] == labels["node"], "left")
                .select("fp", "first", "copies", F.coalesce("label", "fp").alias("label")))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component"),
                                             F.sum("copies").alias("size"))
    named = labelled.join(smallest, "label").select("fp", "component", "size")
    return (rows.join(named, "fp")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("component").alias("component_id"), F.col("size").alias("component_size")))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without near duplicates: of each component exactly one row stays, with all
    its columns: the one with the smallest id (null first), then text hash; of rows that
    repeat both, the one whose columns have the smallest hash."""
    text = text_of(text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_th"),
                       F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("_all"))
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"))
    found = simhash_components(docs.select(key.alias("doc_id"), text.alias("text")), shingle=shingle, max_bits=max_bits)
    stay = materialize(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id")
                       .agg(F.count("*").alias("n")).select(F.col("component_id.id").alias("_i"), F.col("component_id.th").alias("_t"), "n"))
    hit = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))
    single = rows.join(stay.where("n = 1"), hit, "left_semi").select("_row.*")
    several = stay.where("n > 1")
    picked = (probe(rows, bit_filter(several.select("_i", "_t")), ["_id", "_th"]).join(several, hit)
              .groupBy("_i", "_t").agg(F.min_by("_row", "_all").alias("_row")))
    return single.unionByName(picked.select("_row.*"))

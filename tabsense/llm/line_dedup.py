"""Repeated runs of lines by winnowing over line hashes.

A run is a sequence of neighbouring non-blank lines with ``MIN_WORDS`` words or more;
lines are equal if their words are.  Around every line stand two windows: the shortest
run that begins with it and the shortest that ends with it.  The least line hash of a
window is its fingerprint, so whatever run two places share, both select the same
fingerprints in it.  Fingerprints found at one place only end the search there; for the
others the match is extended both ways to whole windows, which are joined by their
hashes.  Every repeated run is a union of such windows, so the result is exact: a line
goes if it lies in a run of ``MIN_WORDS`` words that has begun before, in order of id,
then of text hash, then of line.  Blank lines go with the line before them.  The first
copy of every line stays.

With ``inside_lines`` a run is a sequence of ``MIN_WORDS`` neighbouring words, wherever
lines begin and end, so every line run is one too.  The units hashed are then overlapping
runs of a little over half as many words; any ``MIN_WORDS`` words that two places share
select the same fingerprints there, and neighbouring fingerprints overlap, so equal
fingerprints at equal distances mean equal words between them:

1. every fingerprint found more than once gets its earliest place, and later places are
   joined to it;
2. neighbours with the same earlier text and the same offset are chained into runs;
3. where the words around a later fingerprint are not all in chained runs (the two ends of
   a run, or an earliest place that shares less than another one), the match is extended
   both ways: all runs of ``MIN_WORDS`` words around that fingerprint, at every place that
   has it, are joined by their hashes.

Rows are proportional to the fingerprints that repeat, plus the windows at run ends; the
texts hashed for those windows are the ones that hold an asked fingerprint.  The result is exact: the words in a run that has begun before go, a line with them if none is
left.  Fingerprints are looked up in bit filters of bounded size (they grow with the
number of keys up to 16 MB); a full filter lets more rows through, never fewer.

Texts stay in their tasks until the decisions are joined to them; only hashes are
grouped, with partial minima first, so a passage held by a third of all rows is one
row per task, and the join that follows can be split by AQE.

Defined results: null text stays null and has no lines; a null id comes first; rows
that repeat id and text get the same decision; a text may become empty, its row stays;
an empty table gives an empty result; other columns pass through.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import bit_filter, discard, materialize, probe, text_of

MIN_WORDS = 50
#: Texts are hashed together up to so many bytes (or one text).
GROUP_BYTES = 1 << 20
#: Filters of hashes have 2**(6 + FILTER_BITS) bits at most, 16 MB.
FILTER_BITS = 21
# Odd multipliers of the rolling hashes, with their inverses mod 2**64, and a random value a byte.
BYTE_STEP, WORD_STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
KEPT_POWERS = 1 << 18
_KEPT: dict[int, np.ndarray] = {}
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def windows(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(fingerprint, its line, window hash, first line, last line) of a text's windows."""
    lines = [(n, w) for n, line in enumerate(text.split(b"\n")) if (w := line.split())]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w)) for _, w in lines]
    flat = b"".join(h.to_bytes(8, "little") for h in hashes)
    spans, total, lo = [], 0, 0
    for hi, (_, w) in enumerate(lines):                    # shortest run that ends at hi
        total += len(w)
        while total - len(lines[lo][1]) >= min_words:
            total -= len(lines[lo][1])
            lo += 1
        if total >= min_words:
            spans.append((lo, hi))
    total, hi = 0, len(lines) - 1
    for lo in range(len(lines) - 1, -1, -1):               # shortest run that begins at lo
        total += len(lines[lo][1])
        while total - len(lines[hi][1]) >= min_words:
            total -= len(lines[hi][1])
            hi -= 1
        if total >= min_words:
            spans.append((lo, hi))
    out = []
    for a, b in set(spans):
        low, at = min((hashes[i], -i) for i in range(a, b + 1))
        out.append((_signed(low), lines[-at][0], _signed(xxhash.xxh64_intdigest(flat[8 * a:8 * b + 8])),
                    lines[a][0], lines[b][0]))
    return out


def window_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, fp, at, wh, first, last): th tells texts of one id apart."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("th"),
                       F.encode(text_of(text_col), "UTF-8").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    names = ["fp", "at", "wh", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows = [], []
            for i, text in enumerate(b.column(2)):
                got = windows(text.as_py(), min_words)
                rows += got
                place += [i] * len(got)
            cols = list(zip(*rows)) or [[]] * 5
            take = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.int64()) for c in cols)],
                ["id", "th", *names])

    return base.mapInArrow(run, f"id {kind}, th long, " + ", ".join(f"{n} long" for n in names))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): the line ranges (first, last) that repeat earlier runs."""
    table = materialize(window_table(docs, id_col, text_col, min_words))
    place = F.struct("id", "th", "at")
    shared = (table.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .where("a <> b").select("fp"))
    live = probe(table, bit_filter(shared), ["fp"]).select("id", "th", "wh", "first", "last")
    start = F.struct("id", "th", "first")
    earliest = materialize(live.groupBy("wh").agg(F.min(start).alias("a"), F.max(start).alias("b"))
                           .where("NOT a <=> b").select("wh", "a"))
    later = live.join(earliest, "wh").where(F.struct("id", "th", "first") > F.col("a"))
    return (later.groupBy("id", "th")
            .agg(F.collect_set(F.struct("first", "last")).alias("runs")))


def _powers(step: int, n: int) -> np.ndarray:
    """1, step, step**2, ... mod 2**64; short ones are kept by the worker."""
    def power(m: int) -> np.ndarray:
        out = np.full(m, step, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    if n > KEPT_POWERS:
        return power(n)
    if step not in _KEPT:
        _KEPT[step] = power(KEPT_POWERS)
    return _KEPT[step][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolling(values: np.ndarray, step: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of values[lo:hi], alike wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(step, len(values)), out=sums[1:])
    return _mixed((sums[hi] - sums[lo]) * _powers(pow(step, -1, 1 << 64), len(values))[lo])


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of neighbouring texts, text k being data[cuts[k]:cuts[k + 1]], and the
    place of every text's first word (and the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    first = cuts[:-1][cuts[:-1] < len(data)]
    begins[first] = inside[first]                          # a text's end ends a word
    ends = inside[:-1].copy()
    ends[:-1] &= ~inside[1:-1]
    last = cuts[1:][cuts[1:] > 0] - 1
    ends[last] = inside[last]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return _rolling(BYTE_VALUES[data], BYTE_STEP, lo, hi), np.searchsorted(lo, cuts)


def word_runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    at = np.arange(max(len(words) - size + 1, 0))
    return _rolling(words, WORD_STEP, at, at + size)


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x, size = op(x[:-size], x[size:]), 2 * size
    return op(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def gram_words(min_words: int) -> int:
    """Words of a hashed unit: the next fingerprint begins in it or right behind it."""
    return min_words // 2 + 1


def fingerprints(words: np.ndarray, cuts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the least units of every run of ``min_words`` words inside a
    text; ``cuts`` are the texts' first words and the end."""
    gram = gram_words(min_words)
    grams, width = word_runs(words, gram), min_words - gram + 1
    if len(words) < min_words:
        return grams[:0], np.zeros(0, np.int64)
    least = _sliding(np.minimum, grams, width)
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    least[text[:len(least)] != text[min_words - 1:]] = 0   # runs over two texts select nothing
    at = np.flatnonzero(_sliding(np.maximum, np.pad(least, width - 1), width) == grams)
    return grams[at], at


def _groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, cuts) of neighbouring texts, GROUP_BYTES and one text at most."""
    offsets = texts.offsets.to_numpy() if hasattr(texts, "offsets") else np.frombuffer(
        texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1].astype(np.int64) - offsets[row]
        row = end


def _hash_table(docs: DataFrame, names: list[str], of) -> DataFrame:
    """(id, th, hash, position) rows that ``of(word hashes, cuts)`` gives; docs has (id, th, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, ends in _groups(b.column(2).cast(pa.binary())):
                words, cuts = word_hashes(data, ends)
                h, at = of(words, cuts)
                text = np.searchsorted(cuts, at, "right") - 1
                take = pa.array(row + text)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)),
                     pa.array((at - cuts[text]).astype(np.int32))], ["id", "th", *names])

    return docs.select("id", "th", F.encode("text", "UTF-8").alias("text")).mapInArrow(
        run, f"id {kind}, th long, {names[0]} long, {names[1]} int")


class HashFilter:
    """Bounded approximate set of 64-bit hashes: false hits, never false misses.  A hash
    sets two bits of one word; the top bits are left alone: fingerprints are minima, so
    those are mostly zero."""

    def __init__(self, hashes: DataFrame):
        (name,) = hashes.columns
        n = hashes.count()
        self.bits = min(FILTER_BITS, max(10, math.ceil(math.log2(max(n, 1))) + 2))    # 4 words a key and more
        word = F.col(name).bitwiseAND(F.lit((1 << self.bits) - 1))
        mask = F.expr(f"bit_or(shiftleft(1L, CAST(shiftright({name}, 40) & 63 AS INT)) "
                      f"| shiftleft(1L, CAST(shiftright({name}, 46) & 63 AS INT)))")
        got = hashes.groupBy(word.alias("word")).agg(mask.alias("mask")).toArrow()    # 16 bytes a word, no row objects
        self.masks = np.zeros(1 << self.bits, np.uint64)
        self.masks[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)

    def hits(self, h: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        both = one << (h >> np.uint64(40) & low) | one << (h >> np.uint64(46) & low)
        return self.masks[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)] & both == both


def _later(table: DataFrame, key: str) -> DataFrame:
    """Rows of (id, th, key, at) behind the first place of their key, which is ``first``."""
    place = F.struct("id", "th", "at")
    first = table.groupBy(key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return table.join(first, key).where(place > F.col("first"))


def _chains(later: DataFrame, min_words: int) -> DataFrame:
    """(id, th, lo, hi, fp): words [lo, hi) that stand in an earlier text, ``fp`` null; or a
    chain's first fingerprint (``lo`` = -1) whose words before are open, or its last
    (``lo`` = 1) whose words behind are; every other run of ``min_words`` words that holds
    one of its fingerprints lies in the chain or holds its first or last one so."""
    kind, gram = later.schema["id"].dataType.simpleString(), gram_words(min_words)
    reach = min_words - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(2)
            doc = np.repeat(np.arange(b.num_rows), np.diff(marks.offsets.to_numpy()))
            at, text, offset, fp = (marks.flatten().field(n).to_numpy().astype(np.int64) for n in range(4))
            order = np.lexsort((at, doc))
            doc, at, text, offset, fp = (x[order] for x in (doc, at, text, offset, fp))
            place = (doc << 31) + at                       # one line of places for all texts of the batch
            cut = np.r_[True, (place[1:] - place[:-1] > gram) | (text[1:] != text[:-1]) | (offset[1:] != offset[:-1])]
            begin = np.flatnonzero(cut)[:len(at)]
            end = np.r_[begin[1:], len(at)] - 1
            long = place[end] + gram - place[begin] >= min_words
            lo, hi, owner = place[begin][long], place[end][long] + gram, doc[begin][long]
            reached = np.maximum.accumulate(hi) if len(hi) else hi
            new = np.flatnonzero(np.r_[True, lo[1:] > reached[:-1]])[:len(lo)]
            low, high = lo[new], reached[np.r_[new[1:], len(lo)] - 1] if len(lo) else hi
            before, behind = place[begin], place[end]
            edges = np.r_[before, behind]
            start = np.r_[np.maximum(doc[begin] << 31, before - reach), np.maximum(doc[end] << 31, behind - reach + 1)]
            stop = np.r_[before - 1, behind] + min_words
            inside = np.searchsorted(low, start, "right") - 1
            open_ = (inside < 0) | (high[inside] < stop) if len(low) else np.ones(len(edges), bool)
            side = np.r_[np.full(len(before), -1), np.full(len(behind), 1)][open_]
            holder, asked = np.r_[doc[begin], doc[end]][open_], np.r_[fp[begin], fp[end]][open_]
            runs = pa.array(np.r_[owner, holder])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(runs), b.column(1).take(runs),
                 pa.array(np.r_[lo & (1 << 31) - 1, side].astype(np.int32)),
                 pa.array([*(hi - (owner << 31)).tolist(), *[None] * len(side)], pa.int32()),
                 pa.array([*[None] * len(lo), *asked.tolist()], pa.int64())], ["id", "th", "lo", "hi", "fp"])

    marks = F.collect_set(F.struct("at", F.xxhash64("first.id", "first.th").alias("text"),
                                   (F.col("at") - F.col("first.at")).alias("offset"), "fp"))
    return (later.groupBy("id", "th").agg(marks.alias("marks"))
            .mapInArrow(run, f"id {kind}, th long, lo int, hi int, fp long"))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): the word ranges (lo, hi) that lie in runs of ``min_words`` repeated words."""
    reach = min_words - gram_words(min_words)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("th"),
                       text_of(text_col).alias("text"))
    table = materialize(_hash_table(base, ["fp", "at"], lambda words, cuts: fingerprints(words, cuts, min_words)))
    shared = materialize(table.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    marks = _in_filter(table, HashFilter(shared))
    found = materialize(_chains(_later(marks, "fp"), min_words))
    asked = found.where("fp IS NOT NULL")
    first, last = (HashFilter(asked.where(F.col("lo") == side).select("fp").distinct()) for side in (-1, 1))

    def around(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, at = fingerprints(words, cuts, min_words)
        starts = [(at[keys.hits(h)][:, None] - np.arange(reach) - away).ravel() for keys, away in ((first, 1), (last, 0))]
        at = np.unique(np.concatenate(starts))
        at = at[(at >= 0) & (at + min_words <= len(words))]
        text = np.searchsorted(cuts, at, "right") - 1
        at = at[at + min_words <= cuts[text + 1]]
        return _rolling(words, WORD_STEP, at, at + min_words), at

    # Only texts that hold an asked fingerprint (or a false hit) are hashed again.
    holders = probe(table.select("fp", "th"), bit_filter(asked.select("fp").distinct()), ["fp"]).select("th").distinct()
    live = materialize(_hash_table(probe(base, bit_filter(holders), ["th"]), ["wh", "at"], around))
    ends = _later(live, "wh").select("id", "th", F.col("at").alias("lo"), (F.col("at") + min_words).alias("hi"))
    runs = materialize(found.where("fp IS NULL").select("id", "th", "lo", "hi").unionByName(ends)
                       .groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")))
    discard(table, shared, found, live)
    return runs


def _in_filter(table: DataFrame, keys: HashFilter) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keys.hits(b.column("fp").to_numpy().view(np.uint64))))

    return table.mapInArrow(run, table.schema)


def _without_words(text: str, lo: np.ndarray, hi: np.ndarray) -> str:
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    turns = np.flatnonzero(np.diff(~IS_SPACE[data], prepend=False, append=False))
    begins, ends = turns[::2], turns[1::2]
    edge = np.zeros(len(begins) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    goes = np.cumsum(edge)[:-1] > 0
    gone_before = np.concatenate([[0], np.cumsum(goes)])
    at = np.r_[0, np.flatnonzero(data == 10) + 1, len(data) + 1]
    upto = np.searchsorted(begins, at)                     # words that begin before each line
    lost = gone_before[upto[1:]] - gone_before[upto[:-1]]
    out, gone = [], False
    for begin, end, first, w, less in zip(at.tolist(), (at[1:] - 1).tolist(), upto.tolist(), upto[1:].tolist(),
                                          lost.tolist()):
        if w > first:                                      # blank lines follow the line before
            gone = less == w - first
        if not less and not gone:
            out.append(raw[begin:end])
        elif not gone:
            stay, parts = np.flatnonzero(~goes[first:w]) + first, []
            for run in np.split(stay, np.flatnonzero(np.diff(stay) > 1) + 1):
                parts.append(raw[begin if run[0] == first else begins[run[0]]:end if run[-1] == w - 1 else ends[run[-1]]])
            out.append(b" ".join(parts))
    return b"\n".join(out).decode()


def _without(text: str, first: np.ndarray, last: np.ndarray) -> str:
    lines = text.split("\n")
    edge = [0] * (len(lines) + 1)
    for a, b in zip(first, last):
        edge[a] += 1
        edge[b + 1] -= 1
    out, depth, gone = [], 0, False
    for line, step in zip(lines, edge):
        depth += step
        if line.encode().split():                          # blank lines follow the line before
            gone = depth > 0
        if not gone:
            out.append(line)
    return "\n".join(out)


def _with_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int, inside_lines: bool) -> DataFrame:
    """(_row, _text): every row of ``docs`` and the text that stays of it.  Only rows that may
    have runs (a bounded bit filter of their keys) are shuffled to them."""
    find, less, begin, end = ((repeated_words, _without_words, "lo", "hi") if inside_lines
                              else (repeated_lines, _without, "first", "last"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else less(t, a, b) for t, a, b in zip(text, begins, ends)], dtype=object)

    runs = materialize(find(docs, id_col, text_col, min_words))
    keys = bit_filter(runs.select("id", "th"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                       F.xxhash64(text_of(text_col)).alias("_th"))
    hit = (F.col("_id").eqNullSafe(F.col("id"))) & (F.col("_th") == F.col("th"))
    text = F.col(f"_row.`{text_col}`").cast("string")
    joined = probe(rows, keys, ["_id", "_th"]).join(runs, hit, "left").select(
        "_row", cut(text, F.col(f"runs.{begin}"), F.col(f"runs.{end}")).alias("_text"))
    return joined.unionByName(probe(rows, keys, ["_id", "_th"], hit=False).select("_row", text.alias("_text")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_words: int = MIN_WORDS, inside_lines: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from the texts."""
    out = _with_runs(docs, id_col, text_col, min_words, inside_lines)
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`")
                        for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, inside_lines: bool = False) -> DataFrame:
    """One row per input row: id, n_lines, kept_lines, kept_sha256 (of the text that stays)."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = _with_runs(named, "id", "text", min_words, inside_lines).select(
        "_row.id", F.col("_row.text").alias("old"), F.col("_text").alias("text"))
    n_lines = lambda c: (F.length(text_of(c)) - F.length(F.replace(text_of(c), F.lit("\n"))) + 1)
    return out.select(F.col("id").alias(id_col), n_lines("old").cast("long").alias("n_lines"),
                      F.when(F.col("text") == F.col("old"), n_lines("old"))
                      .when(F.col("text") == "", 0).otherwise(n_lines("text")).cast("long").alias("kept_lines"),
                      F.sha2(text_of("text"), 256).alias("kept_sha256"))

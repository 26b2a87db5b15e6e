"""Packing documents into token sequences by order-preserving dynamic programming.

Each task packs the documents of its partition in their order.  Window cuts may fall
at document ends (free), sentence ends (``SENTENCE_COST``) and, in long stretches
without either, every ``HARD_STEP`` tokens (``HARD_COST``).  The cost of a window is
its padding; as padding is linear in the two cuts, the best cut before each place is
the minimum of one key over the last ``length`` tokens, kept in a monotone queue.
The last window of a block of ``BLOCK`` tokens is carried into the next, so a task
holds one block and one document; what is left at the end of a partition goes into
sequences whose lengths are powers of two, which need no padding.

Tokens come from a fixed vocabulary file.  Its pre-tokenizer drops white space and
never joins words, so a text's ids are those of its words, looked up in a bounded
cache; a text that spells out one of the vocabulary's added tokens goes whole through
the tokenizer.  Nothing is shuffled; a retried task gives the same pieces.

Defined results: null text equals empty text, which is the end id alone; null and
repeated ids are ordinary documents; an empty table gives an empty result; other
columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import text_of

LENGTH = 4096
END_ID = 2
BLOCK = 1 << 20
SENTENCE_COST = 32
HARD_COST = 256
HARD_STEP = 256
CACHE_WORDS = 1 << 20
# What ends a sentence in the vocabulary's words.
MARKS = ".,;:!?"
PLAIN = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]*")
STOPS = (".", "!", "?", "…", "。", "！", "？")


class WordIds:
    """ids (little-endian uint32 bytes) of whole texts, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.literal = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")
        vocab = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        self.closes = np.zeros(len(self.stops), bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.stops[[i for w, i in vocab.items() if w.removesuffix("</w>").endswith(STOPS)]] = True

    def __call__(self, text: bytes) -> bytes:
        if self.literal.search(decoded := text.decode()):     # one id of its own, across words too
            ids = self.tokenizer.encode(decoded, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        words = text.split()
        parts = list(map(self.known.get, words))
        if None in parts:
            at = list(compress(count(), map(is_, parts, repeat(None))))
            new = list({words[i] for i in at})
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
            self._learn([w.decode() for w in new], new)
            for i in at:
                parts[i] = self.known[words[i]]
        return b"".join(parts)

    def _learn(self, words: list[str], keys: list[bytes]) -> None:
        """Plain words are encoded as one text and parted where their pre-tokens close (a
        run of letters, a run of marks); others, or all if the closes differ, one by one."""
        plain = [i for i, m in enumerate(map(PLAIN.fullmatch, words)) if m]
        taken = [words[i] for i in plain]
        text = " ".join(taken)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        last = np.cumsum([1 + (w[-1] in MARKS) for w in taken], dtype=np.int64) - 1
        if len(plain) and (len(ends) != last[-1] + 1 or ends[-1] != len(ids)):
            plain, last = [], last[:0]
        cuts, data = [0, *(4 * ends[last]).tolist()], ids.tobytes()
        self.known.update((keys[i], data[a:b]) for i, a, b in zip(plain, cuts, cuts[1:]))
        if len(plain) < len(words):
            rest = sorted(set(range(len(words))).difference(plain))
            got = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
            self.known.update((keys[i], np.array(e.ids, "<u4").tobytes()) for i, e in zip(rest, got))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    return WordIds(path)


def window_cuts(places: list[int], costs: list[int], length: int) -> list[int]:
    """Cuts of least total padding and cutting cost; ``places`` ascend from 0, less than
    ``length`` apart, and end with the end of the tokens."""
    best, prev, queue = [0], [0], deque([(0, 0)])           # queue: (cost + place, index)
    for j in range(1, len(places)):
        at = places[j]
        while places[queue[0][1]] < at - length:
            queue.popleft()
        key, i = queue[0]
        key += length + costs[j]
        best.append(key - at)
        prev.append(i)
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = prev[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of possible cuts and their costs (the first place costs nothing)."""
    price = np.full(len(ids) + 1, -1)
    price[1:][stops[ids]] = SENTENCE_COST
    price[doc_ends] = 0
    price[0] = 0
    soft = np.flatnonzero(price >= 0)
    for i in np.flatnonzero(np.diff(soft) > HARD_STEP):
        price[soft[i] + HARD_STEP:soft[i + 1]:HARD_STEP] = HARD_COST
    places = np.flatnonzero(price >= 0)
    return places.tolist(), price[places].tolist()


class Packer:
    """Packs a stream of documents; ``rows`` collects the finished pieces."""

    def __init__(self, stops: np.ndarray, length: int, first_id: int):
        self.stops, self.length, self.sequence, self.rows = stops, length, first_id, []
        self.parts: list[tuple] = []          # (doc id, start, ids, doc tokens) not yet packed
        self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        data = np.frombuffer(ids, "<u4")
        self.parts.append((doc_id, 0, data, len(data)))
        self.held += len(data)
        if self.held >= BLOCK:
            ends = np.cumsum([len(p[2]) for p in self.parts])
            ids = np.concatenate([p[2] for p in self.parts])
            self._emit(window_cuts(*candidates(ids, ends, self.stops), self.length)[:-1])

    def finish(self) -> None:
        if self.held > self.length:
            ends = np.cumsum([len(p[2]) for p in self.parts])
            ids = np.concatenate([p[2] for p in self.parts])
            self._emit(window_cuts(*candidates(ids, ends, self.stops), self.length)[:-1])
        cuts = [0]
        while cuts[-1] < self.held:
            cuts.append(cuts[-1] + (1 << (self.held - cuts[-1]).bit_length() - 1))
        self._emit(cuts[1:])

    def _emit(self, cuts: list[int]) -> None:
        at, parts = 0, deque(self.parts)
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, start, ids, total = parts[0]
                n = min(len(ids), cut - at)
                self.rows.append((doc_id, start, n, zlib.crc32(ids[:n].tobytes()), total, self.sequence, offset))
                at, offset = at + n, offset + n
                if n == len(ids):
                    parts.popleft()
                else:
                    parts[0] = (doc_id, start + n, ids[n:], total)
            self.sequence += 1
        self.parts, self.held = list(parts), self.held - at


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        packer = Packer(words.stops, length, TaskContext.get().partitionId() << 33)

        def done(id_type):
            cols = list(zip(*packer.rows)) or [[]] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0), b.column(1)):
                packer.add(doc_id.as_py(), words(text.as_py()) + end)
            yield done(id_type)
        if id_type is not None:
            packer.finish()
            yield done(id_type)

    long = ", ".join(f"{n} long" for n in names[1:])
    return base.mapInArrow(run, f"id {kind}, {long}").withColumnRenamed("id", id_col)

"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a segment; dynamic
programming over end positions carries the best score and its piece count, no path.
Tie rule: of equal scores the earliest start (the longest piece) wins.  A character
that is no piece costs ``UNKNOWN_COST`` below the least score and counts as its UTF-8
bytes.  Segments begin at spaces and no piece spans a space, so a text's count is the
sum over its segments, which are looked up in a bounded cache.  The pieces and their
scores (whole numbers, so sums are exact) are read from a vocabulary file whose path
is a parameter; control and byte pieces get a score too low to match as plain text.

Texts are counted whole inside the tasks, without a shuffle.  Defined results: null
or empty text has no tokens and score 0; ids pass through as they are; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import text_of

SPACE_MARK = "▁"
UNKNOWN_COST = 10
NOT_TEXT = -2_000_000_000
CACHE_SEGMENTS = 1 << 19


def vocabulary(path: str) -> list[tuple[str, int]]:
    """(piece, score) by id."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), NOT_TEXT if p.is_control(i) or p.is_byte(i) or p.is_unknown(i)
             else int(p.get_score(i))) for i in range(p.get_piece_size())]


class Counter:
    """(pieces, score) of whole texts."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        self.known: dict[str, tuple[int, int]] = {}

    def segment(self, text: str) -> tuple[int, int]:
        n = len(text)
        ending: list[list] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text):      # longest first at every end
            ending[last + 1].append(match)
        score, count = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best = None
            single = False
            for length, s in ending[end]:
                single |= length == 1
                total = score[end - length] + s
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def __call__(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        text = text.replace(" ", SPACE_MARK)
        parts = text.removeprefix(SPACE_MARK).split(SPACE_MARK)
        new = set(parts).difference(self.known)
        if len(self.known) + len(new) > CACHE_SEGMENTS:
            self.known.clear()
            new = set(parts)
        self.known.update((p, self.segment(SPACE_MARK + p)) for p in new)
        got = [self.known[p] for p in parts]
        return sum(c for c, _ in got), sum(s for _, s in got)


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, score."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(vocabulary_path))
        for b in batches:
            got = [counter(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([s for _, s in got], pa.int64())],
                ["id", "n_tokens", "score"])

    return base.mapInArrow(run, f"id {kind}, n_tokens long, score long").withColumnRenamed("id", id_col)

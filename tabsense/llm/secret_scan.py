"""Secret scan: one pass over the bytes of a text with one automaton for all rules.

The combined minimal automaton marks, byte by byte, which rules have a match that
ends there; where a base rule stops accepting, the reversed rule's automaton walks back
to the leftmost start not before the rule's last match.  Rules with long counted or
open runs would multiply each other's states in one automaton, so of the added rules it
holds the fixed leading part; where that ends, the rule's own automaton walks on to the
longest match.  Walks that fail are remembered by place and state, so that no text is
walked more than once per state.  That gives the leftmost non-overlapping matches of
every rule.  Only the marked places of a text are looked at again.  Texts are scanned
whole inside the tasks, without a shuffle; the automata are compiled once on the driver
(their size depends on the rules alone).

Defined results: null or empty text has no spans; offsets are code points, end
exclusive; a null id is passed through; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.automaton import Machine, chars, compile_rules, literal, reverse
from tabsense.llm.common import text_of

BASE = ("assign", "access", "hex")
VALUE = chars("A-Za-z0-9+/_.=") | {ord("-")}
_QUOTE, _SPACE = frozenset(b"\"'"), frozenset(b" ")
_ALNUM = chars("A-Za-z0-9")
_URL = _ALNUM | frozenset(b"_-")

# Kinds in the order in which spans at one place are listed.  Short
# assigned values and access keys are dropped after matching; a short run of hex digits
# never accepts, which changes no other match.  Added rules begin with items of fixed
# length that never end at two places in a row.
RULES = {
    "assign": [[*literal(w, any_case=True), *under, *literal(end, any_case=True), (_QUOTE, 0, 1),
                (_SPACE, 0, None), (frozenset(b":="), 1, 1), (_SPACE, 0, None), (_QUOTE, 0, 1),
                (VALUE, 1, None)]
               for w, under, end in (("password", [], ""), ("passwd", [], ""), ("secret", [], ""),
                                     ("token", [], ""), ("api", [(frozenset(b"_"), 0, 1)], "key"))],
    "access": [[*literal("AKIA"), (chars("A-Z0-9"), 1, None)]],
    "hex": [[(chars("0-9a-f"), 24, None)]],
    "github": [[*literal("gh"), (chars("pousr"), 1, 1), *literal("_"), (_ALNUM, 36, None)]],
    "slack": [[*literal("xox"), (chars("abprs"), 1, 1), *literal("-"), (_ALNUM | frozenset(b"-"), 10, None)]],
    "google": [[*literal("AIza"), (_URL, 35, None)]],
    "jwt": [[*literal("eyJ"), (_URL, 8, None), *literal("."), *literal("eyJ"), (_URL, 8, None),
             *literal("."), (_URL, 8, None)]],
    "pem": [[*literal("-----BEGIN "), (chars("A-Z "), 0, None), *literal("PRIVATE KEY-----")]],
}
MIN_VALUE, MIN_ACCESS = 6, 20


def _lead(items: list) -> list:
    """The leading items of fixed length."""
    n = next((i for i, (_, least, most) in enumerate(items) if least != most), len(items))
    return items[:n]


def compiled(rules: dict = RULES) -> tuple[list[str], Machine, list[Machine], list[int]]:
    """Kinds, the combined automaton, every kind's own (reversed for base kinds), and the
    length of the leading part of added kinds (0 for base kinds)."""
    kinds = list(rules)
    heads = [[_lead(items) for items in rules[k]] for k in kinds]
    lead = [0 if k in BASE else sum(least for _, least, _ in h[0]) for k, h in zip(kinds, heads)]
    return (kinds, compile_rules([h if n else rules[k] for k, h, n in zip(kinds, heads, lead)], anchored=False),
            [compile_rules([rules[k] if n else reverse(rules[k])], anchored=True) for k, n in zip(kinds, lead)],
            lead)


def _linked(machine: Machine) -> tuple[list, list]:
    """Rows that hold the next rows themselves; place 256 holds the marks."""
    rows = [[None] * 256 + [m] for m in machine.marks]
    for row, targets in zip(rows, machine.rows):
        row[:256] = [rows[t] for t in targets]
    return rows[0], rows


def _value_length(match: bytes) -> int:
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    value = match[at:].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def _long_enough(kind: str, match: bytes) -> bool:
    if kind == "assign":
        return _value_length(match) >= MIN_VALUE
    return kind != "access" or len(match) >= MIN_ACCESS


class Scanner:
    """The compiled automata, ready to run (built once per task)."""

    def __init__(self, kinds: list[str], forward: Machine, own: list[Machine], lead: list[int]):
        self.kinds, self.lead = kinds, lead
        self.start, self._rows = _linked(forward)
        self.own = [_linked(m) for m in own]
        self.leads = sum(1 << k for k, n in enumerate(lead) if n)
        self.dead = []
        for m, (_, rows) in zip(own, self.own):
            self.dead.append({id(rows[s]) for s, row in enumerate(m.rows)
                              if not m.marks[s] and all(t == s for t in row)})

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes, sorted."""
        row, on, found, failed = self.start, 0, [], set()
        last = [0] * len(self.kinds)
        for at, byte in enumerate(data):
            row = row[byte]
            marks = row[256]
            if marks != on:
                if ended := on & ~marks & ~self.leads:
                    self._close(data, ended, at, last, found)
                if begun := marks & ~on & self.leads:
                    self._follow(data, begun, at + 1, last, found, failed)
                on = marks
        if ended := on & ~self.leads:
            self._close(data, ended, len(data), last, found)
        return sorted(found)

    def _close(self, data, ended, end, last, found):
        """Base kinds: back from the end to the leftmost start."""
        for kind in range(len(self.kinds)):
            if not ended >> kind & 1:
                continue
            row, dead, start = self.own[kind][0], self.dead[kind], -1
            for at in range(end - 1, last[kind] - 1, -1):
                row = row[data[at]]
                if row[256]:
                    start = at
                elif id(row) in dead:
                    break
            if start < 0:
                continue
            last[kind] = end
            if _long_enough(self.kinds[kind], data[start:end]):
                found.append((start, kind, end))

    def _follow(self, data, begun, at, last, found, failed):
        """Added kinds: from the start of the leading part to the longest match."""
        for kind in range(len(self.kinds)):
            start = at - self.lead[kind]
            if not begun >> kind & 1 or start < last[kind]:
                continue
            row, dead, end, path = self.own[kind][0], self.dead[kind], -1, []
            for place in range(start, len(data)):
                row = row[data[place]]
                step = (place, id(row))
                if row[256]:
                    end = place + 1
                elif id(row) in dead or step in failed:
                    break
                elif end < 0:
                    path.append(step)
            if end < 0:
                failed.update(path)
            else:
                last[kind] = end
                found.append((start, kind, end))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: dict = RULES) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_secrets, base_sha256, spans."""
    automata = compiled(rules)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*automata)
        names = scanner.kinds
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for value in b.column(1):
                data = value.as_py()
                spans = scanner.spans(data)
                if spans and not data.isascii():
                    spans = [(len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in spans]
                texts = [(names[k], f"{names[k]}:{s}:{e}") for s, k, e in spans]
                own = [t for k, t in texts if k in BASE]
                for col, k in zip(cols, BASE):
                    col.append(sum(name == k for name, _ in texts))
                cols[3].append(len(texts))
                cols[4].append(hashlib.sha256(",".join(own).encode()).hexdigest())
                cols[5].append(",".join(t for _, t in texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()),
                 pa.array(cols[5], pa.string())],
                ["id", "n_assign", "n_access", "n_hex", "n_secrets", "base_sha256", "spans"])

    return (base.mapInArrow(scan, f"id {kind}, n_assign long, n_access long, n_hex long, n_secrets long, "
                                  "base_sha256 string, spans string")
            .withColumnRenamed("id", id_col))

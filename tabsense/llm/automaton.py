"""One minimal deterministic automaton for many byte patterns.

A rule is a sequence of items (byte set, least, most); ``most`` None means
unbounded.  All rules, each preceded by any bytes, are compiled together by subset
construction over byte classes and minimised by partition refinement.  A state's
output says which rules have a match ending there.  Per rule, a second automaton of
the reversed rule finds the leftmost start of a match that ends at a given place.

Rules must end in an unbounded run or in an item of fixed length, so that the
longest match from the leftmost start ends where the rule stops accepting.
"""
from __future__ import annotations

from dataclasses import dataclass

Item = tuple[frozenset, int, int | None]


def chars(text: str) -> frozenset:
    """Byte set written as in a bracket expression of single characters and ranges."""
    out, i = set(), 0
    while i < len(text):
        if i + 2 < len(text) and text[i + 1] == "-":
            out.update(range(ord(text[i]), ord(text[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(text[i]))
            i += 1
    return frozenset(out)


def literal(word: str, any_case: bool = False) -> list[Item]:
    return [(frozenset({ord(c.lower()), ord(c.upper())} if any_case else {ord(c)}), 1, 1) for c in word]


@dataclass
class Machine:
    rows: list          # rows[state][byte] is the next state
    marks: list         # marks[state]: bit mask of the rules that accept there


class _Nfa:
    def __init__(self):
        self.eps, self.moves, self.accept = [], [], {}

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def add(self, start: int, items: list[Item], rule: int) -> None:
        at = start
        for symbols, least, most in items:
            for _ in range(least):
                nxt = self.state()
                self.moves[at].append((symbols, nxt))
                at = nxt
            if most is None:
                loop = self.state()
                self.eps[at].append(loop)
                self.moves[loop].append((symbols, loop))
                at = loop
            else:
                ends = [at]
                for _ in range(most - least):
                    nxt = self.state()
                    self.moves[at].append((symbols, nxt))
                    at = nxt
                    ends.append(at)
                done = self.state()
                for e in ends:
                    self.eps[e].append(done)
                at = done
        self.accept[at] = self.accept.get(at, 0) | 1 << rule

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.eps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _byte_classes(sets: set) -> tuple[list[int], list[int]]:
    """Class of every byte, and one byte of every class."""
    ordered = list(sets)
    names: dict = {}
    of = [names.setdefault(tuple(b in s for s in ordered), len(names)) for b in range(256)]
    return of, [of.index(c) for c in range(len(names))]


def _minimise(rows: list[list[int]], marks: list[int]) -> tuple[list[list[int]], list[int], list[int]]:
    block = list(marks)
    names = {m: i for i, m in enumerate(dict.fromkeys(block))}
    block = [names[m] for m in block]
    while True:
        names = {}
        new = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(rows)]
        if len(names) == len(set(block)):
            break
        block = new
    first = {}
    for s, b in enumerate(block):
        first.setdefault(b, s)
    order = sorted(first, key=first.get)
    place = {b: i for i, b in enumerate(order)}
    return ([[place[block[t]] for t in rows[first[b]]] for b in order], [marks[first[b]] for b in order],
            [place[b] for b in block])


def compile_rules(rules: list[list[list[Item]]], anchored: bool) -> Machine:
    """Minimal automaton of all rules; a rule is a list of alternatives."""
    nfa = _Nfa()
    root = nfa.state()
    if not anchored:
        nfa.moves[root].append((frozenset(range(256)), root))
    for rule, alternatives in enumerate(rules):
        for items in alternatives:
            start = nfa.state()
            nfa.eps[root].append(start)
            nfa.add(start, items, rule)
    of, sample = _byte_classes({s for m in nfa.moves for s, _ in m})
    start = nfa.closure([root])
    index, rows, marks, todo = {start: 0}, [], [], [start]
    while todo:
        states = todo.pop(0)
        mark = 0
        for s in states:
            mark |= nfa.accept.get(s, 0)
        marks.append(mark)
        row = []
        for byte in sample:
            nxt = nfa.closure([t for s in states for symbols, t in nfa.moves[s] if byte in symbols])
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    rows, marks, _ = _minimise(rows, marks)
    return Machine([[row[of[b]] for b in range(256)] for row in rows], marks)


def reverse(alternatives: list[list[Item]]) -> list[list[Item]]:
    return [items[::-1] for items in alternatives]

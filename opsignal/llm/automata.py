"""Regular expressions as one deterministic automaton over bytes.

Every rule becomes an automaton by subset construction whose states keep their threads in the order of
their starts, so that it follows the leftmost match and begins anew where a match ends. The product of all
of them, minimised, is one transition array: one step a byte, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter
from re import _constants as op
from re import _parser as parser

import numpy as np

DEAD = 0
Threads = tuple[frozenset[int], ...]


@dataclass(frozen=True)
class Rule:
    """``pattern`` in ASCII; a match counts if its last part, from where the pattern can end, has ``tail`` bytes."""

    kind: str
    pattern: str
    tail: int = 1
    any_case: bool = False


class Nfa:
    """Thompson's construction: ``moves[s]`` is (set of bytes, next state), ``free[s]`` are the states reached without a byte."""

    def __init__(self, rule: Rule):
        self.any_case = rule.any_case
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.start = self._state()
        self.end = self._sequence(parser.parse(rule.pattern.encode()), self.start)

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _bytes(self, code, arg) -> frozenset[int]:
        if code is op.LITERAL:
            found = {arg}
        elif code is op.RANGE:
            found = set(range(arg[0], arg[1] + 1))
        elif code is op.IN:
            found = set().union(*(self._bytes(*x) for x in arg if x[0] is not op.NEGATE))
            if arg[0][0] is op.NEGATE:
                found = set(range(256)) - found
        else:
            raise ValueError(f"not supported in a rule: {code}")
        letters = {ord(x) for b in found if b < 128 for x in (chr(b).lower(), chr(b).upper())} if self.any_case else set()
        return frozenset(found | letters)

    def _sequence(self, items, at: int) -> int:
        for code, arg in items:
            at = self._one(code, arg, at)
        return at

    def _one(self, code, arg, at: int) -> int:
        if code is op.SUBPATTERN:
            return self._sequence(arg[-1], at)
        if code is op.BRANCH:
            out = self._state()
            for branch in arg[1]:
                self.free[self._sequence(branch, at)].append(out)
            return out
        if code is op.MAX_REPEAT:
            least, most, items = arg
            for _ in range(least):
                at = self._sequence(items, at)
            if most is op.MAXREPEAT:
                loop = self._state()
                self.free[at].append(loop)
                self.free[self._sequence(items, loop)].append(loop)
                return loop
            out = self._state()
            for _ in range(most - least):
                self.free[at].append(out)
                at = self._sequence(items, at)
            self.free[at].append(out)
            return out
        out = self._state()
        self.moves[at].append((self._bytes(code, arg), out))
        return out

    def closed(self, states, free) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def ahead(self, states, byte: int) -> frozenset[int]:
        return self.closed({t for s in states for found, t in self.moves[s] if byte in found}, self.free)

    def reversed(self) -> tuple[frozenset[int], Callable]:
        """Where a walk from the end to the start begins, and its step."""
        back = [[] for _ in self.moves]
        free = [[] for _ in self.moves]
        for s, moves in enumerate(self.moves):
            for found, t in moves:
                back[t].append((found, s))
            for t in self.free[s]:
                free[t].append(s)
        step = lambda states, byte: self.closed({t for s in states for found, t in back[s] if byte in found}, free)
        return self.closed({self.end}, free), step


def explored(first, step: Callable, inputs: list[int]) -> tuple[list, list[list[int]]]:
    """All states reachable from ``first`` and the number of the next state for each input."""
    states, number, table = [first], {first: 0}, []
    for state in states:
        row = []
        for x in inputs:
            after = step(state, x)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        table.append(row)
    return states, table


def leftmost(rule: Rule, nfa: Nfa) -> Callable[[Threads, int], Threads]:
    """The step of a rule's automaton. Threads are sets of states by their start, the oldest first.

    Once the oldest accepts, the younger ones go and no new one starts until it ends; the byte that ends it
    starts anew. That is the leftmost match, longest, only if no older thread is alive when one accepts and
    a thread that accepts goes on accepting; a rule that breaks this is refused.
    """
    fresh = nfa.closed({nfa.start}, nfa.free)
    accepts = lambda threads: bool(threads) and nfa.end in threads[0]
    if nfa.end in fresh:
        raise ValueError(f"{rule.kind}: the pattern matches nothing at all")

    def step(threads: Threads, byte: int) -> Threads:
        matching = accepts(threads)
        out, seen = [], set()
        for states in threads if matching else (*threads, fresh):
            after = nfa.ahead(states, byte) - seen
            if after:
                out.append(after)
                seen |= after
        if matching and out:
            if nfa.end not in out[0]:
                raise ValueError(f"{rule.kind}: a match may go on without being one")
            return tuple(out)
        if matching:
            out = [after] if (after := nfa.ahead(fresh, byte)) else []
            if accepts(out):
                raise ValueError(f"{rule.kind}: two matches may touch")
        if any(nfa.end in states for states in out[1:]):
            raise ValueError(f"{rule.kind}: an older start may still be open when a younger one matches")
        return (out[0],) if accepts(out) else tuple(out)

    return step


def byte_classes(nfas: list[Nfa]) -> tuple[bytes, list[int]]:
    """Class of each byte, and one byte of each class: bytes that no rule tells apart are one class."""
    sets = sorted({tuple(sorted(found)) for nfa in nfas for moves in nfa.moves for found, _ in moves})
    held = [frozenset(s) for s in sets]
    number, classes, first = {}, [], []
    for b in range(256):
        sign = tuple(b in s for s in held)
        if sign not in number:
            number[sign] = len(first)
            first.append(b)
        classes.append(number[sign])
    return bytes(classes), first


def minimised(table: np.ndarray, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least automaton with the same colours along every input; state 0 stays state 0."""
    part, count = colour, len(np.unique(colour))
    while True:
        _, part = np.unique(np.column_stack([part[:, None], part[table]]), axis=0, return_inverse=True)
        part = part.ravel()
        if part.max() + 1 == count:
            break
        count = part.max() + 1
    _, first = np.unique(part, return_index=True)
    order = np.argsort(first)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[part[table[first[order]]]], colour[first[order]]


class Automaton:
    """All rules as one table. ``scan`` gives (start, rule number, end) in bytes, by rule."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        nfas = [Nfa(r) for r in rules]
        self.classes, first = byte_classes(nfas)
        single = [explored((), leftmost(r, n), first) for r, n in zip(rules, nfas)]
        self.sizes = [len(states) for states, _ in single]
        tables = [t for _, t in single]
        inputs = range(len(first))
        states, table = explored((0,) * len(rules), lambda s, c: tuple(t[x][c] for t, x in zip(tables, s)), inputs)
        ends = [[bool(x) and n.end in x[0] for x in s] for (s, _), n in zip(single, nfas)]
        accepted = [tuple(e[x] for e, x in zip(ends, s)) for s in states]
        # symbol 0: nothing accepts
        symbols = sorted(set(accepted) | {(False,) * len(rules)})
        colour = np.array([symbols.index(a) for a in accepted])
        self.before = len(states)
        self.table, self.symbol = minimised(np.array(table), colour)
        if len(symbols) > 256:
            raise ValueError("more than 256 sets of rules that accept together")
        self.held = [bytes(i for i, s in enumerate(symbols) if s[r]) for r in range(len(rules))]
        self.back = [explored(begin, step, first) for begin, step in (n.reversed() for n in nfas)]
        self.begins = [[n.start in s for s in states] for (states, _), n in zip(self.back, nfas)]
        self.back = [table for _, table in self.back]
        self.dead = [next((i for i, row in enumerate(t) if set(row) == {i} and not b[i]), -1) for t, b in zip(self.back, self.begins)]
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def _ready(self) -> None:
        """The table as lists that point to each other, with the symbol at the end of each: built once a process."""
        rows = [[] for _ in self.table]
        for row, after, symbol in zip(rows, self.table.tolist(), self.symbol.tolist()):
            row.extend(rows[x] for x in after)
            row.append(symbol)
        of = lambda symbols, least: b"[" + b"".join(re.escape(bytes([s])) for s in symbols) + b"]{%d,}" % least
        self._runs = [re.compile(of(h, r.tail)) for h, r in zip(self.held, self.rules)]
        # a text without any of these needs no second look
        self._any = re.compile(b"|".join(of(h, r.tail) for h, r in zip(self.held, self.rules)))
        self._sets = [frozenset(h) for h in self.held]
        self._symbol = itemgetter(len(self.table[0]))
        self._rows = rows

    def scan(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        if self._rows is None:
            self._ready()
        trace = bytes(map(self._symbol, accumulate(data.translate(self.classes), getitem, initial=self._rows[0])))
        if not self._any.search(trace):
            return
        for r, runs in enumerate(self._runs):
            for run in runs.finditer(trace):
                # trace[i + 1] is the symbol after byte i
                yield self._start(r, data, trace, run.start() - 1), r, run.end() - 1

    def _start(self, r: int, data: bytes, trace: bytes, last: int) -> int:
        """The leftmost start of the match of rule ``r`` that first accepts at byte ``last``, back to its last match."""
        table, begins, dead, held, classes = self.back[r], self.begins[r], self.dead[r], self._sets[r], self.classes
        state, found, i = 0, last, last
        while i >= 0 and state != dead and (i == last or trace[i + 1] not in held):
            state = table[state][classes[data[i]]]
            if begins[state]:
                found = i
            i -= 1
        return found

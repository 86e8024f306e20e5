"""Regular expressions over bytes as minimal deterministic automata.

A pattern is read by Python's own parser, made into states with empty moves, and
these into sets of states (subset construction) over classes of bytes that no
pattern tells apart. Moore's refinement then joins states that no input tells
apart. What is left is one flat transition array.

Patterns are ASCII: literals, classes, groups, alternatives, ``? * + {m,n}`` and
``(?i:...)`` for ASCII letters. A match is the longest one, so greedy and lazy
repeats are the same; look-around, anchors, back references and negated classes
are an error.
"""

from __future__ import annotations

from re import IGNORECASE
from re import _constants as C
from re import _parser as parser

import numpy as np


class Moves:
    """States with moves on sets of bytes and empty moves."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.empty) - 1

    def read(self, items, start: int, backward: bool, fold: bool = False) -> int:
        """Add a parsed pattern from ``start`` on; its last state. backward: for
        texts that are read from their end."""
        at = start
        for op, arg in (reversed(list(items)) if backward else items):
            if op in (C.LITERAL, C.IN):
                to = self.state()
                self.on[at].append((bytes_of(op, arg, fold), to))
                at = to
            elif op is C.SUBPATTERN:
                _, add, remove, inner = arg
                at = self.read(inner, at, backward, (fold or bool(add & IGNORECASE)) and not remove & IGNORECASE)
            elif op is C.BRANCH:
                to = self.state()
                for inner in arg[1]:
                    self.empty[self.read(inner, at, backward, fold)].append(to)
                at = to
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, inner = arg
                for _ in range(least):
                    at = self.read(inner, at, backward, fold)
                if most is C.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.empty[at].append(loop)
                    self.empty[self.read(inner, loop, backward, fold)].append(loop)
                    self.empty[loop].append(end)
                    at = end
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(end)
                        at = self.read(inner, at, backward, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"{op} is not supported in a rule")
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def bytes_of(op, arg, fold: bool) -> frozenset:
    found = set()
    for kind, x in [(op, arg)] if op is C.LITERAL else arg:
        if kind is C.LITERAL:
            found.add(x)
        elif kind is C.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"{kind} is not supported in a rule")
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {ord(c) for x in found if chr(x).isalpha() for c in (chr(x).lower(), chr(x).upper())}
    return frozenset(found)


class Automaton:
    """A minimal automaton for several patterns at once.

    classes: byte -> class, for bytes.translate. table[state + class] is the next
    state; states are multiples of the number of classes. States from ``accepting``
    on accept, and accepts[state] is a bit set of the patterns that end there.
    dead: the state that nothing leaves and that does not accept, or -1.
    """

    def __init__(self, patterns: list[str], backward: bool = False, anywhere: bool = False):
        """anywhere: a match may begin at every byte, not at the first one only."""
        moves = Moves()
        begin = moves.state()
        ends = {moves.read(parser.parse(p), begin, backward): 1 << k for k, p in enumerate(patterns)}
        member = np.zeros((256, 0), bool)
        for s in {s for on in moves.on for s, _ in on}:
            col = np.zeros((256, 1), bool)
            col[sorted(s)] = True
            member = np.hstack([member, col])
        _, first, which = np.unique(member, axis=0, return_index=True, return_inverse=True) if member.shape[1] else (None, np.array([0]), np.zeros(256, int))
        which, width = which.reshape(-1), len(first)

        start = moves.closure([begin])
        known, order, rows = {start: 0}, [start], []
        for states in order:  # grows as it goes
            row = []
            for b in first.tolist():
                to = moves.closure({t for s in states for on, t in moves.on[s] if b in on}) | (start if anywhere else frozenset())
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to])
            rows.append(row)
        step = np.array(rows)
        mask = [sum(bit for s, bit in ends.items() if s in states) for states in order]

        label, n = np.unique(mask, return_inverse=True)[1], 0
        while n != label.max() + 1:  # until no step divides a group of states any more
            n = label.max() + 1
            label = np.unique(np.hstack([label[:, None], label[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        of = {g: i for i, g in enumerate(label.tolist())}  # one state of each group
        groups = sorted(of, key=lambda g: (mask[of[g]] != 0, g))
        number = {g: i * width for i, g in enumerate(groups)}
        self.classes = bytes(which.astype(np.uint8).tolist())
        self.table = [number[g] for x in groups for g in label[step[of[x]]].tolist()]
        self.accepts = {number[g]: mask[of[g]] for g in groups}
        self.accepting = min((s for s, m in self.accepts.items() if m), default=len(self.table))
        self.start = number[int(label[0])]
        self.states = len(groups)
        self.dead = next((s for s, m in self.accepts.items() if not m and set(self.table[s:s + width]) == {s}), -1)

    def longest(self, data: bytes, at: int) -> int:
        """Where the longest match from ``at`` on ends, or -1. data: classes of bytes."""
        s, end, table, dead = self.start, at if self.start >= self.accepting else -1, self.table, self.dead
        for k in range(at, len(data)):
            s = table[s + data[k]]
            if s >= self.accepting:
                end = k + 1
            elif s == dead:
                break
        return end

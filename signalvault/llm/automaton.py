"""Deterministic automata over bytes: subset construction, minimisation, transition arrays."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, items, start: int, fold: bool = False, back: bool = False) -> int:
        """Adds a parsed pattern, read from its end with ``back``, after ``start``; returns its last state."""
        for kind, value in list(items)[::-1] if back else items:
            if kind in (op.LITERAL, op.IN, op.ANY, op.NOT_LITERAL):
                end = self.state()
                self.step[start].append((_bytes(kind, value, fold), end))
            elif kind is op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, start, fold, back)].append(end)
            elif kind is op.SUBPATTERN:
                end = self.add(value[3], start, fold or bool(value[1] & re.IGNORECASE), back)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                least, most, body = value
                end = start
                for _ in range(least):
                    end = self.add(body, end, fold, back)
                if most is op.MAXREPEAT:
                    loop = self.state()
                    self.free[end].append(loop)
                    self.free[self.add(body, loop, fold, back)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    self.free[end].append(out)
                    for _ in range(most - least):
                        end = self.add(body, end, fold, back)
                        self.free[end].append(out)
                    end = out
            else:
                raise ValueError(f"{kind} is not supported in a rule")
            start = end
        return start

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(kind, value, fold: bool) -> frozenset[int]:
    if kind is op.LITERAL:
        out = {value}
    elif kind is op.NOT_LITERAL:
        out = set(range(256)) - {value}
    elif kind is op.ANY:
        out = set(range(256)) - {10}
    else:
        out, negate = set(), False
        for k, v in value:
            if k is op.NEGATE:
                negate = True
            elif k is op.LITERAL:
                out.add(v)
            elif k is op.RANGE:
                out.update(range(v[0], v[1] + 1))
            else:
                raise ValueError(f"{k} is not supported in a rule")
        if negate:
            out = set(range(256)) - out
    if any(b > 255 for b in out):
        raise ValueError("rules are over bytes")
    if fold:
        out |= {b ^ 32 for b in out if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(out)


class Automaton:
    """``table[state, byte class]`` -> state, ``accepts[state]`` -> bits of the patterns that end there.

    State 0 is the start. A searching automaton begins a match at every byte; an anchored one only at its first
    byte, and its state ``dead`` is left no more (-1 for a searching one). With ``back`` it reads text from its end:
    a searching one then accepts at the bytes where matches start.
    """

    def __init__(self, patterns: list[str], search: bool, back: bool = False) -> None:
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for i, pattern in enumerate(patterns):
            first = nfa.state()
            nfa.free[start].append(first)
            ends.setdefault(nfa.add(parser.parse(pattern), first, back=back), i)
        sets = {s for edges in nfa.step for s, _ in edges}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        number = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([number[s] for s in signature], np.uint8)
        sample = [signature.index(s) for s in number]
        begin = nfa.closure([start])
        known, todo, rows = {begin: 0}, [begin], []
        while todo:
            states = todo.pop(0)
            row = []
            for byte in sample:
                after = {t for s in states for b, t in nfa.step[s] if byte in b}
                target = nfa.closure(after | {start} if search else after)
                if target not in known:
                    known[target] = len(known)
                    todo.append(target)
                row.append(known[target])
            rows.append(row)
        bits = [sum(1 << i for s, i in ends.items() if s in states) for states in known]
        self.table, self.accepts = _minimal(np.array(rows, np.int64), np.array(bits, np.int64))
        self.dead = -1
        if not search:
            still = [(self.table[s] == s).all() and not self.accepts[s] for s in range(len(self.table))]
            self.dead = still.index(True) if True in still else -1
        back = (self.table == 0).all(axis=0)
        self.resets = back[self.classes]
        """Bytes that lead to the start from every state."""
        self.flat = np.ascontiguousarray(self.table).ravel()

    def lists(self) -> tuple[list[list[int]], list[int], list[int]]:
        return self.table[:, self.classes].tolist(), self.accepts.tolist(), []


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: states are one while their outputs and the blocks they lead to are equal."""
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        after = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if after.max() == block.max():
            break
        block = after
    order = {}
    for b in block.tolist():  # the block of the start comes first
        order.setdefault(b, len(order))
    block = np.array([order[b] for b in block.tolist()])
    first = np.array([int(np.argmax(block == b)) for b in range(len(order))])
    return block[table[first]], accepts[first]

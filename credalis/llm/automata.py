"""Rule patterns to one deterministic automaton: subset construction, product, minimisation.

Patterns: literals, classes ``[a-z0-9]``, escapes ``\\x20``, groups, ``|``, and the repeats
``? * + {m} {m,n}``; all repeats take as much as they can.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from credalis.llm.lanes import BREAK, Automaton


class _Nfa:
    """States with byte-set arcs and free moves."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def closed(self, states: tuple[int, ...]) -> tuple[int, ...]:
        out: dict[int, None] = {}
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s not in out:
                out[s] = None
                stack.extend(reversed(self.free[s]))
        return tuple(out)


class _Parser:
    """Builds fragments (first state, last state) from a pattern, forwards or reversed."""

    def __init__(self, pattern: str, any_case: bool, backwards: bool) -> None:
        self.text, self.at, self.any_case, self.backwards = pattern, 0, any_case, backwards
        self.nfa = _Nfa()

    def build(self) -> tuple[_Nfa, int, int]:
        first, last = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return self.nfa, first, last

    def choice(self) -> tuple[int, int]:
        options = [self.sequence()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            options.append(self.sequence())
        if len(options) == 1:
            return options[0]
        first, last = self.nfa.state(), self.nfa.state()
        for a, b in options:
            self.nfa.free[first].append(a)
            self.nfa.free[b].append(last)
        return first, last

    def sequence(self) -> tuple[int, int]:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self.repeat())
        if not parts:
            s = self.nfa.state()
            return s, s
        if self.backwards:
            parts.reverse()
        for (_, b), (c, _) in zip(parts, parts[1:], strict=False):
            self.nfa.free[b].append(c)
        return parts[0][0], parts[-1][1]

    def repeat(self) -> tuple[int, int]:
        begin = self.at
        atom = self.atom()
        mark = self.text[self.at : self.at + 1]
        if mark == "{":
            close = self.text.index("}", self.at)
            low, _, high = self.text[self.at + 1 : close].partition(",")
            least, most, end = int(low), int(high or low), close + 1
        elif mark and mark in "?*+":
            least, most, end = (1 if mark == "+" else 0), (1 if mark == "?" else None), self.at + 1
        else:
            return atom
        first, last = self.nfa.state(), self.nfa.state()
        tail = first
        for i in range(most or max(least, 1)):
            if i:
                self.at = begin
                atom = self.atom()
            if i >= least:
                self.nfa.free[tail].append(last)
            self.nfa.free[tail].append(atom[0])
            tail = atom[1]
        if most is None:
            self.nfa.free[tail].append(atom[0])
        self.nfa.free[tail].append(last)
        self.at = end
        return first, last

    def atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            inner = self.choice()
            self.at += 1
            return inner
        self.at += 1
        chosen = self.bracket() if c == "[" else {self.escape() if c == "\\" else ord(c)}
        if self.any_case:
            chosen |= {x ^ 32 for x in chosen if chr(x).isascii() and chr(x).isalpha()}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.arcs[a].append((frozenset(chosen), b))
        return a, b

    def escape(self) -> int:
        if self.text[self.at] == "x":
            self.at += 3
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 1
        return ord(self.text[self.at - 1])

    def bracket(self) -> set[int]:
        out: set[int] = set()
        while self.text[self.at] != "]":
            c = self.text[self.at]
            self.at += 1
            low = self.escape() if c == "\\" else ord(c)
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                c = self.text[self.at]
                self.at += 1
                out |= set(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                out.add(low)
        self.at += 1
        return out


def _classes(sets: list[frozenset[int]]) -> np.ndarray:
    """Bytes that no set tells apart share a class; BREAK has its own."""
    kinds: dict[tuple, int] = {}
    return np.array([kinds.setdefault((b == BREAK, *(b in s for s in sets)), len(kinds)) for b in range(256)], np.int32)


@dataclass(frozen=True)
class Finder:
    """Leftmost-longest, non-overlapping search for one pattern.

    ``step[state][class]`` and, beside it, whether a match has ended before that byte.
    State 0 starts. ``back`` reads a match from its end towards its start.
    """

    step: list[list[int]]
    ended: list[list[bool]]


def _finder(pattern: str, any_case: bool, symbol: np.ndarray) -> Finder:
    """Subset construction with the threads of each start kept apart, oldest start first.

    Raises for a pattern whose match end is not known at once: one that a longer try may
    overrun in vain, or one that a later start can finish before an earlier one.
    """
    nfa, first, last = _Parser(pattern, any_case, False).build()
    byte_of = {int(c): b for b, c in reversed(list(enumerate(symbol)))}
    fresh = frozenset(nfa.closed((first,)))
    if last in fresh:
        raise ValueError(f"{pattern!r} matches the empty text")

    def follow(starts: tuple[frozenset[int], ...], matched: bool, byte: int):
        moved, seen = [], set()
        for threads in starts:
            to = frozenset(nfa.closed(tuple(t for s in sorted(threads) for chosen, t in nfa.arcs[s] if byte in chosen))) - seen
            if to:
                moved.append(to)
                seen |= to
        if matched and not moved:
            return follow((fresh,), False, byte)[0], True
        accepting = [last in threads for threads in moved]
        if matched != any(accepting) and matched or True in accepting[1:] and not accepting[0]:
            raise ValueError(f"{pattern!r} can run past its match")
        if any(accepting):
            return ((moved[0],), True), False
        late = fresh - seen
        return ((*moved, late) if late else tuple(moved), False), False

    start = ((fresh,), False)
    number, queue, step, ended = {start: 0}, [start], [], []
    for state in queue:
        row, ends = [], []
        for c in range(len(byte_of)):
            to, end = (start, state[1]) if byte_of[c] == BREAK else follow(*state, byte_of[c])
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append(number[to])
            ends.append(end)
        step.append(row)
        ended.append(ends)
    return Finder(step, ended)


def _backward(pattern: str, any_case: bool) -> tuple[list[list[int]], list[bool]]:
    """Reverse automaton over bytes: next state or -1, and whether a start may stand here."""
    nfa, first, last = _Parser(pattern, any_case, True).build()
    start = tuple(sorted(nfa.closed((first,))))
    number, queue, step = {start: 0}, [start], []
    for state in queue:
        row = []
        for byte in range(256):
            moved = {to for s in state for chosen, to in nfa.arcs[s] if byte in chosen}
            key = tuple(sorted(nfa.closed(tuple(moved))))
            if key and key not in number:
                number[key] = len(queue)
                queue.append(key)
            row.append(number[key] if key else -1)
        step.append(row)
    return step, [last in s for s in queue]


@dataclass(frozen=True)
class Scanner:
    """All rules in one automaton. ``ends[transition]`` has bit k set if a match of rule k ends before that byte."""

    automaton: Automaton
    ends: np.ndarray
    backward: list[tuple[list[list[int]], list[bool]]]


def compile_rules(rules: list[tuple[str, bool]]) -> Scanner:
    """``rules``: (pattern, any_case). Product of the rules' automata, minimised by partition refinement."""
    sets = [chosen for p, any_case in rules for arcs in _Parser(p, any_case, False).build()[0].arcs for chosen, _ in arcs]
    symbol = _classes(sets)
    width = int(symbol.max()) + 1
    found = [_finder(p, any_case, symbol) for p, any_case in rules]
    start = (0,) * len(found)
    number, queue, step, ends = {start: 0}, [start], [], []
    for state in queue:
        row, bits = [], []
        for c in range(width):
            to = tuple(f.step[s][c] for f, s in zip(found, state, strict=True))
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append(number[to])
            bits.append(sum(1 << k for k, (f, s) in enumerate(zip(found, state, strict=True)) if f.ended[s][c]))
        step.append(row)
        ends.append(bits)
    table, out = np.array(step, np.int32), np.array(ends, np.int32)
    group = np.unique(out, axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = {int(group[0]): 0}
    for g in group:
        order.setdefault(int(g), len(order))
    names = np.array([order[int(g)] for g in group], np.int32)
    small, bits = np.empty((len(order), width), np.int32), np.empty((len(order), width), np.int32)
    small[names], bits[names] = names[table], out
    return Scanner(Automaton(symbol, small.reshape(-1), width), bits.reshape(-1), [_backward(p, any_case) for p, any_case in rules])


def spans(scanner: Scanner, stream: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each rule, (start, end) of its matches in the stream, from left to right."""
    taken = scanner.automaton.run(stream)
    bits = scanner.ends[taken]
    at = np.flatnonzero(bits)
    data = stream.tobytes()
    out: list[list[tuple[int, int]]] = []
    for k, (step, accepts) in enumerate(scanner.backward):
        rows, floor = [], 0
        for end in at[(bits[at] >> k) & 1 == 1].tolist():
            state, begin = 0, end
            for i in range(end - 1, floor - 1, -1):
                state = step[state][data[i]]
                if state < 0:
                    break
                if accepts[state]:
                    begin = i
            rows.append((begin, end))
            floor = end
        out.append(rows)
    return out

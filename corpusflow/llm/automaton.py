"""Regular expressions over bytes, several at once, as minimal deterministic automata.

The supported syntax is what secret rules use: literals, ``\\xHH`` and escaped characters, classes,
groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``. Matches are the longest ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# An expression is ("set", bytes) | ("cat", parts) | ("or", parts) | ("repeat", part, least, most or None).


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    at = 0

    def both_cases(some: set[int]) -> frozenset[int]:
        return frozenset(some | {ord(chr(c).swapcase()) for c in some if ignore_case and chr(c).isalpha() and c < 128})

    def character() -> int:
        nonlocal at
        if pattern[at] != "\\":
            at += 1
            return ord(pattern[at - 1])
        if pattern[at + 1] == "x":
            at += 4
            return int(pattern[at - 2 : at], 16)
        at += 2
        return ord(pattern[at - 1])

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] != "[":
            return ("set", both_cases({character()}))
        at += 1
        some: set[int] = set()
        while pattern[at] != "]":
            low = high = character()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = character()
            some |= set(range(low, high + 1))
        at += 1
        return ("set", both_cases(some))

    def repeated() -> tuple:
        nonlocal at
        part = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at + 1 : end].partition(",")
                bounds = (int(low), int(low) if "," not in pattern[at:end] else int(high) if high else None)
                at = end
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
            at += 1
            part = ("repeat", part, *bounds)
        return part

    def sequence() -> tuple:
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def either() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return ("or", parts)

    return either()


def backwards(part: tuple) -> tuple:
    """The expression of the reversed strings."""
    if part[0] == "cat":
        return ("cat", [backwards(p) for p in reversed(part[1])])
    if part[0] == "or":
        return ("or", [backwards(p) for p in part[1]])
    return ("repeat", backwards(part[1]), *part[2:]) if part[0] == "repeat" else part


@dataclass
class _Nfa:
    free: list[list[int]] = field(default_factory=list)
    step: list[tuple[frozenset[int], int] | None] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, part: tuple, start: int) -> int:
        """Add states for ``part`` from ``start``; returns where it ends."""
        if part[0] == "set":
            end = self.state()
            self.step[start] = (part[1], end)
            at = self.state()
            self.free[end].append(at)
            return at
        if part[0] == "cat":
            for p in part[1]:
                start = self.add(p, start)
            return start
        if part[0] == "or":
            end = self.state()
            for p in part[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(p, first)].append(end)
            return end
        _, inner, least, most = part
        for _ in range(least):
            start = self.add(inner, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[loop].append(end)
            first = self.state()
            self.free[loop].append(first)
            self.free[self.add(inner, first)].append(loop)
            return end
        self.free[start].append(end)
        for _ in range(most - least):
            first = self.state()
            self.free[start].append(first)
            start = self.add(inner, first)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]`` is the next state and ``accepts[state]`` a bit for each rule; state 0 is the first."""

    step: np.ndarray
    accepts: np.ndarray

    def rows(self) -> list[list]:
        """A list for each state: the lists of the states that the 256 bytes lead to, then its bits."""
        rows: list[list] = [[] for _ in self.accepts]
        for row, steps, bits in zip(rows, self.step.tolist(), self.accepts.tolist(), strict=True):
            row.extend(rows[s] for s in steps)
            row.append(bits)
        return rows


def compile_rules(parts: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction over all expressions at once, then minimisation. ``anywhere``: a match may begin at any byte."""
    nfa = _Nfa()
    first = nfa.state()
    finals = {}
    for rule, part in enumerate(parts):
        start = nfa.state()
        nfa.free[first].append(start)
        finals[nfa.add(part, start)] = 1 << rule
    # bytes that no set tells apart are one column
    sets = {s[0] for s in nfa.step if s}
    alike: dict[tuple, list[int]] = {}
    for byte in range(256):
        alike.setdefault(tuple(byte in s for s in sets), []).append(byte)
    columns = list(alike.values())
    root = nfa.closure([first])
    number, todo, table, bits = {root: 0}, [root], [], []
    while todo:
        states = todo.pop(0)
        bits.append(sum({finals[s] for s in states if s in finals}))
        row = []
        for column in columns:
            reached = {nfa.step[s][1] for s in states if nfa.step[s] and column[0] in nfa.step[s][0]}
            after = nfa.closure(reached | {first}) if anywhere else nfa.closure(reached)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        table.append(row)
    step, accepts = np.array(table), np.array(bits)
    # minimisation: split classes of states until equal classes step to equal classes
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack((group, group[step])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    _, one = np.unique(group, return_index=True)
    order = np.argsort(np.where(one == one[group[0]], -1, one), kind="stable")  # the first state stays first
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    small = place[group[step[one[order]]]]
    full = np.empty((len(small), 256), np.int32)
    for k, column in enumerate(columns):
        full[:, column] = small[:, [k]]
    return Automaton(full, accepts[one[order]])

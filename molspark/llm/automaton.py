"""Regular expressions to one minimal deterministic automaton over bytes, and a block scan with it.

Subset of the syntax: literals, ``.`` escapes, ``\\xHH``, classes with ranges, groups, ``|`` and the
quantifiers ``? * + {m} {m,} {m,n}``. Patterns are ASCII; any other byte ends every match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

import numpy as np


def parse(pattern: str, either_case: bool = False):
    """A tree of ("set", bytes) | ("cat", [..]) | ("alt", [..]) | ("rep", node, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def leaf(values) -> tuple:
        own = set(values)
        if either_case:
            own |= {ord(chr(v).swapcase()) for v in own if chr(v).isalpha()}
        return ("set", frozenset(own))

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            if pattern.startswith("?:", at):
                at += 2
            node = either()
            at += 1
        elif pattern[at] == "[":
            at += 1
            values = []
            while pattern[at] != "]":
                low = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    values += range(low, char() + 1)
                else:
                    values.append(low)
            at += 1
            node = leaf(values)
        else:
            node = leaf([char()])
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at + 1 : end].partition(",")
                node = ("rep", node, int(low), int(high) if high else int(low) if "," not in pattern[at:end] else None)
                at = end + 1
            else:
                node = ("rep", node, int(pattern[at] == "+"), 1 if pattern[at] == "?" else None)
                at += 1
        return node

    def row() -> tuple:
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(one())
        return ("cat", parts)

    def either() -> tuple:
        nonlocal at
        parts = [row()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(row())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return either()


def mirrored(node):
    """The tree of the reversed language."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    return (kind, [mirrored(x) for x in (reversed(node[1]) if kind == "cat" else node[1])])


class Nfa:
    def __init__(self):
        self.skip: list[set[int]] = []
        self.step: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.skip.append(set())
        self.step.append([])
        return len(self.skip) - 1

    def build(self, node, a: int) -> int:
        """Adds the node's states from ``a`` on; returns its end."""
        kind = node[0]
        if kind == "set":
            self.step[a].append((node[1], b := self.state()))
            return b
        if kind == "cat":
            for x in node[1]:
                a = self.build(x, a)
            return a
        if kind == "alt":
            b = self.state()
            for x in node[1]:
                self.skip[a].add(s := self.state())
                self.skip[self.build(x, s)].add(b)
            return b
        _, inner, least, most = node
        for _ in range(least):
            a = self.build(inner, a)
        if most is None:
            self.skip[a].add(s := self.state())
            self.skip[e := self.build(inner, s)].add(s)
            self.skip[a].add(b := self.state())
            self.skip[e].add(b)
            return b
        b = self.state()
        for _ in range(most - least):
            self.skip[a].add(b)
            a = self.build(inner, a)
        self.skip[a].add(b)
        return b


class Automaton:
    """``next[state * classes + byte_class]`` gives the next state, times classes; ``accepts`` a bit for each rule."""

    def __init__(self, trees: list, floating: bool):
        """floating: a match may begin anywhere, so the start state is in every set."""
        nfa = Nfa()
        start = nfa.state()
        ends = {}
        for k, tree in enumerate(trees):
            nfa.skip[start].add(s := nfa.state())
            ends[nfa.build(tree, s)] = k
        sets = {x for steps in nfa.step for x, _ in steps}
        sign: dict[frozenset, list[int]] = defaultdict(list)
        for byte in range(256):
            sign[frozenset(x for x in sets if byte in x)].append(byte)
        classes = list(sign.values())
        self.of_byte = np.zeros(256, np.uint8)
        for k, members in enumerate(classes):
            self.of_byte[members] = k
        self.classes = len(classes)

        def closed(states: set[int]) -> int:
            todo, seen = list(states), set(states)
            while todo:
                for x in nfa.skip[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            return sum(1 << x for x in seen if nfa.step[x] or x in ends)

        first = closed({start})
        again = first if floating else 0
        steps = [[sum({closed({b}) for x, b in own if members[0] in x}) if len(own) < 2 else closed({b for x, b in own if members[0] in x}) for members in classes] for own in nfa.step]
        moves = {1 << i: row for i, row in enumerate(steps) if any(row)}
        number, rows, order = {first: 0}, [], [first]
        for own in order:
            row, rest = [again] * len(classes), own
            while rest:
                low = rest & -rest
                rest ^= low
                if low in moves:
                    row = [x | y for x, y in zip(row, moves[low], strict=True)]
            for to in row:
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
            rows.append([number[to] for to in row])
        table = np.array(rows, np.int64)
        bits = np.array([sum({1 << k for e, k in ends.items() if own >> e & 1}) for own in order], np.int64)
        part = np.unique(bits, return_inverse=True)[1]
        while True:  # Moore's refinement
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        names = np.full(part.max() + 1, -1)
        names[part[0]] = 0
        names[names < 0] = np.arange(1, len(names))
        part = names[part]
        where = np.zeros(part.max() + 1, np.int64)
        where[part] = np.arange(len(part))
        self.states = len(where)
        self.next = (part[table[where]] * self.classes).astype(np.int32).ravel()
        self.accepts = bits[where]
        live = self.accepts > 0
        while True:  # states from which no match can come any more
            more = live | live[self.next.reshape(self.states, -1) // self.classes].any(axis=1)
            if (more == live).all():
                break
            live = more
        self.dead = ~live
        self._next, self._of_byte, self._accepts, self._dead = self.next.tolist(), self.of_byte.tolist(), self.accepts.tolist(), self.dead.tolist()

    def longest(self, data: bytes, at: int, stop: int, step: int = 1) -> int:
        """Where the longest match from ``at`` ends (exclusive, in the direction of ``step``), or ``at`` - ``step`` ... if none: -1."""
        s, best, nxt, cls, n = 0, -1, self._next, self._of_byte, self.classes
        while at != stop:
            s = nxt[s + cls[data[at]]]
            q = s // n
            if self._dead[q]:
                break
            at += step
            if self._accepts[q]:
                best = at
        return best


class Scanner:
    """All rules in one pass. ``rules``: kind to (pattern, either case)."""

    LANES, LEAST = 8192, 256

    def __init__(self, rules: Mapping[str, tuple[str, bool]]):
        trees = [parse(p, c) for p, c in rules.values()]
        self.kinds, self.all = list(rules), Automaton(trees, True)
        self.own = [Automaton([t], False) for t in trees]
        self.back = [Automaton([mirrored(t)], False) for t in trees]
        self.hit = self.all.accepts > 0

    def states(self, raw: np.ndarray) -> tuple[np.ndarray, int]:
        """The state after each byte, as [step, lane] for equal lanes of the input, and the lanes' length.

        Lanes run at once, each from the start state; a lane whose predecessor ended in another state
        is run again from that, until its states meet those it had.
        """
        n, c = len(raw), self.all.classes
        lanes = max(1, min(self.LANES, n // self.LEAST))
        length = -(-n // lanes)
        grid = np.full(lanes * length, self.all.of_byte[255], np.uint8)
        grid[:n] = self.all.of_byte[raw]
        grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
        out, s, nxt = np.empty((length, lanes), np.int32), np.zeros(lanes, np.int32), self.all.next
        for j in range(length):
            s = nxt[s + grid[j]]
            out[j] = s
        came = np.zeros(lanes, np.int32)
        while True:
            true = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
            lane = np.flatnonzero(true != came)
            if not len(lane):
                return out // c, length
            came[lane] = true[lane]
            s = true[lane]
            for j in range(length):
                s = nxt[s + grid[j, lane]]
                off = s != out[j, lane]
                lane, s = lane[off], s[off]
                if not len(lane):
                    break
                out[j, lane] = s

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(kind's number, start, end) of the leftmost longest non-overlapping matches of each rule, in bytes."""
        if not data:
            return []
        states, length = self.states(np.frombuffer(data, np.uint8))
        j, lane = np.nonzero(self.hit[states])
        at = lane * length + j
        order = np.argsort(at)
        at, bits = at[order], self.all.accepts[states[j[order], lane[order]]]
        out = []
        for k in range(len(self.kinds)):
            ends = at[(bits >> k) & 1 > 0]
            if not len(ends):
                continue
            cut = np.flatnonzero(np.diff(ends) > 1) + 1
            regions: list[list[int]] = []
            for first, last in zip(ends[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [len(ends) - 1]])].tolist(), strict=True):
                start = self.back[k].longest(data, first, -1, -1) + 1
                if regions and start < regions[-1][1]:
                    regions[-1] = [min(start, regions[-1][0]), last + 1]
                else:
                    regions.append([start, last + 1])
            done = 0
            for start, stop in regions:
                p = max(start, done)
                while p < stop:
                    if (e := self.own[k].longest(data, p, len(data))) > p:
                        out.append((k, p, e))
                        p = done = e
                    else:
                        p += 1
        return out

"""Regular expressions compiled to one minimal deterministic automaton over bytes.

Supports what rule files use: literals, classes, groups, alternatives and the greedy
repetitions ?, *, + and {m,n}, with inline (?i:...) folding ASCII letters. Patterns are ASCII. Reversed
patterns give an automaton that reads texts from behind, and so marks where matches begin.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from re import _constants as sre
from re import _parser

import numpy as np


class _Nfa:
    def __init__(self, backwards: bool):
        self.backwards = backwards
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, items, at: int, fold: bool) -> int:
        """Appends the parsed items behind state `at`; returns the state in which they end."""
        for op, arg in reversed(list(items)) if self.backwards else items:
            at = self._one(op, arg, at, fold)
        return at

    def _one(self, op, arg, at: int, fold: bool) -> int:
        if op in (sre.LITERAL, sre.IN, sre.NOT_LITERAL, sre.ANY):
            end = self.state()
            self.moves[at].append((_bytes_of(op, arg, fold), end))
            return end
        if op is sre.SUBPATTERN:
            _, added, removed, items = arg
            return self.add(items, at, (fold or bool(added & 2)) and not removed & 2)
        if op is sre.BRANCH:
            end = self.state()
            for items in arg[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.add(items, begin, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, items = arg
            for _ in range(least):
                at = self.add(items, at, fold)
            if most is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[at].append(loop)
                self.empty[self.add(items, loop, fold)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.state()
            for _ in range(most - least):
                self.empty[at].append(end)
                at = self.add(items, at, fold)
            self.empty[at].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")


def _bytes_of(op, arg, fold: bool) -> frozenset:
    if op is sre.ANY:
        return frozenset(range(256)) - {10}
    found, negated = set(), op is sre.NOT_LITERAL
    for kind, value in arg if op is sre.IN else [(sre.LITERAL, arg)]:
        if kind is sre.NEGATE:
            negated = True
        elif kind is sre.LITERAL:
            found.add(value)
        elif kind is sre.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {kind}")
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
    return frozenset(set(range(256)) - found if negated else found)


#: Patterns of one automaton at most: its accept bits are a 64-bit number.
PATTERNS = 64


class Dfa:
    """`step[state, byte]` is the next state; bit k of `accepts[state]`: pattern k may end here, or begin if read backwards.

    State 0 is the start, and a match may begin anywhere.
    """

    def __init__(self, patterns: list[str], backwards: bool = False):
        if len(patterns) > PATTERNS:
            raise ValueError(f"more than {PATTERNS} patterns in one automaton")
        nfa = _Nfa(backwards)
        start = nfa.state()
        ends = {}
        for k, pattern in enumerate(patterns):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends[nfa.add(_parser.parse(pattern), begin, False)] = k

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        first = closed([start])
        number, rows, accepts = {first: 0}, [], []
        order = [first]
        for states in order:  # subset construction
            row = [set() for _ in range(256)]
            for s in states:
                for over, to in nfa.moves[s]:
                    for b in over:
                        row[b].add(to)
            targets, kept = [], {}
            for to in map(frozenset, row):
                if to not in kept:
                    grown = closed(to | {start})
                    if grown not in number:
                        number[grown] = len(number)
                        order.append(grown)
                    kept[to] = number[grown]
                targets.append(kept[to])
            rows.append(targets)
            accepts.append(sum(1 << ends[s] for s in states if s in ends))
        step, accepts = np.array(rows, dtype=np.int64), np.array(accepts, dtype=np.uint64)

        block = np.unique(accepts, return_inverse=True)[1]  # minimisation by refining blocks
        while True:
            finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        named = defaultdict(lambda: len(named))
        for b in block:  # the start keeps number 0
            named[b]
        pick = {named[b]: i for i, b in reversed(list(enumerate(block)))}
        chosen = [pick[i] for i in range(len(named))]
        renamed = np.array([named[b] for b in block])
        self.step = renamed[step[chosen]].astype(np.uint16)
        self.accepts = accepts[chosen]
        columns, of_byte = np.unique(self.step, axis=1, return_inverse=True)  # bytes that no rule tells apart are one class
        self.classes = of_byte.ravel().astype(np.uint8)
        self.width = columns.shape[1]
        self.moves = (columns.astype(np.int32) * self.width).ravel()  # from state * width + class to the next state * width


#: Bytes per lane of the scan; all lanes advance together, one byte at a time.
LANE = 512
#: Bytes scanned at once.
SPAN = 1 << 22
#: Where fewer lanes than this have to run again, they do so one after the other, byte by byte and on into the next lane.
FEW = 48


def scan(dfa: Dfa, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The accept bits after each byte of `data`, one table look-up per byte.

    `data` is many texts end to end and `starts` where each begins; no text is empty. Texts are cut into
    lanes that advance together. A lane begins as if its text began there; lanes whose text
    came from another state then run again until both runs agree. Where few are left, as in one long run in which they never agree, each
    goes on through the lanes behind it at once.
    """
    moves, symbols = dfa.moves, dfa.classes[data]
    bounds = np.append(starts, len(data))
    pieces = -(-np.diff(bounds) // LANE)
    head = np.repeat(bounds[:-1], pieces)
    turn = np.arange(len(head)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = head + turn * LANE
    end = np.minimum(begin + LANE, np.repeat(bounds[1:], pieces))
    last = np.zeros(len(begin), dtype=np.int32)
    states = np.zeros(len(data), dtype=np.int32)

    def advance(lanes: np.ndarray, state: np.ndarray, again: bool) -> None:
        for t in range(LANE):
            at = begin[lanes] + t
            inside = at < end[lanes]
            if not inside.all():
                last[lanes[~inside]] = state[~inside]
                lanes, state, at = lanes[inside], state[inside], at[inside]
            if not len(lanes):
                return
            state = moves[state + symbols[at]]
            if again:
                apart = states[at] != state
                lanes, state, at = lanes[apart], state[apart], at[apart]
            states[at] = state
        last[lanes] = state

    by_length = np.argsort(begin - end, kind="stable")
    advance(by_length, np.zeros(len(begin), dtype=np.int32), False)
    assumed = np.zeros(len(begin), dtype=np.int32)
    later = np.flatnonzero(turn > 0)

    def onward(lane: int) -> None:
        """From a lane on, byte by byte, until both runs agree or the text ends."""
        state, table = int(last[lane - 1]), plain()
        while True:
            assumed[lane] = state
            a, b = int(begin[lane]), int(end[lane])
            before = states[a:b].tolist()
            for t, symbol in enumerate(symbols[a:b].tolist()):
                state = table[state + symbol]
                if before[t] == state:
                    states[a : a + t] = before[:t]
                    return
                before[t] = state
            states[a:b] = before
            last[lane] = state
            lane += 1
            if lane == len(turn) or not turn[lane] or assumed[lane] == state:
                return

    @lru_cache
    def plain() -> list[int]:
        return moves.tolist()

    while len(later):
        later = later[last[later - 1] != assumed[later]]
        if len(later) < FEW:
            for lane in later.tolist():
                if last[lane - 1] != assumed[lane]:
                    onward(lane)
            break
        if len(later):
            assumed[later] = last[later - 1]
            advance(later, assumed[later].copy(), True)
            later = np.flatnonzero(turn > 0)
    return np.repeat(dfa.accepts, dfa.width)[states] if dfa.width * len(dfa.accepts) < 1 << 20 else dfa.accepts[states // dfa.width]

"""Byte regexes compiled into one deterministic automaton: subset construction, product of the rules, minimisation.

A rule's automaton finds its leftmost, longest, non-overlapping matches as it reads: its state is the list of the sets of
places in the regex that a match begun at some earlier byte may have reached, the earliest beginning first. As soon as the
first one has matched, later beginnings are dropped until it ends. Rules must go on matching from their shortest match
to their longest one; `compile_rules` refuses others.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

import numpy as np

_MANY = 4096  # most repetitions that are written out


class _Nfa:
    """Thompson's construction: byte edges and empty edges."""

    def __init__(self, pattern: bytes, flags: int = 0, backwards: bool = False):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.fold = bool(flags & re.IGNORECASE)
        self.backwards = backwards
        self.start = self._new()
        self.end = self._build(parser.parse(pattern, flags & ~re.IGNORECASE), self.start)

    def _new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _either(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {c ^ 0x20 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(chars)

    def _byte(self, chars: set[int], at: int) -> int:
        to = self._new()
        self.edges[at].append((self._either(chars), to))
        return to

    def _build(self, tree, at: int) -> int:
        for op, arg in reversed(list(tree)) if self.backwards else tree:
            if op is sre.LITERAL:
                at = self._byte({arg}, at)
            elif op is sre.IN:
                chars: set[int] = set()
                for kind, value in arg:
                    if kind is sre.LITERAL:
                        chars.add(value)
                    elif kind is sre.RANGE:
                        chars |= set(range(value[0], value[1] + 1))
                    elif kind is not sre.NEGATE:
                        raise ValueError(f"not supported in a class: {kind}")
                at = self._byte(set(range(256)) - chars if arg[0][0] is sre.NEGATE else chars, at)
            elif op is sre.SUBPATTERN:
                at = self._build(arg[-1], at)
            elif op is sre.BRANCH:
                to = self._new()
                for branch in arg[1]:
                    begin = self._new()
                    self.empty[at].append(begin)
                    self.empty[self._build(branch, begin)].append(to)
                at = to
            elif op is sre.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self._build(body, at)
                if high is sre.MAXREPEAT:
                    begin, to = self._new(), self._new()
                    self.empty[at] += [begin, to]
                    self.empty[self._build(body, begin)] += [begin, to]
                    at = to
                elif high > _MANY:
                    raise ValueError("too many repetitions")
                else:
                    to = self._new()
                    for _ in range(high - low):
                        self.empty[at].append(to)
                        at = self._build(body, at)
                    self.empty[at].append(to)
                    at = to
            else:
                raise ValueError(f"not supported: {op}")
        return at

    def closure(self, places: set[int]) -> frozenset[int]:
        seen, todo = set(places), list(places)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, places: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for p in places for chars, to in self.edges[p] if byte in chars})

    def classes(self) -> list[frozenset[int]]:
        return list({chars for edges in self.edges for chars, _ in edges})


class _Scanner:
    """One rule's automaton over states (sets by beginning, the earliest first), made as they are met."""

    def __init__(self, nfa: _Nfa):
        self.nfa = nfa
        self.fresh = nfa.closure({nfa.start})
        if nfa.end in self.fresh:
            raise ValueError("a rule must not match nothing")
        self.start = (self.fresh,)
        self.made: dict[tuple, tuple] = {}

    def accepts(self, state: tuple) -> bool:
        return self.nfa.end in state[0]

    def step(self, state: tuple, byte: int) -> tuple:
        key = state, byte
        if key not in self.made:
            self.made[key] = self._step(state, byte)
        return self.made[key]

    def _step(self, state: tuple, byte: int) -> tuple:
        if self.accepts(state):
            more = self.nfa.step(state[0], byte)
            if more:
                if self.nfa.end not in more:
                    raise ValueError("a match must go on matching until it ends")
                return (more,)
            state = self.start
        seen: set[int] = set()
        out = []
        for places in state:
            left = self.nfa.step(places, byte) - seen
            if not left:
                continue
            if self.nfa.end in left:
                if out:
                    raise ValueError("an earlier beginning may still match")
                return (left,)
            out.append(left)
            seen |= left
        return (*out, self.fresh)


class Automaton:
    """next[state * 256 + byte] and, by state, the rules (as bits) that have a match ending there; state 0 is the start."""

    def __init__(self, patterns: list[tuple[bytes, int]]):
        scanners = [_Scanner(_Nfa(p, flags)) for p, flags in patterns]
        sets = [c for s in scanners for c in s.nfa.classes()]
        kind: dict[tuple[bool, ...], int] = {}
        of_byte = [kind.setdefault(tuple(b in c for c in sets), len(kind)) for b in range(256)]
        example = [of_byte.index(k) for k in range(len(kind))]
        first = tuple(s.start for s in scanners)
        number, todo, rows, masks = {first: 0}, [first], [], []
        while len(rows) < len(todo):
            state = todo[len(rows)]
            masks.append(sum(1 << i for i, (s, x) in enumerate(zip(scanners, state)) if s.accepts(x)))
            row = []
            for byte in example:
                to = tuple(s.step(x, byte) for s, x in zip(scanners, state))
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        table, mask = self._minimised(np.array(rows), np.array(masks))
        self.next = table[:, of_byte].astype(np.int32).ravel()
        self.mask = mask.astype(np.int32)
        # bytes after which every state is the start again
        self.resets = np.array([bool((table[:, of_byte[b]] == 0).all()) for b in range(256)])

    @staticmethod
    def _minimised(table: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States that no input tells apart become one: the partition by rules is refined until it stays."""
        part = np.unique(mask, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        first = np.unique(part, return_index=True)[1]
        order = np.argsort(first)  # the start stays state 0
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return rank[part[table[first[order]]]], mask[first[order]]

    def ends(self, buf: np.ndarray, offsets: np.ndarray, lane: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rule, earliest place where the match can begin, end) of all matches.

        Texts are cut into lanes of about `lane` bytes, where one is near after a byte that brings every state back to the
        start, and anywhere else in a long run without such bytes. All lanes take a step at a time, from the start state;
        those that turn out to begin in another state, the last of the lane before, are read again from that one, until
        no lane's state changes. States forget what is some dozens of bytes back, so a second reading is the rule.
        """
        none = np.zeros(0, dtype=np.int64)
        if not len(buf):
            return none, none, none
        texts = offsets[:-1][np.diff(offsets) > 0]
        reset = np.flatnonzero(self.resets[buf]) + 1
        aim = np.arange(lane, len(buf), lane)
        after = np.append(reset, len(buf) + lane)[np.searchsorted(reset, aim)]
        begin = np.unique(np.concatenate([texts, np.where(after - aim <= lane, after, aim)]))
        begin = begin[begin < len(buf)]
        size = np.diff(np.append(begin, len(buf)))
        # lanes that go on where the one before stops
        follows = np.ones(len(begin), dtype=bool)
        follows[np.searchsorted(begin, texts)] = False
        entry, exit_ = np.zeros(len(begin), dtype=np.int32), np.zeros(len(begin), dtype=np.int32)
        reading = np.zeros(len(begin), dtype=np.int32)
        found: list[tuple[np.ndarray, ...]] = []
        todo, times = np.arange(len(begin)), 0
        while len(todo):
            times += 1
            reading[todo] = times
            for bits, which, end in self._read(buf, begin, size, entry, exit_, todo):
                found.append((bits, which, end, np.full(len(which), times, dtype=np.int32)))
            now = np.where(follows, np.append(0, exit_[:-1]), 0).astype(np.int32)
            todo = np.flatnonzero(now != entry)
            entry = now
        # matches that last to the end of their text
        last = np.flatnonzero(~np.append(follows[1:], False))
        held = last[self.mask[exit_[last]] != 0]
        found.append((self.mask[exit_[held]], held, begin[held] + size[held], reading[held]))
        bits, which, end, read = (np.concatenate(x) for x in zip(*found))
        valid = read == reading[which]
        bits, end = bits[valid], end[valid]
        bound = np.unique(np.concatenate([texts, reset]))
        least = bound[np.searchsorted(bound, end - 1, side="right") - 1]
        rules = [np.flatnonzero(bits >> k & 1) for k in range(31)]
        pick = np.concatenate(rules)
        return np.repeat(np.arange(31), [len(r) for r in rules]), least[pick], end[pick]

    def _read(self, buf: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray, exit_: np.ndarray, lanes: np.ndarray):
        """Reads some lanes from their entry states and notes their last states; gives (rules as bits, lane, end) of what ends inside."""
        lanes = lanes[np.argsort(-size[lanes], kind="stable")]
        first, length = begin[lanes], size[lanes]
        live = len(lanes) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1))
        state = entry[lanes]
        before = self.mask[state]
        for t, n in enumerate(live.tolist()):
            exit_[lanes[n : len(state)]] = state[n:]
            state = state[:n]
            state = self.next[(state << 8) | buf[first[:n] + t]]
            now = self.mask[state]
            gone = before[:n] & ~now
            at = np.flatnonzero(gone)
            if len(at):
                yield gone[at], lanes[at], first[at] + t
            before = now
        exit_[lanes[: len(state)]] = state


class Backwards:
    """Finds the beginning of a match from its end, with the automaton of the reversed regex."""

    def __init__(self, pattern: bytes, flags: int = 0):
        self.nfa = _Nfa(pattern, flags, backwards=True)
        self.made: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def start(self, raw: bytes, least: int, end: int) -> int:
        """The smallest start from `least` on of a match that ends at `end`."""
        state, best = self.nfa.closure({self.nfa.start}), end
        for i in range(end - 1, least - 1, -1):
            key = state, raw[i]
            if key not in self.made:
                self.made[key] = self.nfa.step(state, raw[i])
            state = self.made[key]
            if not state:
                break
            if self.nfa.end in state:
                best = i
        return best

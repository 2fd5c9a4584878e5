"""The minimal acceptor of a set of words, and its composition with a one-edit transducer and itself.

The transducer copies its input up to one edit and after it. Both acceptors are the same machine and read the same word up to the edit, so the
composed machine is in one state (q, before the edit, q) there; the edit leads to a state (p, after the edit, r), from which both acceptors have to
accept the same rest. ``edits`` lists for each state q what can follow it, once, however many words pass through q. The edit is always taken to be at the first place
at which the two words differ, so that a pair is accepted on one path only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import combinations


class Acceptor:
    """States of the minimal acyclic acceptor of ascending, distinct words; a state's successors have smaller numbers."""

    def __init__(self, words: Sequence[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        before = ""

        def settle(depth: int) -> int:
            state = -1
            while len(path) > depth:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                state = known.get(key, -1)
                if state < 0:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                if path:
                    path[-1][1][before[len(path) - 1]] = state
            return state

        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            settle(shared + 1)
            path.extend([False, {}] for _ in range(len(word) - shared))
            path[-1][0] = True
            before = word
        self.start = settle(0)


class OneEdit:
    """Pairs of an acceptor's words that differ by one edit."""

    def __init__(self, acceptor: Acceptor):
        sys.setrecursionlimit(1 << 20)  # as deep as the words are long
        self.arcs, self.final, self.start = acceptor.arcs, acceptor.final, acceptor.start
        self.labels = [frozenset(a) for a in self.arcs]
        self.rests: dict[tuple[int, int], tuple[str, ...]] = {}
        self.edits = [self._edits(q) for q in range(len(self.arcs))]
        self.alive: list[bool] = []
        for q, found in enumerate(self.edits):
            self.alive.append(bool(found) or any(self.alive[r] for r in self.arcs[q].values()))

    def common(self, p: int, r: int) -> tuple[str, ...]:
        """What both states accept."""
        if p > r:
            p, r = r, p
        found = self.rests.get((p, r))
        if found is None:
            found = self.rests[p, r] = self._common(p, r)
        return found

    def _common(self, p: int, r: int) -> tuple[str, ...]:
        head = []
        while True:
            shared = self.labels[p] & self.labels[r]
            ends = self.final[p] and self.final[r]
            if ends or len(shared) != 1:
                break
            (label,) = shared
            head.append(label)
            p, r = self.arcs[p][label], self.arcs[r][label]
        rests = [""] if ends else []
        for label in shared:
            rests += [label + rest for rest in self.common(self.arcs[p][label], self.arcs[r][label])]
        if head:
            start = "".join(head)
            return tuple([start + rest for rest in rests])
        return tuple(rests)

    def _edits(self, q: int) -> list[tuple[str, str]]:
        """What follows state q in both words of a pair whose words differ from here on."""
        arcs, labels, final = self.arcs[q], self.labels, self.final
        found = []
        for a, b in combinations(arcs, 2):
            p, r = arcs[a], arcs[b]
            if (final[p] and final[r]) or not labels[p].isdisjoint(labels[r]):
                found += [(a + rest, b + rest) for rest in self.common(p, r)]
        for a, p in arcs.items():
            if final[p] and final[q]:
                found.append((a, ""))
            for b in labels[p]:
                if b != a and b in arcs:
                    found += [(a + b + rest, b + rest) for rest in self.common(self.arcs[p][b], arcs[b])]
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of words once, in no order."""
        if not self.alive or not self.alive[self.start]:
            return
        path: list[str] = []
        stack = [(self.start, 0, "")]
        while stack:
            q, depth, label = stack.pop()
            if depth:
                path[depth - 1 :] = [label]
            else:
                path.clear()
            if self.edits[q]:
                before = "".join(path)
                for x, y in self.edits[q]:
                    yield before + x, before + y
            stack.extend((r, depth + 1, c) for c, r in self.arcs[q].items() if self.alive[r])

"""The order-dependent template fold, which runs inside one bounded task and can be carried to the next.

It folds a stream of token lists into clusters. Its whole state is a plain dictionary, so it can be stored between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from logweir.functions.text import WILDCARD


class FixedDepthFold:
    """Clusters of messages of one token count.

    A message is routed by its first ``levels`` tokens to a leaf; there it joins the cluster with the
    highest share of equal constant positions if that is at least ``st``, or founds a cluster. Tokens
    with digits and tokens beyond ``max_child`` branches share the wildcard branch. The first ``skip`` tokens are routed
    already, and ``taken`` branches of the first node lead elsewhere. A cluster's name is that of the message that founded it.
    """

    def __init__(self, levels: int, st: float, max_child: int, state: dict | None = None, skip: int = 0, taken: int = 0):
        self.levels, self.st, self.max_child, self.skip, self.taken = levels, st, max_child, skip, taken
        state = state or {"codes": {}, "words": [], "branches": {}, "leaves": {}}
        self.codes, self.words = state["codes"], state["words"]
        self.branches, self.leaves = state["branches"], state["leaves"]
        # A message that is met again while nothing has changed joins the same cluster and changes nothing.
        self.joined: dict[tuple, tuple[int, int]] = {}
        self.changes = 0

    def state(self) -> dict:
        return {"codes": self.codes, "words": self.words, "branches": self.branches, "leaves": self.leaves}

    def _code(self, tokens: Sequence[str]) -> np.ndarray:
        out = np.empty(len(tokens), dtype=np.int64)
        for i, t in enumerate(tokens):
            if t == WILDCARD:
                out[i] = -1
                continue
            if t not in self.codes:
                self.codes[t] = len(self.words)
                self.words.append(t)
            out[i] = self.codes[t]
        return out

    def _route(self, tokens: Sequence[str], plant: bool) -> tuple | None:
        path: tuple = ()
        for token in tokens[self.skip : self.levels]:
            known = self.branches.setdefault(path, set()) if plant else self.branches.get(path, ())
            if token in known:
                step = token
            elif not plant:
                if WILDCARD not in known:
                    return None
                step = WILDCARD
            else:
                step = self._new_branch(token, known, 0 if path else self.taken)
                known.add(step)
            path += (step,)
        return path

    def _new_branch(self, token: str, known: set, taken: int) -> str:
        if any(c.isdigit() for c in token):
            return WILDCARD
        branches = len(known) + taken
        room = branches < self.max_child if WILDCARD in known else branches + 1 < self.max_child
        return token if room else WILDCARD

    def add(self, tokens: Sequence[str], name: int) -> int:
        key = tuple(tokens)
        before = self.joined.get(key)
        if before is None or before[0] != self.changes:
            cluster = self._join(tokens, name)
            self.joined[key] = before = (self.changes, cluster)
        return before[1]

    def _join(self, tokens: Sequence[str], name: int) -> int:
        row = self._code(tokens)
        leaf = self.leaves.get(self._route(tokens, plant=False))
        if leaf is not None:
            grid = leaf["grid"][: leaf["n"]]
            same = ((grid == row) & (grid != -1)).sum(1)
            rank = same * (len(tokens) + 1) + (grid == -1).sum(1)
            pick = int(rank.argmax())
            if same[pick] / len(tokens) >= self.st:
                merged = np.where(grid[pick] == row, row, -1)
                self.changes += bool((merged != grid[pick]).any())
                grid[pick] = merged
                return leaf["names"][pick]
        leaf = self.leaves.setdefault(self._route(tokens, plant=True), {"grid": np.empty((4, len(tokens)), dtype=np.int64), "n": 0, "names": []})
        if leaf["n"] == len(leaf["grid"]):
            leaf["grid"] = np.concatenate([leaf["grid"], np.empty_like(leaf["grid"])])
        leaf["grid"][leaf["n"]] = row
        leaf["n"] += 1
        leaf["names"].append(name)
        self.changes += 1
        return name

    def templates(self) -> dict[int, list[str]]:
        return {
            cluster: [WILDCARD if c < 0 else self.words[c] for c in row]
            for leaf in self.leaves.values()
            for cluster, row in zip(leaf["names"], leaf["grid"])
        }

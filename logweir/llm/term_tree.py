"""A frequency-ordered prefix tree over the term vectors of a block of documents, searched by branch and bound.

A document's vector holds only terms that some item asks for, most frequent term first, so that documents with the same
frequent terms share a path. Documents lie in the order of their paths; a node is a run of them. A run is split by its next term until it
has at most ``LEAF`` documents, or all vectors in it have ended, or ``DEPTH`` terms are used up; small runs side by side share a leaf.

Each node knows for each term below it the largest tf, and the smallest length norm m. As a term's share of the score grows with tf and falls with m,
both together bound the score of every document below. The search goes depth first, best bound first, and leaves out what cannot
reach the score of the worst document that would be returned; equal scores are looked at, since the smaller id wins.
"""

from __future__ import annotations

import numpy as np

LEAF = 32
DEPTH = 24


def term_share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) in 64-bit integers; 0 where tf is 0."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class TermTree:
    """Vectors: document i has the ranks ``ranks[offsets[i]:offsets[i + 1]]`` (0: most frequent), each with its tf."""

    def __init__(self, offsets: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, terms: int):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(n), sizes)
        order = np.lexsort((ranks, doc))
        ranks, tfs = ranks[order], tfs[order]
        deep = min(DEPTH, int(sizes.max(initial=0)))
        paths = np.full((n, deep), -1, np.int64)
        at = np.arange(len(ranks)) - np.repeat(offsets[:-1], sizes)
        short = at < deep
        paths[doc[short], at[short]] = ranks[short]
        self.rows = np.lexsort((m, *paths.T[::-1]))  # documents in the order of their paths
        self.terms = terms
        place = np.empty(n, np.int64)
        place[self.rows] = np.arange(n)
        order = np.argsort(place[doc], kind="stable")
        self.ranks, self.tfs, self.m = ranks[order], tfs[order], m[self.rows]
        self.offsets = np.r_[0, np.cumsum(sizes[self.rows])]
        self._split(paths[self.rows])
        self._bounds(np.repeat(np.arange(n), sizes[self.rows]))

    def _split(self, paths: np.ndarray) -> None:
        """Nodes in breadth-first order: the children of a node stand together."""
        n, deep = paths.shape
        self.first, self.after, self.children = [0], [n], [(0, 0)]
        self.parent, depths, node = [-1], [0], 0
        while node < len(self.first):
            lo, hi, depth = self.first[node], self.after[node], depths[node]
            runs: list[tuple[int, int, int]] = []
            while hi - lo > LEAF and depth < deep:
                column = paths[lo:hi, depth]
                cuts = lo + np.flatnonzero(column[1:] != column[:-1]) + 1
                if not len(cuts) and column[0] >= 0:  # one shared term: no node of its own
                    depth += 1
                    continue
                edges = [lo, *cuts.tolist(), hi]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if paths[a, depth] < 0 or b - a <= LEAF:
                        runs += [(x, min(b, x + LEAF), deep) for x in range(a, b, LEAF)]
                    else:
                        runs.append((a, b, depth + 1))
                break
            else:
                if hi - lo > LEAF:
                    runs = [(x, min(hi, x + LEAF), deep) for x in range(lo, hi, LEAF)]
            joined: list[tuple[int, int, int]] = []
            for a, b, d in runs:
                if joined and joined[-1][2] == d == deep and b - joined[-1][0] <= LEAF:
                    joined[-1] = (joined[-1][0], b, d)
                else:
                    joined.append((a, b, d))
            if len(joined) > 1 or (joined and joined[0] != (lo, hi, depths[node])):
                self.children[node] = (len(self.first), len(self.first) + len(joined))
                for a, b, d in joined:
                    self.first.append(a)
                    self.after.append(b)
                    self.children.append((0, 0))
                    self.parent.append(node)
                    depths.append(d)
            node += 1

    def _bounds(self, doc: np.ndarray) -> None:
        nodes = len(self.first)
        leaves = [k for k in range(nodes) if self.children[k] == (0, 0)]
        leaf_of = np.zeros(len(self.m) + 1, np.int64)
        least = np.full(nodes, np.iinfo(np.int64).max)
        for k in leaves:
            leaf_of[self.first[k] : self.after[k]] = k
            if self.after[k] > self.first[k]:
                least[k] = self.m[self.first[k] : self.after[k]].min()
        keys, tops = _largest(leaf_of[doc] * self.terms + self.ranks, self.tfs)
        parent = np.array(self.parent)
        found, level = [(keys, tops)], (keys, tops)
        depth = np.zeros(nodes, np.int64)
        for k in range(1, nodes):
            depth[k] = depth[parent[k]] + 1
        for d in range(int(depth.max(initial=0)), 0, -1):
            # What is known of the nodes at depth d goes up to their parents, where it meets that of their sisters.
            of = depth[level[0] // self.terms] == d
            up = parent[level[0][of] // self.terms] * self.terms + level[0][of] % self.terms
            merged = _largest(up, level[1][of])
            found.append(merged)
            rest = ~of
            level = (np.r_[level[0][rest], merged[0]], np.r_[level[1][rest], merged[1]])
        for k in range(nodes - 1, 0, -1):
            least[parent[k]] = min(least[parent[k]], least[k])
        self.least = least
        keys, tops = _largest(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]))
        node, term = keys // self.terms, keys % self.terms
        order = np.lexsort((node, term))
        self.by_term = np.searchsorted(term[order], np.arange(self.terms + 1))
        self.node_of, self.top_of = node[order], tops[order]
        self._column = np.full(self.terms, -1, np.int64)

    def best(self, ranks: np.ndarray, weights: np.ndarray, ids: np.ndarray, most: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``most`` documents with the highest scores of at least ``floor`` (above 0), as their numbers and scores.

        ``ranks`` are distinct terms, ``weights`` their weights times their repeats; of equal scores the smaller ``ids`` go first.
        """
        if not len(ranks) or not len(self.m):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        nodes = len(self.first)
        tops = np.zeros((nodes, len(ranks)), np.int64)
        for j, t in enumerate(ranks.tolist()):
            a, b = self.by_term[t], self.by_term[t + 1]
            tops[self.node_of[a:b], j] = self.top_of[a:b]
        self._column[ranks] = np.arange(len(ranks))
        held_rows, held = np.empty(0, np.int64), np.empty(0, np.int64)
        floor = max(1, floor)
        stack = [(self._bound(tops, 0, 1, weights)[0], 0)]
        while stack:
            bound, node = stack.pop()
            if bound < floor:
                continue
            a, b = self.children[node]
            if a == b:
                rows = np.arange(self.first[node], self.after[node])
                scores = self._scores(self.first[node], self.after[node], len(ranks), weights)
                good = scores >= floor
                if good.any():
                    held_rows, held = np.r_[held_rows, self.rows[rows[good]]], np.r_[held, scores[good]]
                    order = np.lexsort((ids[held_rows], -held))[:most]
                    held_rows, held = held_rows[order], held[order]
                    if len(held) == most:
                        floor = max(floor, int(held[-1]))
                continue
            bounds = self._bound(tops, a, b, weights)
            for k in np.argsort(bounds, kind="stable").tolist():
                if bounds[k] >= floor:
                    stack.append((int(bounds[k]), a + k))
        self._column[ranks] = -1
        return held_rows, held

    def _bound(self, tops: np.ndarray, a: int, b: int, weights: np.ndarray) -> np.ndarray:
        return (term_share(tops[a:b], self.least[a:b, None]) * weights).sum(axis=1)

    def _scores(self, lo: int, hi: int, width: int, weights: np.ndarray) -> np.ndarray:
        a, b = self.offsets[lo], self.offsets[hi]
        column = self._column[self.ranks[a:b]]
        used = column >= 0
        doc = np.repeat(np.arange(hi - lo), np.diff(self.offsets[lo : hi + 1]))[used]
        tf = np.zeros((hi - lo, width), np.int64)
        tf[doc, column[used]] = self.tfs[a:b][used]
        return (term_share(tf, self.m[lo:hi, None]) * weights).sum(axis=1)


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, each with its largest value."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.maximum.reduceat(values, starts) if len(keys) else values

"""A run-compressed Burrows-Wheeler index of a block of strings, and the lengths of its matches.

The block's suffixes are sorted to twice the wanted length by doubling. Within a run of equal letters of the transform, a
suffix's longest match elsewhere is by one letter longer than that of the suffix after it, so match lengths are
computed only at the ends of runs (the samples) and streamed through the text from sample to sample, right to left.
In repetitive text there are few runs.
"""

from __future__ import annotations

import numpy as np

#: Never part of UTF-8 text: it parts the strings of a block.
SEPARATOR = 0xFF


class RunIndex:
    def __init__(self, text: np.ndarray, length: int):
        """``text``: the strings as bytes, each with a separator after it. ``length``: matches are told apart up to it."""
        self.text, self.length = text, length
        self.levels: list[tuple[int, np.ndarray]] = []
        self._sort()
        previous = self.text[self.suffixes - 1].astype(np.int16)
        previous[self.suffixes == 0] = -1
        change = np.r_[True, previous[1:] != previous[:-1], True]
        ends = np.flatnonzero(change[:-1] | change[1:])  # first and last row of every run
        self.runs = int(np.count_nonzero(change)) - 1
        at = np.r_[self.suffixes[ends] - 1, len(text) - 1]
        self.samples = np.unique(at[at >= 0])
        self.sampled = self._matches(self.samples)

    def _sort(self) -> None:
        n = len(self.text)
        padded = np.r_[self.text, np.full(8, SEPARATOR, np.uint8)].astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n]
        width = 8
        order = np.argsort(key)
        ordered = key[order]
        starts = np.r_[True, ordered[1:] != ordered[:-1]]
        rank = np.empty(n, np.int32)  # a suffix's rank is the row at which its group of equal starts begins
        rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        width = 8
        while True:
            self.levels.append((width, rank))
            tied = np.flatnonzero(~(starts & np.r_[starts[1:], True]))
            if width >= self.length or not len(tied):
                break
            places = order[tied]
            after = np.where(places + width < n, rank[np.minimum(places + width, n - 1)], -1)
            key = rank[places].astype(np.int64) * (n + 1) + after + 1
            within = np.argsort(key)
            key, places = key[within], places[within]
            order[tied] = places
            starts[tied] = fresh = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[places] = np.maximum.accumulate(np.where(fresh, tied, 0))
            width *= 2
        self.suffixes = order
        self.row = np.empty(n, np.int64)
        self.row[order] = np.arange(n)

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes, exact below the sorted depth."""
        n, got = len(self.text), np.zeros(len(x), np.int64)
        for width, rank in reversed(self.levels):
            # at the widest level, twice: its ranks tell no more than its own width
            a, b = np.minimum(x + got, n - 1), np.minimum(y + got, n - 1)
            same = (rank[a] == rank[b]) & (x + got < n) & (y + got < n)
            got += np.where(same, width, 0)
        for _ in range(8):
            a, b = x + got, y + got
            inside = (a < n) & (b < n)
            same = inside & (self.text[np.minimum(a, n - 1)] == self.text[np.minimum(b, n - 1)])
            got += same
            if not same.any():
                break
        return got

    def _matches(self, places: np.ndarray) -> np.ndarray:
        row, n = self.row[places], len(self.text)
        before = np.where(row > 0, self._common(places, self.suffixes[np.maximum(row - 1, 0)]), 0)
        after = np.where(row < n - 1, self._common(places, self.suffixes[np.minimum(row + 1, n - 1)]), 0)
        return np.maximum(before, after)

    def match_lengths(self) -> np.ndarray:
        """For every place the length of its longest match that starts elsewhere, right below ``length`` and at least it otherwise."""
        between = np.diff(self.samples, prepend=-1)
        reach = np.repeat(self.samples + self.sampled, between)
        return reach - np.arange(len(self.text))

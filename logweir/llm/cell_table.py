"""Token ids of many texts at once: texts are cut into cells, equal cells are encoded once, and ids are gathered by numpy.

A cell starts at a blank or line end that stands between other characters. For tokenizers that never join what stands before such a place with what comes after it,
a text's ids are those of its cells. Where white space may stand on either side there is no cut, which only makes a longer cell.

Known cells are found by 128 bits of hashes of their bytes, in tables of arrays. They are held in two generations: when the younger one is full it becomes the older one, and
cells that are met again move on. Cells over ``LONG_CELL`` bytes and texts over ``LONG_TEXT`` bytes are encoded as they are.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np

LONG_CELL = 256
LONG_TEXT = 1 << 18
HELD_CELLS = 1 << 21
HELD_IDS = 1 << 24
BLANK, LINE_END = 32, 10

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# First bytes of white space beyond ASCII (and of many other characters).
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_STARTS = np.zeros(256, bool)
_STARTS[[BLANK, LINE_END]] = True
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.cache
def _powers() -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Powers of each base and of its inverse, modulo 2^64."""
    n = 2 * LONG_TEXT + 2
    out = []
    for base in _BASES:
        sides = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            sides.append(np.cumprod(steps))
        out.append(tuple(sides))
    return tuple(out)


def cell_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch of ``data``."""
    values, found = data.astype(np.uint64) + np.uint64(1), []
    for powers, inverse in _powers():
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        found.append(h ^ (h >> np.uint64(29)))
    return found[0], found[1]


class _Generation:
    """Cells by number: two hashes and a place in ``ids``; a table of open addresses leads from the first hash to the number."""

    def __init__(self, dtype: np.dtype, held: int):
        self.mask = np.uint64((1 << (2 * held).bit_length()) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        self.size = self.used = 0
        self.keys, self.checks = np.empty(1024, np.uint64), np.empty(1024, np.uint64)
        self.first, self.count = np.empty(1024, np.int32), np.empty(1024, np.int32)
        self.ids = np.empty(8192, dtype)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Numbers of the cells, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        open_, slots = np.arange(len(keys)), keys & self.mask
        while len(open_):
            number = self.table[slots]
            held = number >= 0
            open_, number, slots = open_[held], number[held], slots[held]
            same = (self.keys[number] == keys[open_]) & (self.checks[number] == checks[open_])
            out[open_[same]] = number[same]
            open_, slots = open_[~same], (slots[~same] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new, distinct cells; ``ids`` hold the ids of one cell after the other."""
        n, size, used = len(keys), self.size, self.used
        numbers = np.arange(size, size + n)
        self.keys, self.checks, self.first, self.count = (_room(a, size + n) for a in (self.keys, self.checks, self.first, self.count))
        self.ids = _room(self.ids, used + len(ids))
        self.keys[size : size + n], self.checks[size : size + n], self.count[size : size + n] = keys, checks, counts
        self.first[size : size + n] = used + np.cumsum(counts) - counts
        self.ids[used : used + len(ids)] = ids
        self.size, self.used = size + n, used + len(ids)
        left, slots = numbers, keys & self.mask
        while len(left):
            free = self.table[slots] < 0
            self.table[slots[free]] = left[free]
            lost = self.table[slots] != left  # taken before, or by another new cell
            left, slots = left[lost], (slots[lost] + np.uint64(1)) & self.mask
        return numbers

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the cells and their ids, one cell after the other."""
        counts = self.count[numbers]
        ends = np.cumsum(counts, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[numbers] - (ends - counts), counts)
        return counts, self.ids[at]


def _room(held: np.ndarray, size: int) -> np.ndarray:
    if size <= len(held):
        return held
    out = np.empty(max(size, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class CellEncoder:
    """Ids of texts with ``end_id`` after each, of two or four bytes as the vocabulary needs."""

    def __init__(self, path: str, end_id: int, held: int = HELD_CELLS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(end_id, *self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.type = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type)
        self.held = held
        self.young, self.old = self._generation(), _Generation(self.type, 0)

    def _generation(self) -> _Generation:
        return _Generation(self.type, max(self.held, 2 * LONG_TEXT))  # a run's cells, their letters and marks always find room

    def _encoded(self, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of cells that are not known."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in cells], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter((i for ids in found for i in ids), self.type, int(counts.sum()))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one run of texts after the other: the ids of all of them, and where each text ends in these."""
        run, held = [], 0
        for text in texts:
            data = text.encode()
            if len(data) > LONG_TEXT:
                if run:
                    yield self._run(run)
                ids = np.append(self._encoded([data])[1], self.end)
                yield ids, np.array([len(ids)])
                run, held = [], 0
                continue
            if held + len(data) + 1 > LONG_TEXT and run:
                yield self._run(run)
                run, held = [], 0
            run.append(data)
            held += len(data) + 1
        if run:
            yield self._run(run)

    def _run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a blank after each text
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        closing = np.cumsum(sizes + 1) - 1
        starts = cell_starts(data, closing)
        ends = np.append(starts[1:], len(data))
        # The blanks that close texts are cells of their own, with the end id.
        last = np.zeros(len(data), bool)
        last[closing] = True
        closes = last[starts]
        counts, ids = self._cells(data, starts[~closes], ends[~closes])
        whole = np.ones(len(starts), np.int64)
        whole[~closes] = counts
        place = np.cumsum(whole)
        out = np.empty(int(place[-1]), self.type)
        ending = np.zeros(len(out), bool)
        ending[place[closes] - 1] = True
        out[ending] = self.end[0]
        out[~ending] = ids
        return out, place[closes]

    def _cells(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of the given cells, in their order."""
        long = ends - starts > LONG_CELL
        if not long.any():
            return self._short(data, starts, ends)
        counts = np.empty(len(starts), np.int64)
        counts[~long], short_ids = self._short(data, starts[~long], ends[~long])
        counts[long], long_ids = self._encoded(_bytes(data, starts[long], ends[long]))
        of_long = np.repeat(long, counts)
        ids = np.empty(len(of_long), self.type)
        ids[of_long], ids[~of_long] = long_ids, short_ids
        return counts, ids

    def _short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.young.size + 2 * len(starts) > self.held or self.young.used > HELD_IDS:
            self.old, self.young = self.young, self._generation()
        return self.young.gather(self._numbers(data, starts, ends, True))

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: bool) -> np.ndarray:
        """Numbers of the cells in the young generation."""
        keys, checks = cell_hashes(data, starts, ends)
        numbers = self.young.find(keys, checks)
        open_ = np.flatnonzero(numbers < 0)
        if not len(open_):
            return numbers
        order = open_[np.lexsort((checks[open_], keys[open_]))]
        fresh = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])]
        new = order[fresh]
        found = self.old.find(keys[new], checks[new])
        known, new_ = new[found >= 0], new[found < 0]
        if len(known):
            numbers[known] = self.young.add(keys[known], checks[known], *self.old.gather(found[found >= 0]))
        body = _body_ends(data, starts[new_], ends[new_]) if part else ends[new_]
        whole = body == ends[new_]
        plain, parted = new_[whole], new_[~whole]
        if len(plain):
            numbers[plain] = self.young.add(keys[plain], checks[plain], *self._encoded(_bytes(data, starts[plain], ends[plain])))
        if len(parted):
            both = np.empty(2 * len(parted), np.int64)
            both[0::2] = self._numbers(data, starts[parted], body[~whole], False)
            both[1::2] = self._numbers(data, body[~whole], ends[parted], False)
            counts, ids = self.young.gather(both)
            numbers[parted] = self.young.add(keys[parted], checks[parted], counts[0::2] + counts[1::2], ids)
        numbers[order] = numbers[new][np.cumsum(fresh) - 1]
        return numbers


def _bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _body_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the marks begin that follow a cell's last letter, which the tokenizers always part from letters; else the cell's end.

    Only a-z, A-Z and the letters of U+00C0 to U+00FF count as letters: their lower case is one letter as well.
    """
    body = ends.copy()
    while True:
        more = np.flatnonzero(_MARK[data[body - 1]] & (body - 1 > starts))
        if not len(more):
            break
        body[more] -= 1
    last, before = data[body - 1], data[np.maximum(body - 2, 0)]
    letter = _LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    return np.where(letter, body, ends)


def cell_starts(data: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """Where cells start: at safe blanks and line ends, at the first byte of each text and at each of the ``closing`` blanks."""
    space, wide = _SPACE[data], _WIDE[data]
    cut = _STARTS[data]
    cut[:-1] &= ~(space | wide)[1:]
    cut[1:] &= ~space[:-1]
    # After white space of several bytes: its last byte is not ASCII and it starts two or three bytes before.
    high = data >= 0x80
    cut[2:] &= ~(high[1:-1] & (data[:-2] == 0xC2))
    cut[3:] &= ~(high[2:-1] & wide[:-3])
    cut[closing] = True
    cut[0] = True
    begins = closing[:-1] + 1
    cut[begins] = True
    return np.flatnonzero(cut)


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> CellEncoder:
    """One encoder per worker, which the worker's later tasks use again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CellEncoder(path, end_id)

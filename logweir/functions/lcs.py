"""Longest common subsequence of two token lists, for use inside Arrow functions."""

from __future__ import annotations

from collections.abc import Sequence

from logweir.functions.text import WILDCARD


def _rows(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """Bit-parallel table (Hyyrö 2004), one big integer per prefix of ``a``.

    Bit j of row i is 0 where the length grows between ``b[:j]`` and ``b[:j + 1]``.
    """
    where: dict[str, int] = {}
    for j, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rows = [full]
    for token in a:
        row = rows[-1]
        hits = row & where.get(token, 0)
        rows.append(((row + hits) | (row - hits)) & full)
    return rows


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    return len(b) - _rows(a, b)[-1].bit_count()


def lcs_tokens(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """The subsequence itself; on ties the walk back shortens ``a`` first, then ``b``."""
    return [b[j] for j in lcs_places(a, b)]


def lcs_places(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """Where the tokens of the subsequence stand in ``b``."""
    rows = _rows(a, b)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j, out = len(a), len(b), []
    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            out.append(j - 1)
            i, j, here = i - 1, j - 1, here - 1
    return out[::-1]


def lcs_template(common: Sequence[str], sequence: Sequence[str]) -> list[str]:
    """``sequence`` with a wildcard in place of every token outside ``common``; the rest after the last
    common token is one wildcard."""
    if not common:
        return []
    out, k = [], 0
    for at, token in enumerate(sequence, 1):
        if token == common[k]:
            out.append(token)
            k += 1
        else:
            out.append(WILDCARD)
        if k == len(common):
            return out + [WILDCARD] if at < len(sequence) else out
    return out

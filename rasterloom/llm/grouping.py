"""Suffix arrays by linear grouping, for a bounded set of texts in one process.

Suffixes are grouped by their Lyndon prefixes. The first pass goes through the groups in
descending order: a member's previous-smaller pointer leads to the suffix whose Lyndon prefix
takes the member's prefix up, and suffixes that so many members lead to leave their group for
a new one just above it. So groups are refined without renaming ranks. The second pass goes
through the suffixes in ascending order and lets each place the suffix before it, and along
the pointers those that it ends.

One group follows on another, so in Python every byte costs interpreter steps (README has the
figures). It serves as an independent check of ``substrings`` on what one process can hold.
"""

from __future__ import annotations

from collections.abc import Sequence


def _grouped(symbols: list[int]) -> tuple[list[int], list[int]]:
    """The start of every suffix's final group in the suffix array, and its previous-smaller pointer."""
    n = len(symbols)
    first: dict[int, int] = {}
    array = sorted(range(n), key=symbols.__getitem__)
    for at, i in enumerate(array):
        first.setdefault(symbols[i], at)
    group = [first[x] for x in symbols]
    where = [0] * n
    for at, i in enumerate(array):
        where[i] = at
    size: dict[int, int] = {}
    for g in group:
        size[g] = size.get(g, 0) + 1
    done, pointer, jump = bytearray(n), [-1] * n, list(range(-1, n - 1))
    end = n
    while end:
        begin = group[array[end - 1]]
        members = array[begin:end]
        for i in members:
            done[i] = 1
        led: dict[int, int] = {}
        for i in members:
            p, trail = jump[i], [i]
            while p >= 0 and done[p]:
                trail.append(p)
                p = jump[p]
            for t in trail:
                jump[t] = p
            pointer[i] = p
            if p >= 0:
                led[p] = led.get(p, 0) + 1
        leaving: dict[tuple[int, int], list[int]] = {}
        for p, times in led.items():
            leaving.setdefault((times, group[p]), []).append(p)
        for (_, g), moved in sorted(leaving.items(), key=lambda x: -x[0][0]):
            top = g + size[g]
            for p in moved:  # to the upper end of their group, which becomes a group of its own
                top -= 1
                other, at = array[top], where[p]
                array[at], where[other], array[top], where[p] = other, at, p, top
            size[g] -= len(moved)
            if top > g:
                size[top] = len(moved)
                for p in moved:
                    group[p] = top
            else:
                size[g] = len(moved)
        end = begin
    return group, pointer


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The places of the suffixes of symbols in ascending order; a suffix comes before those that it begins."""
    n = len(symbols)
    group, pointer = _grouped([*symbols, min(symbols, default=0) - 1])
    free, placed = dict.fromkeys(group), bytearray(n + 1)
    for g in free:
        free[g] = g
    array = [n] * (n + 1)
    placed[n] = 1
    for at in range(n + 1):
        i = array[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            array[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = pointer[i]
    return array[1:]


def common_prefixes(symbols: Sequence[int], array: list[int]) -> list[int]:
    """How many symbols each suffix of the array has in common with the one before it."""
    n, rank, out, k = len(symbols), [0] * len(symbols), [0] * len(symbols), 0
    for at, i in enumerate(array):
        rank[i] = at
    for i in range(n):
        if rank[i]:
            j = array[rank[i] - 1]
            while i + k < n and j + k < n and symbols[i + k] == symbols[j + k]:
                k += 1
            out[rank[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    return out


def repeated(texts: list[bytes], size: int = 100) -> list[list[bool]]:
    """For every byte of every text whether a ``size``-byte string covers it that starts earlier too, texts in their order."""
    symbols, owner = [], []
    for k, text in enumerate(texts):
        symbols += [*text, 256 + k]  # no two texts end alike, so no match crosses an end
        owner += [(k, i) for i in range(len(text) + 1)]
    gone = [[False] * len(x) for x in texts]
    array = suffix_array(symbols)
    prefixes = common_prefixes(symbols, array)
    at = 0
    while at < len(array):
        end = at + 1
        while end < len(array) and prefixes[end] >= size:
            end += 1
        for i in sorted(array[at:end])[1:]:
            k, b = owner[i]
            gone[k][b : b + size] = [True] * size
        at = end
    return gone

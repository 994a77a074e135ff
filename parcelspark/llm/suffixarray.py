"""Suffix arrays by grouping suffixes, and long repeats found with them.

Construction. Suffixes lie in groups by the symbols they begin with, at first one symbol. Groups are taken from the
greatest down. Each suffix of the group at hand points to its previous smaller one, the nearest ahead of it in a lower
group; those pointed at begin with their group's symbols followed by as many copies of this group's as point at them,
and move by that number to new groups right above their old ones. Every suffix then stands in the group of its longest
Lyndon prefix. From the least suffix up, the suffix ahead of each one and its previous smaller ones are next in their
groups. Both passes are linear, and no group is named anew.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a sequence of integers in their order; a suffix comes before what it begins."""
    n = len(symbols) + 1  # with an end that is less than all symbols
    order = np.append(n - 1, np.argsort(symbols, kind="stable"))
    inner = np.asarray(symbols)[order[1:]]
    head = np.concatenate([[True], [True] if n > 1 else [], inner[1:] != inner[:-1]])
    start = np.flatnonzero(head)
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(start, np.diff(np.append(start, n)))
    group, previous = group_of.tolist(), [-1] * n
    size, ending = [0] * n, [0] * (n + 1)  # by a group's start; the start by the end
    members: list = order.tolist()  # by a group's start: its suffixes in their order, some moved meanwhile, or the only one
    bounds = np.append(start, n).tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        size[lo], ending[hi] = hi - lo, lo
        if hi - lo > 1:
            members[lo] = members[lo:hi]

    end = n
    while end:
        g = ending[end]
        held = members[g]
        if end - g == 1:
            i = held
            if type(i) is list:
                for i in held:
                    if group[i] == g:
                        break
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                low = group[j]
                if size[low] > 1:
                    size[low] -= 1
                    new = low + size[low]
                    group[j], size[new], members[new] = new, 1, j
                    ending[new + 1], ending[new] = new, low
        else:
            if len(held) > end - g:
                held = [i for i in held if group[i] == g]
            pointed, times, last = [], [], -1
            for i in held:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    if j == last:
                        times[-1] += 1
                    else:
                        pointed.append(j)
                        times.append(1)
                        last = j
            moves: dict[tuple[int, int], list[int]] = {}
            for j, t in zip(pointed, times, strict=True):
                moves.setdefault((-t, group[j]), []).append(j)
            for (_, low), moved in sorted(moves.items()) if len(moves) > 1 else moves.items():
                left = size[low] - len(moved)
                if left:
                    size[low] = left
                    new = low + left
                    for j in moved:
                        group[j] = new
                    size[new], members[new] = len(moved), moved
                    ending[new + len(moved)], ending[new] = new, low
        end = g

    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            placed[j] = 1
            j = previous[j]
    return np.array(out[1:], np.int64)

"""Suffix array of a row of numbers by linear grouping.

First, suffixes are grouped by their longest Lyndon prefix: groups are taken in
descending order; each suffix of a group points to the nearest suffix before it
in a smaller group, and the suffixes so pointed to, taken by how many of the
group point to them, move to new groups right above their own. Then the groups
are emitted in ascending order: a placed suffix puts the one before it, and those
its pointers lead to, at the front of their groups. Nothing is renamed and there
is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(row: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; a shorter equal one comes first.

    ``row`` holds integers of any range. An empty row has no suffixes.
    """
    n = len(row) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    # The end is the least symbol. Groups are named by where they begin in the
    # final order, so names stay in order when groups are split.
    ranks = np.append(np.unique(row, return_inverse=True)[1] + 1, 0)
    counts = np.bincount(ranks)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    group = begins[ranks].tolist()
    order = np.argsort(ranks, kind="stable")
    members = {
        b: part.tolist()
        for b, part in zip(begins.tolist(), np.split(order, begins[1:]), strict=True)
    }
    size = dict(zip(begins.tolist(), counts.tolist(), strict=True))
    # Where the group that ends at a place begins.
    begin_of = dict(zip((begins + counts).tolist(), begins.tolist(), strict=True))
    before = [-1] * n
    end = n
    while end > 0:
        name = begin_of[end]
        end = name
        pointed: dict[int, int] = {}
        for i in members.pop(name):
            if group[i] != name:
                continue  # has moved up since
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, k in pointed.items():
            by_count.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by_count, reverse=True):
            for old, moved in by_count[k].items():
                left = size[old] - len(moved)
                if not left:
                    continue  # the whole group stays together where it is
                size[old] = left
                new = old + left
                size[new] = len(moved)
                begin_of[new + len(moved)] = new
                begin_of[new] = old
                moved.sort()
                members[new] = moved
                for j in moved:
                    group[j] = new
    out = [-1] * n
    out[0] = n - 1
    front = list(range(n))
    placed = bytearray(n)
    placed[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = before[j]
    return np.array(out[1:], np.int64)

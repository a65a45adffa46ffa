"""Nearest entries for many points by two trees, in integers.

Points and entries are each put into a balanced tree of boxes, split at the median
of the widest component. Both trees are walked down together, level by level, as a
list of pairs (point node, entry node). A pair is dropped when the least distance of
its boxes is above the greatest distance that some other pair of the same point node
can have. Once entry nodes are single entries, a second bound compares two pairs of
a point node: an entry is dropped when another one is nearer all over the box. When
one entry is left for a point node, the whole node is assigned to it and its cached
sum is all that a Lloyd round needs; where several entries are left at a leaf, its
points are compared with them. All bounds are integers, so nothing is lost to
rounding, and ties go to the lower index.

Several independent sets (``g`` of them, of equal size) are handled at once; node
``i`` of set ``s`` at level ``l`` has the number ``s * 2**l + i``, its children are
``2 * number`` and ``2 * number + 1``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 16


class BoxTree:
    """A balanced tree over ``points`` (sets, n, components)."""

    def __init__(self, points: np.ndarray, leaf: int):
        g, n, w = points.shape
        self.height = max(0, (-(-n // leaf) - 1).bit_length())
        self.leaf = -(-n // 2**self.height)
        size = self.leaf << self.height
        # Slots behind the last point repeat it, and count nothing.
        slots = np.broadcast_to(np.arange(size), (g, size))
        sets = np.arange(g)[:, None]
        padded = points[:, np.minimum(np.arange(size), n - 1)]
        for level in range(self.height):
            m = size >> level
            at = padded[sets, slots].reshape(-1, m, w)
            wide = (at.max(axis=1) - at.min(axis=1)).argmax(axis=1)
            value = np.take_along_axis(at, wide[:, None, None], axis=2)[:, :, 0]
            half = np.argpartition(value, m // 2, axis=1)
            slots = np.take_along_axis(slots.reshape(-1, m), half, axis=1).reshape(g, size)
        self.slots = slots
        self.real = slots < n
        self.row = np.minimum(slots, n - 1)
        self.points = padded[sets, slots].reshape(-1, self.leaf, w)
        real = self.real.reshape(-1, self.leaf)
        boxes = [(self.points.min(axis=1), self.points.max(axis=1))]
        sums = [(real.sum(axis=1), (self.points * real[:, :, None]).sum(axis=1))]
        for _ in range(self.height):
            lo, hi = boxes[-1]
            boxes.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
            n_in, s = sums[-1]
            sums.append((n_in[::2] + n_in[1::2], s[::2] + s[1::2]))
        # By level, from the root down.
        self.boxes = boxes[::-1]
        self.sums = sums[::-1]


@dataclass
class Assigned:
    """Whole nodes by level, (level, nodes, entries), and the points of open leaves."""

    whole: list[tuple[int, np.ndarray, np.ndarray]]
    leaves: np.ndarray
    entries: np.ndarray  # an entry for each point of each open leaf
    measured: int


def _beaten(a: np.ndarray, entry: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Pairs whose entry is further than the entry nearest the box's middle, all over it.

    |x - e|^2 - |x - f|^2 is linear in x, so its least value is found at a corner.
    """
    if not len(a):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    runs = np.diff(np.append(starts, len(a)))
    middle = 2 * entry - lo - hi
    off = np.einsum("ij,ij->i", middle, middle)
    first = off == np.repeat(np.minimum.reduceat(off, starts), runs)
    place = np.flatnonzero(first)
    nearest = place[np.unique(a[place], return_index=True)[1]]
    f = np.repeat(entry[nearest], runs, axis=0)
    away = 2 * (f - entry)
    corner = np.where(away > 0, lo, hi)
    least = np.einsum("ij,ij->i", entry - f, entry + f) + np.einsum("ij,ij->i", away, corner)
    return least > 0


def assign(points: BoxTree, entries: BoxTree, n_entries: int) -> Assigned:
    """The nearest entry of every point; ``entries`` is a tree with leaves of one."""
    g = len(points.boxes[0][0])
    a = b = np.arange(g)
    whole = []
    for level in range(max(points.height, entries.height) + 1):
        at, of = min(level, points.height), min(level, entries.height)
        (plo, phi), (elo, ehi) = points.boxes[at], entries.boxes[of]
        plo, phi, elo, ehi = plo[a], phi[a], elo[b], ehi[b]
        gap = np.maximum(np.maximum(elo - phi, plo - ehi), 0)
        reach = np.maximum(np.abs(ehi - plo), np.abs(phi - elo))
        least = np.einsum("ij,ij->i", gap, gap)
        most = np.einsum("ij,ij->i", reach, reach)
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        bound = np.repeat(
            np.minimum.reduceat(most, starts) if len(a) else most,
            np.diff(np.append(starts, len(a))),
        )
        keep = least <= bound
        a, b = a[keep], b[keep]
        if of == entries.height:
            keep = ~_beaten(a, elo[keep], plo[keep], phi[keep])
            a, b = a[keep], b[keep]
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            runs = np.diff(np.append(starts, len(a)))
            alone = np.repeat(runs == 1, runs)
            if alone.any():
                whole.append((at, a[alone], entries.row.ravel()[b[alone]]))
                a, b = a[~alone], b[~alone]
        if not len(a) or level == max(points.height, entries.height):
            break
        a = np.repeat(2 * a, 2) + np.tile([0, 1], len(a)) if at < points.height else a
        b = np.repeat(b, 2) if at < points.height else b
        if of < entries.height:
            a = np.repeat(a, 2)
            b = np.repeat(2 * b, 2) + np.tile([0, 1], len(b))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    if not len(a):
        return Assigned(whole, a, np.zeros((0, points.leaf), np.int64), 0)
    index = entries.row.ravel()[b]
    there, at = points.points[a], entries.points[b, 0]
    distance = np.zeros(there.shape[:2], np.int64)
    for j in range(there.shape[2]):
        apart = there[:, :, j] - at[:, None, j]
        distance += apart * apart
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    best = np.minimum.reduceat(distance * n_entries + index[:, None], starts, axis=0)
    return Assigned(whole, a[starts], best % n_entries, distance.size)


def sums_of(points: BoxTree, found: Assigned, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (sets, entries) and sums (sets, entries, components) of the points."""
    g, w = len(points.boxes[0][0]), points.points.shape[2]
    counts = np.zeros(g * n_entries, np.int64)
    sums = np.zeros((g * n_entries, w), np.int64)
    for level, nodes, entry in found.whole:
        key = (nodes >> level) * n_entries + entry
        n, s = points.sums[level]
        np.add.at(counts, key, n[nodes])
        np.add.at(sums, key, s[nodes])
    real = points.real.reshape(-1, points.leaf)[found.leaves]
    key = ((found.leaves >> points.height)[:, None] * n_entries + found.entries)[real]
    np.add.at(counts, key, 1)
    np.add.at(sums, key, points.points[found.leaves][real])
    return counts.reshape(g, n_entries), sums.reshape(g, n_entries, w)


def codes_of(points: BoxTree, found: Assigned, n: int) -> np.ndarray:
    """The entry of each point, (sets, n), in the order in which points were given."""
    leaves = np.zeros((len(points.points), points.leaf), np.int64)
    for level, nodes, entry in found.whole:
        leaves.reshape(-1, points.leaf << (points.height - level))[nodes] = entry[:, None]
    leaves[found.leaves] = found.entries
    g = len(points.boxes[0][0])
    out = np.empty((g, n), np.int64)
    sets = np.broadcast_to(np.arange(g)[:, None], points.slots.shape)
    out[sets[points.real], points.slots[points.real]] = leaves.reshape(g, -1)[points.real]
    return out

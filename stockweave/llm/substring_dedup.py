"""Substring dedup of word runs by difference-cover anchors.

Anchors are short runs of words that start at places of a difference cover modulo
a period. Wherever two long runs are equal, some shift puts both on the cover, so
they share an anchor at the same distance. Anchors found only once rule out all
runs around them; around the others the full runs are hashed and asked for.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame

from stockweave.llm.groups import Groups, shared
from stockweave.llm.hashing import BLANK, LETTERS, ROLLERS, U, word_places

WINDOW = 35

# Anchors and windows: an odd kind has keys of one number, an even kind of two.
ANCHORS, WINDOWS = 1, 2


def difference_cover(period: int) -> list[int]:
    """The first smallest set with every difference modulo ``period``."""
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    raise ValueError("no cover")


# Period 31 has a cover of six places; its anchors are as long as a window less
# the largest shift.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)


class Words:
    """The words of the texts of a group in one row, with hashes of their runs."""

    def __init__(self, texts: list[bytes], window: int):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        start, end = word_places(raw)
        lengths = np.array([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(np.cumsum(lengths), start, side="right")
        counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.place = np.arange(len(start)) - self.first[self.doc]
        self.left = counts[self.doc] - self.place  # words from here to the end
        self.sums = []
        for which, roller in enumerate(ROLLERS):
            words = roller.stretches(roller.sums(LETTERS[which][raw]), start, end)
            self.sums.append(roller.sums(words))
        self.window = window

    def runs(self, at: np.ndarray, size: int, which: int) -> np.ndarray:
        return ROLLERS[which].stretches(self.sums[which], at, at + size)

    def anchors(self, period: int, cover) -> tuple[np.ndarray, np.ndarray]:
        size = self.window - period + 1
        on = np.zeros(period, bool)
        on[list(cover)] = True
        at = np.flatnonzero(on[self.place % period] & (self.left >= size))
        return at, self.runs(at, size, 0).reshape(-1, 1)

    def windows(self, anchors: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold an anchor, and their keys."""
        marks = np.zeros(len(self.place) + 1, np.int64)
        marks[1:][anchors] = 1
        marks = np.cumsum(marks)
        at = np.flatnonzero(self.left >= self.window)
        at = at[marks[at + period] > marks[at]]
        return at, np.stack([self.runs(at, self.window, k) for k in (0, 1)], axis=1)


def dedup_runs(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """Remove words covered by a run of ``window`` words that starts elsewhere too.

    Returns all columns of ``df`` with the kept words, joined by one space, as the
    text, then ``n_words`` and ``n_removed``. Every place of such a run loses it, in
    the same document or in others; runs are judged on the input.

    Words are stretches without ASCII white space, unchanged. A null or empty text
    has none and becomes an empty one. Repeated rows repeat each other's runs.
    Rows with a null ``doc_id`` take part like others. An empty table gives an
    empty table. Columns of the new names are replaced. Documents shorter than
    ``window`` words lose nothing. ``doc_id`` must be integral.
    """
    groups = Groups(df, text, doc_id, ("n_words", "n_removed"))
    n_anchors = groups.buckets(groups.size / 6 * len(cover) / period)
    n_windows = groups.buckets(groups.size / 6)

    def anchor_keys(texts, bits):
        return Words(texts, window).anchors(period, cover)[1]

    def candidates(texts, bits):
        words = Words(texts, window)
        at, keys = words.anchors(period, cover)
        return words, *words.windows(at[shared(keys, n_anchors, bits.get(ANCHORS, {}))], period)

    def window_keys(texts, bits):
        return candidates(texts, bits)[2]

    def rewritten(docs, texts, bits):
        words, at, keys = candidates(texts, bits)
        at = at[shared(keys, n_windows, bits.get(WINDOWS, {}))]
        step = np.zeros(len(words.place) + window + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
        gone = np.cumsum(step)[: len(words.place)] > 0
        kept, n_words, n_removed = [], [], []
        for k, t in enumerate(texts):
            own = gone[words.first[k] : words.first[k + 1]]
            n_words.append(len(own))
            n_removed.append(int(own.sum()))
            parts = t.split()
            if n_removed[-1]:
                parts = itertools.compress(parts, (~own).tolist())
            kept.append(b" ".join(parts).decode(errors="replace"))
        return kept, n_words, n_removed

    anchors = groups.ask(anchor_keys, None, ANCHORS, n_anchors)
    windows = groups.ask(window_keys, anchors, WINDOWS, n_windows)
    return groups.rewrite(
        rewritten,
        anchors.union(windows),
        [("kept", "string"), ("n_words", "bigint"), ("n_removed", "bigint")],
        text,
        doc_id,
    )

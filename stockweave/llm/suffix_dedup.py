"""Suffix-array dedup of byte strings.

Every 100-byte string holds an anchor, the least hash of 8 bytes in it, which
equal strings have at the same place. Anchors found only once rule out all the
strings they stand for. Around the others, the bytes of those strings (a context)
go to a bucket by anchor. A bucket sorts all suffixes of its contexts: contexts
are cut into units at places that depend only on the bytes behind them, the
suffixes at cuts are sorted by linear grouping, and those between cuts by their
stretch up to the next cut and the order there. Equal strings are then neighbours,
and all but those of the earliest place are answered as repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockweave.llm.groups import (
    ANSWER_KINDS,
    ANSWERS,
    LEAST_BUCKETS,
    Groups,
    shared,
    to_table,
)
from stockweave.llm.hashing import LETTERS, ROLLERS, U, mix
from stockweave.llm.suffix_array import suffix_array

LENGTH = 100

# Bytes that order anchors, and bytes that name them.
SHORT, NAME = 8, 32

# A cut stands where 3 bytes hash to a multiple of CUT, or where no such place is
# among the next REACH. The bytes that settle the cut after a place, and that cut,
# lie within REACH + 1 + REACH + 3 <= LENGTH bytes.
CUT, REACH, TRIGGER = 12, 48, 3

# Spreads the upper bits of the 8 bytes that order anchors.
ORDER = U(0x9E3779B97F4A7C15)

# Bytes of contexts in a bucket, on average.
BUCKET_BYTES = 4_000_000

# An anchor that more groups have is hot: of its strings only those that occur
# again are sorted, since around a common passage each document has other bytes.
HOT_GROUPS = 128

# Kinds of answers; an even kind has keys of two numbers.
ANCHORS, HOT, HOT_STRINGS, STRINGS = 1, 3, 2, 5


def loads(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number (zeros behind the end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw), "<u8", padded, strides=(1,)).astype(U)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` numbers, the place of the least, leftmost first.

    Numbers are compared by their upper bits; the lower ones make room for places.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U((1 << len(values).bit_length()) - 1)
    blocks = -(-len(values) // width)
    tagged = np.full(blocks * width, ~U(0))
    part = tagged[: len(values)]
    np.bitwise_and(values, ~low, out=part)
    part |= np.arange(len(values), dtype=U)
    grid = tagged.reshape(blocks, width)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    ahead = np.minimum.accumulate(grid, axis=1, out=grid).reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    least &= low
    return least.view(np.int64)


class Strings:
    """All strings of LENGTH bytes of a group's texts, run by run of equal anchors."""

    def __init__(self, texts: list[bytes], length: int):
        self.blob = b"".join(texts)
        raw = np.frombuffer(self.blob, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        eight = loads(raw)
        places = least_places(eight * ORDER, length - NAME + 1)
        # A run ends where the anchor changes, and with the strings of a text.
        change = np.flatnonzero(places[1:] != places[:-1]) + 1
        begins = self.begins[:-1]
        run = np.union1d(change, begins[sizes >= length])
        doc = np.searchsorted(self.begins, run, side="right") - 1
        stop = np.append(run[1:], len(raw))
        stop = np.minimum(stop, self.begins[doc + 1] - length + 1)
        some = run < stop
        run, doc = run[some], doc[some]
        self.doc, self.low, self.anchor = doc, run, places[run]
        self.count = stop[some] - run
        key = np.zeros(len(run), U)
        for k in range(0, NAME, 8):
            key = mix(key * U(0x9E3779B97F4A7C15) + eight[self.anchor + k])
        self.keys = key.reshape(-1, 1)


    def hot_strings(self, runs: np.ndarray, length: int) -> np.ndarray:
        """Keys of all strings of some runs."""
        at = self.at_of(runs)
        raw = np.frombuffer(self.blob, np.uint8)
        return np.stack(
            [r.stretches(r.sums(LETTERS[k][raw]), at, at + length) for k, r in enumerate(ROLLERS)],
            axis=1,
        ) if len(at) else np.zeros((0, 2), U)

    def at_of(self, runs: np.ndarray) -> np.ndarray:
        count = self.count[runs]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(self.low[runs], count) + inside


@dataclass(slots=True)
class Context:
    """Distinct bytes of a run of strings, and (text, start) of each place they stand."""

    key: int
    data: bytes
    count: int
    anchor: int
    places: list[tuple[int, int]]


def contexts(strings: Strings, runs: list[tuple[int, int, int, int, int]], length: int):
    """The distinct contexts of runs (text, start, count, key, anchor), earliest first."""
    found: dict[bytes, Context] = {}
    for doc, low, count, key, anchor in runs:
        data = strings.blob[low : low + count + length - 1]
        if data in found:
            found[data].places.append((doc, low))
        else:
            found[data] = Context(key, data, count, anchor - low, [(doc, low)])
    return list(found.values())


def cuts_of(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a cut stands at each place of the contexts that end at ``ends``."""
    n = len(raw)
    code = LETTERS[0][raw]
    hashed = code.copy()
    hashed[:-1] += code[1:] * U(3)
    hashed[:-2] += code[2:] * U(5)
    here = mix(hashed) % U(CUT) == 0
    # Three bytes must be there before the context ends.
    left = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n)
    here &= left >= TRIGGER
    count = np.concatenate([[0], np.cumsum(here)])
    at = np.arange(n)
    stop = np.minimum(at + REACH + 1, at + left)
    return here | (count[stop] - count[np.minimum(at + 1, stop)] == 0)


def shared_spans(data: list[bytes], keys, anchors, length: int):
    """First and last (excluded) string of each context that another may repeat.

    Contexts of one key agree at their anchors. How far a context agrees with any
    other one, to the right of the anchor and to the left, is how far it agrees with
    a neighbour in the order of these sides.
    """
    n = len(data)
    sizes = np.array([len(d) for d in data])
    reach = []
    for sides in (
        [d[a : a + length] for d, a in zip(data, anchors.tolist(), strict=True)],
        [d[max(0, a - length) : a][::-1] for d, a in zip(data, anchors.tolist(), strict=True)],
    ):
        order = sorted(range(n), key=lambda i: (keys[i], sides[i]))  # noqa: B023
        rows = np.frombuffer(b"".join([sides[i].ljust(length, b"\0") for i in order]), np.uint8)
        rows = rows.reshape(n, length)
        size = np.array([len(sides[i]) for i in order])
        same = np.ones((n - 1, length + 1), bool)
        same[:, :length] = rows[1:] != rows[:-1]
        alike = np.minimum(np.argmax(same, axis=1), np.minimum(size[1:], size[:-1]))
        alike[keys[order][1:] != keys[order][:-1]] = 0
        best = np.zeros(n, np.int64)
        best[1:] = alike
        best[:-1] = np.maximum(best[:-1], alike)
        out = np.empty(n, np.int64)
        out[order] = best
        reach.append(out)
    right, left = reach
    first = np.maximum(0, anchors - left)
    stop = np.minimum(sizes - length + 1, anchors - length + right + 1)
    return first, stop


def repeated_strings(
    data: list[bytes], counts: list[int], ranks: np.ndarray, length: int
) -> np.ndarray:
    """For each string of each context: is the least rank of its equals smaller.

    ``ranks[i]`` orders the first strings of the contexts; string ``k`` of context
    ``i`` has rank ``ranks[i] + k``, and no two contexts' ranks overlap unless they
    are the same place.
    """
    blob = b"".join(data)
    raw = np.frombuffer(blob, np.uint8)
    sizes = np.array([len(d) for d in data], np.int64)
    ends = np.cumsum(sizes)
    cut = cuts_of(raw, ends)
    begin = ends - sizes
    cut[begin] = True
    places = np.flatnonzero(cut)
    after = np.append(places[1:], len(raw))
    # A unit runs to the next cut and holds the bytes that settle it, so no unit
    # begins another one; the last of a context ends with it.
    end = ends[np.searchsorted(ends, places, side="right")]
    settle = np.where(
        after < end, np.where(_triggered(raw, after, end), TRIGGER, REACH + TRIGGER), 0
    )
    stop = np.minimum(after + settle, end)
    units = [blob[a:b] for a, b in zip(places.tolist(), stop.tolist(), strict=True)]
    order = {u: k for k, u in enumerate(sorted(set(units)), 1)}
    symbols = np.array([order[u] for u in units], np.int64)
    # A least symbol behind each context ends its last suffix.
    last = np.flatnonzero(after == end)
    row = np.insert(symbols, last + 1, 0)
    spot = np.arange(len(symbols)) + np.searchsorted(last, np.arange(len(symbols)))
    rank = np.empty(len(row), np.int64)
    rank[suffix_array(row)] = np.arange(len(row))
    rank_of = np.zeros(len(raw) + 1, np.int64)
    rank_of[places] = rank[spot]
    # All strings: by the stretch to the next cut, then by the order there.
    which = np.repeat(np.arange(len(data)), counts)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[which] + inside
    nxt = places[np.searchsorted(places, start, side="right")]
    roller = ROLLERS[0]
    stretch = roller.stretches(roller.sums(LETTERS[0][raw]), start, nxt)
    by = np.lexsort([rank_of[nxt], stretch])
    start_by = start[by]
    equal = np.zeros(len(by), bool)
    step = 100_000
    span = np.arange(length)
    for k in range(1, len(by), step):
        a, b = start_by[k - 1 : k - 1 + step], start_by[k : k + step]
        a = a[: len(b)]
        equal[k : k + len(b)] = (raw[a[:, None] + span] == raw[b[:, None] + span]).all(axis=1)
    place = (ranks[which] + inside)[by]
    heads = np.flatnonzero(~equal)
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(by))))
    out = np.empty(len(by), bool)
    out[by] = place > least
    return out


def _triggered(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether three bytes from ``at`` on make a cut by themselves."""
    n = len(raw) - 1
    code = LETTERS[0]
    hashed = (
        code[raw[np.minimum(at, n)]]
        + code[raw[np.minimum(at + 1, n)]] * U(3)
        + code[raw[np.minimum(at + 2, n)]] * U(5)
    )
    return (mix(hashed) % U(CUT) == 0) & (at + TRIGGER <= end)


def remove_repeats(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH
) -> DataFrame:
    """Remove bytes covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller ``doc_id``, or an earlier start in the same document.
    Strings are judged on the input and never cross documents. Returns all columns
    of ``df`` with the remaining bytes (binary) as the text, then ``n_bytes``,
    ``n_removed`` and ``n_spans`` (maximal removed runs).

    A null or empty text has no bytes. Rows that share a ``doc_id`` are not earlier
    than each other at the same start, so repeated rows keep and lose the same.
    A null ``doc_id`` comes before all others. An empty table gives an empty table.
    Columns of the new names are replaced. ``doc_id`` must be integral, ``length``
    at least 100.
    """
    if length < 2 * REACH + 1 + TRIGGER:
        raise ValueError("strings must be long enough to settle their cuts")
    groups = Groups(df, text, doc_id, ("n_bytes", "n_removed", "n_spans"))
    n_anchors = groups.buckets(groups.size / 25)
    n_strings = groups.buckets(groups.size / 10)
    n_buckets = int(max(LEAST_BUCKETS, groups.size // BUCKET_BYTES + 1))

    def runs_of(texts, bits):
        strings = Strings(texts, length)
        again = shared(strings.keys, n_anchors, bits.get(ANCHORS, {}))
        hot = again & shared(strings.keys, n_anchors, bits.get(HOT, {}))
        return strings, np.flatnonzero(again & ~hot), np.flatnonzero(hot)

    def anchor_keys(texts, bits):
        return Strings(texts, length).keys

    def hot_keys(texts, bits):
        strings, _, hot = runs_of(texts, bits)
        return strings.hot_strings(hot, length)

    def found(texts, bits):
        strings, usual, hot = runs_of(texts, bits)
        keys = strings.keys[:, 0]
        runs = list(
            zip(*[x[usual].tolist() for x in
                  (strings.doc, strings.low, strings.count, keys, strings.anchor)], strict=True)
        )
        if len(hot):
            # Stretches of hot runs that occur again.
            again = shared(strings.hot_strings(hot, length), n_strings, bits[HOT_STRINGS])
            at, of = strings.at_of(hot), np.repeat(hot, strings.count[hot])
            at, of = at[again], of[again]
            first = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(of, prepend=-9) != 0))
            counts = np.diff(np.append(first, len(at)))
            runs += zip(
                strings.doc[of[first]].tolist(), at[first].tolist(), counts.tolist(),
                keys[of[first]].tolist(), strings.anchor[of[first]].tolist(), strict=True,
            )
            runs.sort()
        some = contexts(strings, runs, length)
        some.sort(key=lambda c: (c.key % n_buckets, c.key, c.data))
        return strings, some

    def send(docs, texts, bits):
        strings, some = found(texts, bits)
        ids = docs.to_pylist()
        rows: dict[int, list] = {}
        for c in some:
            d, low = c.places[0]
            rows.setdefault(c.key % n_buckets, []).append(
                (c.data, c.key, ids[d], low - int(strings.begins[d]), c.anchor)
            )
        return [
            (
                b,
                b"".join(r[0] for r in part),
                np.array([(len(r[0]), r[4]) for r in part], "<i4").tobytes(),
                np.array([r[1] for r in part], "<u8").tobytes(),
                np.array([(-(1 << 63) if r[2] is None else r[2], r[3]) for r in part], "<i8")
                .tobytes(),
            )
            for b, part in sorted(rows.items())
        ]

    def rewritten(docs, texts, bits):
        strings, some = found(texts, bits)
        ids = docs.to_pylist()
        gone = np.zeros(len(strings.blob) + 1, np.int64)
        flags, last = {}, {}
        for b, raw in bits.get(STRINGS, {}).items():
            flags[b] = np.unpackbits(np.frombuffer(raw, np.uint8))
        for c in some:
            b = c.key % n_buckets
            at = last.get(b, 0)
            own = flags[b][at : at + c.count].astype(bool)
            last[b] = at + c.count
            d, low = c.places[0]
            head = (ids[d], low - strings.begins[d])
            for e, low in c.places:
                if (ids[e], low - strings.begins[e]) != head:
                    # A run that repeats an earlier one goes whole.
                    gone[low] += 1
                    gone[low + c.count + length - 1] -= 1
                elif own.any():
                    at_k = low + np.flatnonzero(own)
                    gone[at_k] += 1
                    np.add.at(gone, at_k + length, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        raw = np.frombuffer(strings.blob, np.uint8)
        for i, t in enumerate(texts):
            own = gone[strings.begins[i] : strings.begins[i + 1]]
            n = int(own.sum())
            n_bytes.append(len(t))
            n_removed.append(n)
            n_spans.append(int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()) if n else 0)
            part = raw[strings.begins[i] : strings.begins[i + 1]]
            kept.append(part[~own].tobytes() if n else t)
        return kept, n_bytes, n_removed, n_spans

    anchors = groups.ask(anchor_keys, None, ANCHORS, n_anchors, wide=(HOT, HOT_GROUPS))
    hot = groups.ask(hot_keys, anchors, HOT_STRINGS, n_strings)
    so_far = anchors.union(hot)
    sent = groups.run(
        send, so_far, "p int, bucket int, data binary, sizes binary, keys binary, places binary"
    )
    strings = sent.groupBy("bucket").applyInArrow(_sorted_bucket(length), ANSWERS)
    return groups.rewrite(
        rewritten,
        so_far.union(strings),
        [("kept", "binary"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint")],
        text,
        doc_id,
    )


def _sorted_bucket(length: int):
    """For a bucket: which strings of each group's contexts also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        data, counts, anchors, keys, places, owner = [], [], [], [], [], []
        for row, (blob, sizes, key, place) in enumerate(
            zip(*[table.column(c).to_pylist() for c in ("data", "sizes", "keys", "places")],
                strict=True)
        ):
            at = 0
            for n, anchor in np.frombuffer(sizes, "<i4").reshape(-1, 2).tolist():
                data.append(blob[at : at + n])
                counts.append(n - length + 1)
                anchors.append(anchor)
                at += n
            keys.append(np.frombuffer(key, "<u8"))
            places.append(np.frombuffer(place, "<i8").reshape(-1, 2))
            owner += [row] * len(keys[-1])
        keys, places = np.concatenate(keys), np.concatenate(places)
        flags: list = [None] * len(data)
        # Equal contexts of several groups: the earliest stands for all.
        order = np.lexsort([places[:, 1], places[:, 0]])
        heads: dict[bytes, int] = {}
        copies: list[tuple[int, int]] = []
        for i in order.tolist():
            if data[i] in heads:
                copies.append((i, heads[data[i]]))
            else:
                heads[data[i]] = i
        alone = np.unique(keys[list(heads.values())], return_counts=True)
        alone = dict(zip(alone[0].tolist(), alone[1].tolist(), strict=True))
        some = []
        for i in heads.values():
            if alone[int(keys[i])] > 1:
                some.append(i)
            else:  # the only context of its anchor
                flags[i] = np.zeros(counts[i], bool)
        if some:
            # Only strings inside what a context shares with another one can repeat.
            first, stop = shared_spans(
                [data[i] for i in some], keys[some], np.array([anchors[i] for i in some]), length
            )
            for i in np.array(some)[stop <= first].tolist():
                flags[i] = np.zeros(counts[i], bool)
            keep = np.flatnonzero(stop > first)
            some, first, stop = np.array(some)[keep].tolist(), first[keep], stop[keep]
        if some:
            # Ranks follow (id, start) and leave room for the strings of a context.
            ids, starts = places[some, 0], places[some, 1] + first
            by = np.lexsort([starts, ids])
            new_doc = np.append(False, ids[by][1:] != ids[by][:-1])
            room = int((stop - first).max()) + int(starts.max()) + 1
            ranks = np.empty(len(some), np.int64)
            ranks[by] = np.cumsum(new_doc) * room + starts[by]
            spans = list(zip(some, first.tolist(), stop.tolist(), strict=True))
            n = [b - a for _, a, b in spans]
            found = repeated_strings(
                [data[i][a : b + length - 1] for i, a, b in spans], n, ranks, length
            )
            for (i, a, b), part in zip(spans, np.split(found, np.cumsum(n)[:-1]), strict=True):
                flags[i] = np.zeros(counts[i], bool)
                flags[i][a:b] = part
        for i, head in copies:
            same = (places[i] == places[head]).all()
            flags[i] = flags[head] if same else np.ones(counts[i], bool)
        p, parts = table.column("p").to_pylist(), [[] for _ in range(table.num_rows)]
        for row, flag in zip(owner, flags, strict=True):
            parts[row].append(flag)
        return to_table(
            [(g, STRINGS, bucket, np.packbits(np.concatenate(x)).tobytes())
             for g, x in zip(p, parts, strict=True)],
            ANSWER_KINDS,
        )

    return run

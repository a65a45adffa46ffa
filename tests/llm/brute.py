"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lines(docs, least=3, chars=20):
    """(id, text) to a list of (id, n_lines, n_dropped, kept)."""
    keys = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None:
                keys.setdefault(line.strip(BLANKS).translate(LOWER), set()).add(i)
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = []
        for line in parts:
            k = line.strip(BLANKS).translate(LOWER)
            drop = i is not None and len(k) >= chars and len(keys[k]) >= least
            if not (drop and i != max(keys[k])):
                kept.append(line)
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def runs(docs, window=35):
    """(id, text) to a list of (id, n_words, n_removed, kept)."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    found = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if found[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept))
    return out


def strings(docs, length=100):
    """(id, text) to a list of (id, n_bytes, n_removed, n_spans, kept)."""
    first = {}
    rank = lambda i: (i is not None, i or 0)
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            place = (*rank(i), s)
            key = b[s : s + length]
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (*rank(i), s):
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return out


def bag(text, words=5):
    w = (text or "").encode().lower().split()
    k = min(words, len(w))
    return Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else Counter()


def similarity(a, b):
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def classes(docs, least=0.8):
    """(id, text) to {id: smallest id of its class}."""
    bags = [(i, bag(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if similarity(a, b) >= least - 1e-12:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def overlaps(docs, items, window=13, least=10):
    """Pairs (doc, item) with at most two tokens of a window of the item substituted."""
    out = set()
    for i, t in docs:
        w = tokens(t)
        for item, text in items:
            v = tokens(text)
            if not v:
                continue
            size = min(window, len(v))
            wrong = 2 if len(v) >= window else 1 if len(v) >= least else 0
            for d in range(-len(v) + 1, len(w)):
                same = [0 <= d + j < len(w) and w[d + j] == v[j] for j in range(len(v))]
                if any(sum(same[s : s + size]) >= size - wrong for s in range(len(v) - size + 1)):
                    out.add((i, item))
                    break
    return out

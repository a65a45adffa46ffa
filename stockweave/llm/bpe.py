"""Encoding and decoding with a word-end BPE vocabulary by a pair occurrence index.

The distinct words of a slice of a partition are laid out in one row of symbols.
An index maps each mergeable pair to all its places there; the active ranks are
taken in ascending order, all places of a rank are merged, and the lists of the
pairs to the left and right of each place are updated.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.common import worker_state

# Rows that are encoded and sent on at a time.
ROWS = 1000

# Bytes of text whose new words are indexed together, and fragments that a task
# remembers before it starts anew. Neither changes the result.
SLICE_BYTES = 8_000_000
KEEP_WORDS = 300_000

# ASCII form of the split pattern of the vocabulary file (fixed value).
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


class PairIndexBpe:
    """Words to ids and ids to text for one vocabulary file of the library."""

    def __init__(self, model_text: str):
        from tokenizers import Tokenizer

        spec = json.loads(model_text)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        unsupported = [
            model.get(k)
            for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")
        ]
        if spec.get("decoder") or model["type"] != "BPE" or any(unsupported):
            raise ValueError("only plain BPE files without a decoder are supported")
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]
               for a in spec["added_tokens"]):
            raise ValueError("added tokens must be taken from the text as they are")
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters])
        self.last = np.array([vocab[x + suffix] for x in letters])
        self.merges, keys = [], []
        made: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            # All places of a rank can be merged at once only if no later merge
            # makes a part of an earlier pair.
            if new in made or made.get(left, -1) >= r or made.get(right, -1) >= r:
                raise ValueError(f"merge {r} is not in the order of its parts")
            made[new] = r
            self.merges.append((left, right, new))
            keys.append(left << 20 | right)
        self.key_ranks = np.argsort(np.array(keys))
        self.keys = np.array(keys)[self.key_ranks]
        self.token = {i: t.encode() for t, i in {**vocab, **added}.items()}
        self.added = added
        self.special = (
            re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
            if added
            else None
        )
        library = Tokenizer.from_str(model_text)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer
        self.byte_of = {x: b for b, x in enumerate(letters)}

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        total = int(sizes.sum())
        if not total:
            return [np.zeros(0, np.int64) for _ in words]
        ends = np.cumsum(sizes)
        symbols = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        final = ends[sizes > 0] - 1
        symbols[final] = self.last[np.frombuffer(b"".join(words), np.uint8)[final]]
        after = np.arange(1, total + 1)
        after[final] = -1
        before = np.arange(-1, total - 1)
        before[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray, right: np.ndarray) -> None:
            """Enter the pairs that start at ``places`` into the index."""
            if not len(places):
                return
            ranks = self._ranks(symbols[places] << 20 | symbols[right])
            order = np.argsort(ranks, kind="stable")
            ranks = ranks[order]
            first = np.flatnonzero(np.diff(ranks, prepend=-2))
            places = places[order]
            stops = [*first[1:].tolist(), len(ranks)]
            for r, i, j in zip(ranks[first].tolist(), first.tolist(), stops, strict=True):
                if r < 0:
                    continue
                if r in index:
                    index[r].append(places[i:j])
                else:
                    index[r] = [places[i:j]]
                    heappush(active, r)

        inside = np.flatnonzero(after >= 0)
        note(inside, after[inside])
        while active:
            r = heappop(active)
            left, right, new = self.merges[r]
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            # Places where a part was merged away meanwhile are left out.
            p = p[symbols[p] == left]
            q = after[p]
            here = (q >= 0) & (symbols[q] == right)
            p, q = p[here], q[here]
            if left == right and len(p) > 1:  # in a run, every other place from the left
                taken, free = [], -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    if x != free:
                        taken.append(i)
                        free = y
                p, q = p[taken], q[taken]
            if not len(p):
                continue
            symbols[p], symbols[q] = new, -1
            nxt, prev = after[q], before[p]
            after[p] = nxt
            more = nxt >= 0
            before[nxt[more]] = p[more]
            note(p[more], nxt[more])
            less = prev >= 0
            note(prev[less], p[less])
        kept = symbols >= 0
        counts = np.concatenate([[0], np.cumsum(kept)])
        return np.split(symbols[kept], counts[ends][:-1])

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary has no such merge."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def pieces(self, fragment: bytes) -> list:
        """Words (bytes) and added tokens (ids) of a stretch without white space."""
        try:
            text = fragment.decode()
        except UnicodeDecodeError:
            text = fragment.decode(errors="replace")
        if self.special and "<" in text and self.special.search(text):
            out = []
            for part in self.special.split(text):
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    out += self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[bytes]:
        if text.isascii():
            low = text.lower()
            return [low.encode()] if low.isalpha() else [
                x.encode() for x in ASCII_PIECES.findall(low)
            ]
        if (
            text.isalpha()
            and max(text) < "ɐ"
            and "İ" not in text
            and unicodedata.is_normalized("NFC", text)
        ):
            return [text.lower().encode()]
        # Everything unusual is normalised and cut by the library itself.
        return [
            bytes(self.byte_of[x] for x in piece)
            for piece, _ in self.cut.pre_tokenize_str(self.normalise(text))
            if piece
        ]

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word its ids (little-endian, 4 bytes each) and its decoded text."""
        found = self.merge_words(words)
        token = self.token
        return [
            (x.astype("<u4").tobytes(), b" ".join([token[i] for i in x.tolist()])) for x in found
        ]


class _Encoder:
    """Texts to ids, remembering words and the fragments made of them.

    One serves one task, so what it remembers does not outlive the task in a worker
    that goes on to other stages.
    """

    def __init__(self, bpe: PairIndexBpe):
        self.bpe = bpe
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}

    def _learn(self, fragments: list[bytes]) -> None:
        pieces = [self.bpe.pieces(f) for f in fragments]
        new = list({w for found in pieces for w in found if w not in self.words})
        plain = [w for w in new if not isinstance(w, int)]
        self.words.update(zip(plain, self.bpe.encode_words(plain), strict=True))
        for w in new:
            if isinstance(w, int):
                self.words[w] = (w.to_bytes(4, "little"), self.bpe.token[w])
        word = self.words
        for f, found in zip(fragments, pieces, strict=True):
            if len(found) == 1:
                self.ids[f], self.texts[f] = word[found[0]]
            else:
                self.ids[f] = b"".join([word[w][0] for w in found])
                self.texts[f] = b" ".join([word[w][1] for w in found])

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        ids, decoded, at = [], [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (size == 0 or size + len(texts[to]) <= SLICE_BYTES):
                size += len(texts[to]) + 1
                to += 1
            if len(self.ids) > KEEP_WORDS:
                self.words.clear()
                self.ids.clear()
                self.texts.clear()
            parts = [t.split() for t in texts[at:to]]
            self._learn(list(set().union(*parts).difference(self.ids)))
            id_of, text_of = self.ids.__getitem__, self.texts.__getitem__
            ids += [b"".join(map(id_of, p)) for p in parts]
            decoded += [b" ".join(filter(None, map(text_of, p))) for p in parts]
            at = to
        return ids, decoded


def encode(df: DataFrame, model_text: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.

    ``model_text`` is the content of a vocabulary file. Ids and decoded text are
    those of the library with its default settings and no special tokens added;
    the strings of added tokens in a text become their ids, as there.

    A null or empty text has no tokens and decodes to an empty text. Every row is
    encoded by itself, so repeated rows, ties and null ids change nothing; an
    empty table gives an empty table. Other columns stay as they are, but for
    columns that have the names of the new ones, which are replaced.

    No shuffle: texts stay where they are read.
    """
    new = ("n_tokens", "ids", "decoded")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )
    model = df.sparkSession.sparkContext.broadcast(model_text)
    place = df.columns.index(text)

    def run(batches):
        state = worker_state("bpe")
        key = hash(model.value)
        if key not in state:
            state.clear()
            state[key] = PairIndexBpe(model.value)
        encoder = _Encoder(state[key])
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            column = batch.column(place).cast(pa.string()).cast(pa.binary())
            ids, decoded = encoder.encode([t or b"" for t in column.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.binary()).cast(pa.string()),
                ],
                names=[*batch.schema.names, *new],
            )

    return df.mapInArrow(run, schema)

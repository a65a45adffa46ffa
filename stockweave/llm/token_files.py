"""Token ids in seekable files: zstandard frames, a document index, a seek table.

A file is a row of independent zstandard frames, each holding the ids (unsigned
32-bit, little-endian) of some documents in order; then a skippable frame with the
index of documents; then the seek table of the seekable zstandard format, another
skippable frame, which gives the size and the checksum of every frame before it.
A reader takes the tail, then only the frames that hold the documents it wants.
Plain zstandard tools can still decompress the whole file.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockweave.llm.bpe import byte_letters
from stockweave.llm.common import worker_state
from stockweave.session import fresh_folder, written

# Bytes of ids in a frame, after which the next document starts another one.
FRAME_BYTES = 256_000
SLICE_BYTES = 8_000_000
KEEP_WORDS = 800_000

# Marks that end words; any others go through the whole split.
MARKS = ",.;:!?%$&*#()\""

# Fixed values of the seekable format and of skippable frames.
INDEX_MAGIC = 0x184D2A51
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80

# White space but the space itself, in UTF-8 (fixed values).
CONTROLS = [bytes([b]) for b in (9, 10, 11, 12, 13, 28, 29, 30, 31)]
WIDE = [
    chr(c).encode()
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class TokenFileWriter:
    """Writes one file, document by document."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(
            level=level, write_checksum=True, write_content_size=True
        )
        self.buffer, self.size = [], 0
        self.table: list[bytes] = []
        self.docs: list[tuple[int | None, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size >= self.frame_bytes:
            self._flush()
        self.docs.append((doc_id, len(ids) // 4, len(self.table), self.size // 4))
        self.buffer.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        if not self.size:
            return
        raw = b"".join(self.buffer)
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        check = xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
        self.table.append(struct.pack("<III", len(frame), len(raw), check))
        self.buffer, self.size = [], 0

    def close(self) -> None:
        self._flush()
        columns = [
            np.array([d[0] is not None for d in self.docs], "u1"),
            np.array([d[0] or 0 for d in self.docs], "<i8"),
            *[np.array([d[k] for d in self.docs], "<i8") for k in (1, 2, 3)],
        ]
        index = self.zstd.compress(b"".join(c.tobytes() for c in columns))
        index = struct.pack("<Q", len(self.docs)) + index
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(self.table)
        table += struct.pack("<IBI", len(self.table), HAS_CHECKSUM, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class TokenFileReader:
    """Reads the tail of a file, then frames as they are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("not a seekable zstandard file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames, at = [], 0
        for packed, raw, check in struct.iter_unpack("<III", table):
            self.frames.append((at, packed, raw, check))
            at += packed
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("the file has no index of documents")
        index = self._at(at + 8, length)
        (n_docs,) = struct.unpack("<Q", index[:8])
        index = zstandard.ZstdDecompressor().decompress(index[8:])
        known = np.frombuffer(index, "u1", n_docs)
        ids, sizes, frames, offsets = np.frombuffer(index, "<i8", 4 * n_docs, n_docs).reshape(
            4, n_docs
        )
        self.docs = [
            (i if k else None, n, f, o)
            for k, i, n, f, o in zip(
                known, ids.tolist(), sizes.tolist(), frames.tolist(), offsets.tolist(),
                strict=True,
            )
        ]
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            start, packed, raw, check = self.frames[k]
            data = zstandard.ZstdDecompressor().decompress(self._at(start, packed))
            if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, data)
        return self._last[1]

    def ids(self, entry: tuple[int | None, int, int, int]) -> bytes:
        _, n, frame, offset = entry
        return self.frame(frame)[4 * offset : 4 * (offset + n)] if n else b""


class FragmentEncoder:
    """Ids of whole texts by the library, which sees each distinct fragment once.

    A space between two characters that are no white space always starts a new
    piece of the byte-level split, so the stretches between such spaces can be
    encoded by themselves and remembered.
    """

    def __init__(self, model_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model_text)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = byte_letters()
        self.packed = [struct.pack("<I", i) for i in range(self.library.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    @staticmethod
    def _open(part: bytes) -> tuple[bool, bool]:
        """Whether the part may be parted from what is before and behind it."""
        if not part:
            return False, False
        text = part.decode(errors="replace")
        return not text[0].isspace(), not text[-1].isspace()

    def fragments(self, text: bytes) -> list[bytes]:
        """Stretches of the text, each with the space before it."""
        parts = text.split(b" ")
        out = [parts[0]]
        before = self._open(parts[0])[1]
        for part in parts[1:]:
            start, end = self._open(part)
            if before and start:
                out.append(b" " + part)
            else:
                out[-1] += b" " + part
            before = end
        return [x for x in out if x]

    @staticmethod
    def _simple(text: bytes) -> bool:
        """Whether all spaces stand between characters that are no white space."""
        if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
            return False
        for c in CONTROLS:
            if c in text and (c + b" " in text or b" " + c in text):
                return False
        return text.isascii() or not any(w in text for w in WIDE)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (size == 0 or size + len(texts[to]) <= SLICE_BYTES):
                size += len(texts[to]) + 1
                to += 1
            if len(self.known) > KEEP_WORDS:
                self.known.clear()
                self.cores.clear()
            some = texts[at:to]
            simple = [t.split(b" ") if self._simple(t) else None for t in some]
            # After the first part, each stands for itself with the space before it.
            self._learn(list(set().union(*[p[1:] for p in simple if p]).difference(self.known)))
            odd = [
                self.fragments(t) if p is None else p[:1] for t, p in zip(some, simple, strict=True)
            ]
            rare = list(set().union(*odd))
            whole = dict(zip(rare, self._library(rare), strict=True))
            get = self.known.__getitem__
            for p, o in zip(simple, odd, strict=True):
                ids = b"".join([whole[f] for f in o])
                out.append(ids + b"".join(map(get, p[1:])) if p else ids)
            at = to
        return out

    def _library(self, fragments: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast(
            [f.decode(errors="replace") for f in fragments], add_special_tokens=False
        )
        return [b"".join([self.packed[i] for i in e.ids]) for e in found]

    def _core(self, word: str) -> bytes:
        """The ids of a space and a word that is one piece of the split."""
        if word not in self.cores:
            letters = word if word.isascii() else "".join(
                [self.letters[b] for b in word.encode()]
            )
            found = self.model.tokenize(self.letters[32] + letters)
            self.cores[word] = b"".join([self.packed[t.id] for t in found])
        return self.cores[word]

    def _learn(self, parts: list[bytes]) -> None:
        rest = []
        for part in parts:
            text = part.decode(errors="replace")
            word = text.rstrip(MARKS)
            # A Latin word is one piece, and the marks after it are another.
            if word.isalpha() and max(word) < "ɐ":
                marks = text[len(word) :]
                self.known[part] = self._core(word) + (self._marks(marks) if marks else b"")
            else:
                rest.append(part)
        for part, ids in zip(rest, self._library([b" " + p for p in rest]), strict=True):
            self.known[part] = ids

    def _marks(self, marks: str) -> bytes:
        if marks not in self.cores:
            self.cores[marks] = self._library([marks.encode()])[0]
        return self.cores[marks]


def write_token_files(
    df: DataFrame,
    folder: str,
    model_text: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = 2,
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` order, one file per range.

    Returns one row per file: ``shard`` (its place in the order), ``path``,
    ``n_docs``, ``n_tokens``. ``end_id`` is added to each document.

    A null or empty text has the end id only. Null doc_ids come first; repeated
    doc_ids keep all their rows, ordered by text. An empty table writes no file.
    Other columns are not read. A retried task writes the same file again under
    another name first, so a file is either whole or missing. ``folder`` must be
    reachable from all executors (file, hdfs, s3 and gs paths).
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(model_text)
    docs = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    _make_folder(folder)
    end = struct.pack("<I", end_id)

    def run(batches):
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard = TaskContext.get().partitionId()
                store, at = _filesystem(f"{folder}/part-{shard:06d}.zst")
                draft = f"{at}.{TaskContext.get().taskAttemptId()}.tmp"
                writer = TokenFileWriter(store.open_output_stream(draft), frame_bytes)
                state = worker_state("token_files")
                key = hash(model.value)
                if key not in state:
                    state.clear()
                    state[key] = FragmentEncoder(model.value)
                n_docs = n_tokens = 0
            texts = batch.column(1).cast(pa.string()).cast(pa.binary()).to_pylist()
            keys = batch.column(0).to_pylist()
            step = 500
            for k in range(0, len(texts), step):
                found = state[key].encode([t or b"" for t in texts[k : k + step]])
                for doc, ids in zip(keys[k : k + step], found, strict=True):
                    writer.add(doc, ids + end)
                    n_docs += 1
                    n_tokens += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            store.move(draft, at)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int64()),
                    "path": [f"{folder}/part-{shard:06d}.zst"],
                    "n_docs": pa.array([n_docs], pa.int64()),
                    "n_tokens": pa.array([n_tokens], pa.int64()),
                }
            )

    return written(
        docs.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "token-files"
    )


def _make_folder(folder: str) -> None:
    store, at = _filesystem(folder)
    store.create_dir(at, recursive=True)


def read_token_files(files: DataFrame, digests_only: bool = False) -> DataFrame:
    """Read files back: doc_id, start, n_tokens, ids_crc32 and the ids.

    ``start`` counts the ids of all documents before. Files are read by the tasks,
    frame by frame; nothing but one frame is held. With ``digests_only`` the ids
    are dropped after their checksum is taken.
    """
    # One row per file: the running sum is over file sizes, not documents. The number
    # of tasks is given, since rows as small as these would all be put into one.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    ).repartition(max(1, files.count()))

    def run(batches):
        for batch in batches:
            for path, start in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                store, at = _filesystem(path)
                with store.open_input_file(at) as file:
                    reader = TokenFileReader(file)
                    for k in range(0, len(reader.docs), 500):
                        entries = reader.docs[k : k + 500]
                        ids = [reader.ids(e) for e in entries]
                        sizes = [e[1] for e in entries]
                        starts = start + np.cumsum([0, *sizes])
                        start = int(starts[-1])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([e[0] for e in entries], pa.int64()),
                                "start": pa.array(starts[:-1], pa.int64()),
                                "n_tokens": pa.array(sizes, pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                                "ids": pa.array(
                                    [None] * len(ids) if digests_only else ids, pa.binary()
                                ),
                            }
                        )

    return files.mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def fresh_token_folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "tokens")

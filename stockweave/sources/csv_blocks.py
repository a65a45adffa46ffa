"""Quoted CSV files cut into records by many tasks.

A line break ends a record only outside quotes, and whether a line starts inside quotes
depends on all quotes before it. So the quotes of each file block are counted first; the
parity of the counts before a block tells every task how its block begins. Tasks then cut
their blocks into records on their own. A record that a block leaves open is put together
with the beginnings of the blocks behind it, by key, so at most two pieces per block move.

The blocks are those that Spark makes of the files, in `_metadata`. Quotes must be
balanced, as RFC 4180 has it: inside quotes they are doubled, and a cell that is not
quoted has none (or an even number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from stockweave.session import fresh_folder, written

WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, start long, role int, first boolean, text string"
_SCHEMA = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("role", pa.int32()),
     ("first", pa.bool_()), ("text", pa.string())]
)


def _lines(spark: SparkSession, path: str, block_bytes: int | None) -> DataFrame:
    """Lines of all ``.csv`` files with their file and the start of their block.

    Every line belongs to the block in which it begins, and a task has whole blocks,
    each in order.
    """
    if block_bytes:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    return (
        spark.read.option("lineSep", "\n")
        .option("pathGlobFilter", "*.csv")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            "value",
        )
    )


def _open_blocks(lines: DataFrame) -> dict[str, np.ndarray]:
    """By file, the starts of the blocks that begin inside quotes.

    Eight bytes per such block; the plan of the scan holds more than that per block.
    """
    blocks = lines.groupBy("file", "start").agg((F.sum(_quotes("value")) % 2).alias("odd"))
    file = Window.partitionBy("file")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.select(
        "file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"),
    ).where("open")
    found: dict[str, list[int]] = {}
    for r in known.collect():
        found.setdefault(r.file, []).append(r.start)
    return {f: np.sort(np.array(s, np.int64)) for f, s in found.items()}


def _quotes(text: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _unsplit(spark: SparkSession, largest: int, block_bytes: int | None) -> bool:
    """Whether files up to this size are one block each, however many there are."""
    conf = spark._jsparkSession.sessionState().conf()
    return largest <= min(
        block_bytes or conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()
    )


class _Block:
    """Cuts the lines of one block, which come in batches, into pieces."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start = file, start
        self.inside = inside
        self.role = HEAD if inside else WHOLE
        self.lines: list[str] = []  # of the record that is not finished
        self.rows: list[tuple[int, bool, str]] = []
        self.seen = start > 0  # whether the file's first record is known

    def _put(self, role: int, text: str) -> None:
        first = not self.seen and role != HEAD and text.strip("\r") != ""
        self.seen |= first
        self.rows.append((role, first, text))

    def add(self, texts: list[str], quotes: np.ndarray) -> None:
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        begins = ~np.concatenate([[self.inside], after[:-1]])
        at = np.flatnonzero(begins).tolist()
        first = at[0] if at else len(texts)
        self.lines += texts[:first]
        if at:
            if self.lines:
                self._put(self.role, "\n".join(self.lines))
            self.role = WHOLE
            for i, j in zip(at, at[1:], strict=False):
                self._put(WHOLE, texts[i] if j == i + 1 else "\n".join(texts[i:j]))
            self.lines = texts[at[-1]:]
        self.inside = bool(after[-1])

    def end(self) -> None:
        if self.lines:
            role = self.role if self.role == HEAD or not self.inside else TAIL
            self._put(role, "\n".join(self.lines))
            self.lines = []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.string()), pa.array([self.start] * n, pa.int64()),
             *[pa.array([r[i] for r in rows], _SCHEMA.field(2 + i).type) for i in range(3)]],
            schema=_SCHEMA,
        )


def _cut(batches: Iterator[pa.RecordBatch], inside: dict[str, np.ndarray],
         quoted: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of the blocks of a task, in order."""
    block: _Block | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("start").to_numpy()
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        new = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
        value = batch.column("value")
        quotes = (
            pc.count_substring(value, '"').to_numpy()
            if quoted else np.zeros(len(starts), np.int64)
        )
        for i, j in zip([0, *new], [*new, len(starts)], strict=True):
            file, start = files.dictionary[codes[i]].as_py(), int(starts[i])
            if block is None or (block.file, block.start) != (file, start):
                if block is not None:
                    block.end()
                    yield block.take()
                open_starts = inside.get(file, ())
                at = np.searchsorted(open_starts, start)
                block = _Block(
                    file, start, bool(at < len(open_starts) and open_starts[at] == start)
                )
            block.add(value.slice(i, j - i).to_pylist(), quotes[i:j])
            yield block.take()
    if block is not None:
        block.end()
        yield block.take()


def csv_records(
    spark: SparkSession,
    path: str,
    quoted: bool = True,
    block_bytes: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """``(file, first, text)``: the records of all ``.csv`` files below ``path``.

    ``first`` marks the first record of each file that is not empty; later empty ones
    are left out. ``quoted=False`` spares the count of quotes, for files known to have
    no line breaks inside quotes; so does ``largest``, the size of the largest file, if
    that is not cut. The pieces are written once, so files are not read again for what
    is made of the records.
    """
    lines = _lines(spark, path, block_bytes)
    look = quoted and not (largest is not None and _unsplit(spark, largest, block_bytes))
    inside = spark.sparkContext.broadcast(_open_blocks(lines) if look else {})
    cut = lines.mapInArrow(lambda batches: _cut(batches, inside.value, quoted), PIECES)
    # Written by the session that has the small blocks, read by the one that was given.
    folder, seen = fresh_folder(spark, "csv-pieces"), Observation()
    open_pieces = F.count_if(F.col("role") != WHOLE).alias("n")
    cut.observe(seen, open_pieces).write.parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    records = pieces.where(F.col("role") == WHOLE).select("file", "first", "text")
    if seen.get["n"]:
        records = records.unionByName(_joined(pieces))
    text = F.when(
        F.endswith("text", F.lit("\r")), F.left("text", F.length("text") - 1)
    ).otherwise(F.col("text"))
    return records.select("file", "first", text.alias("text")).where(F.col("text") != "")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records out of several blocks: a tail, and the heads behind it up to the next tail."""
    order = Window.partitionBy("file").orderBy("start", "role")
    whole = written(
        pieces.where(F.col("role") != WHOLE)
        .withColumn(
            "owner", F.last(F.when(F.col("role") == TAIL, F.col("start")), True).over(order)
        )
        .groupBy("file", "owner")
        .agg(
            F.max("first").alias("first"),
            F.array_sort(F.collect_list(F.struct("start", "role", "text"))).alias("parts"),
        )
        .select("file", "first", F.array_join(F.col("parts.text"), "\n").alias("text")),
        "csv-joined",
    )
    broken = whole.where(_quotes("text") % 2 == 1).agg(F.min("file")).first()[0]
    if broken:
        raise ValueError(
            f"{broken} has an odd number of quotes; read it with read_whole_csv, one task a file"
        )
    return whole

"""Catalogue CSV files in and out, missing cells, source descriptors."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.constants import MISSING_TOKENS
from stockweave.mapping import SchemaMapping, user_col
from stockweave.session import BROADCAST_ROWS
from stockweave.sources.csv_blocks import csv_records

# Quoted commas, doubled quotes and line breaks inside quotes are all legal.
CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
CSV_CELLS = {"multiLine": "true", "quote": '"', "escape": '"'}
CSV_WRITE = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_catalog_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    multiline: bool = True,
    block_bytes: int | None = None,
) -> DataFrame:
    """CSV files with headers, every column as text, matched by name.

    Files may have other columns or another order; a column that a file lacks is
    null there. A row with more cells than its header fails the read, one with
    fewer ends in nulls. With ``columns``, these are returned. Only ``.csv`` files
    are read; one named in capitals is an error.

    Large files are read by many tasks, line breaks inside quotes or not
    (`csv_blocks`); ``multiline=False`` says that there are none and spares a look.
    ``block_bytes`` sets the size of a block for this read. Tasks find the headers;
    the driver gets each different one. A file whose quotes are not balanced is an
    error; :func:`read_whole_csv` reads those.
    """
    largest = _only_csv(spark, path, columns is None)
    records = csv_records(spark, path, multiline, block_bytes, largest)
    heads = records.where("first")
    found = heads.groupBy("text").agg(F.count(F.lit(1)).alias("n")).orderBy("text").collect()
    texts = [r.text for r in found]
    headers = [_header(t) for t in texts]
    # Cells by place, one more than the longest header to find rows that are too long.
    width = max(map(len, headers), default=0) + 1
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    body = records.where(~F.col("first"))
    if len(headers) > 1:
        kind = F.array_position(F.array(*map(F.lit, texts)), F.col("text")).alias("kind")
        kinds = heads.select("file", kind)
        few = sum(r.n for r in found) <= BROADCAST_ROWS
        body = body.join(F.broadcast(kinds) if few else kinds, "file")
    else:
        body = body.withColumn("kind", F.lit(1))
    parsed = body.select("kind", F.from_csv("text", cells.toDDL(), CSV_CELLS).alias("c"))
    over = F.coalesce(
        *[F.when(F.col("kind") == k, F.col(f"c.c{len(h)}")) for k, h in enumerate(headers, 1)],
        F.lit(None).cast("string"),
    )
    spill = F.raise_error(F.concat(F.lit("more cells than columns, from: "), over))
    parsed = parsed.where(F.when(over.isNotNull(), spill).otherwise(F.lit(True)))
    names = list(columns) if columns is not None else list(
        dict.fromkeys(c for h in headers for c in h))
    return parsed.select(*[_cell(headers, name).alias(name) for name in names])


def _cell(headers: Sequence[tuple[str, ...]], name: str) -> Column:
    """The cell of a named column, wherever the header of the row's file has it."""
    found = F.lit(None).cast("string")
    for k, header in enumerate(headers, 1):
        if name in header:
            at = F.col(f"c.c{header.index(name)}")
            found = F.when(F.col("kind") == k, at).otherwise(found) if len(headers) > 1 else at
    return found


def _header(text: str) -> tuple[str, ...]:
    names = next(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")))
    names = tuple(n or f"_c{i}" for i, n in enumerate(names))
    if len(set(names)) < len(names):
        raise ValueError(f"a header names a column twice: {text[:200]}")
    return names


def _only_csv(spark: SparkSession, path: str, needed: bool) -> int:
    """The size of the largest file. A file that means to be a catalogue but is not named
    so is an error, and if ``needed`` so is a folder without one."""
    # No content is read.
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    named = F.endswith("path", F.lit(".csv"))
    seen = listed.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(named).alias("n_csv"),
        F.max(F.when(named, F.col("length"))).alias("largest"),
        F.min(F.when(~named & F.endswith(F.lower("path"), F.lit(".csv")), F.col("path"))).alias("odd"),
        F.min(F.when(~named, F.col("path"))).alias("other"),
    ).first()
    if seen.odd or (seen.n and not seen.n_csv):
        raise ValueError(
            f"only CSV files named *.csv can be read, found {seen.odd or seen.other}"
        )
    if not seen.n and needed:
        raise ValueError(f"no CSV file in {path}")
    return seen.largest or 0


def read_whole_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Like :func:`read_catalog_csv` for files with quotes inside plain cells.

    Spark's reader decides where a record ends, so a file is one task, and all files
    have the header ``columns``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.options(**CSV_READ)
        .option("pathGlobFilter", "*.csv")
        .option("enforceSchema", "false")
        .schema(schema)
        .csv(path)
    )


def normalize_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Turn every missing-cell text of the text columns into null."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~user_col(c).isin(*tokens), user_col(c)).alias(c) if c in texts else user_col(c)
            for c in df.columns
        ]
    )


def export_catalog_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes; a null cell is written as an empty field."""
    df.select(*[user_col(c).cast("string").alias(c) for c in df.columns]).write.options(
        **CSV_WRITE
    ).mode("errorifexists").csv(path)


def describe_source(df: DataFrame, mapping: SchemaMapping | None = None) -> DataFrame:
    """One row per column: name, type, role, required; plus the record count.

    Every column starts as role ``data``, not required; a mapping fills in the
    roles it gives. One count over the source, no columns read.
    """
    roles = {c.user_column: c.role for c in mapping.custom_columns} if mapping else {}
    needed = set(mapping.required_columns) if mapping else set()
    needed |= {c.user_column for c in mapping.custom_columns if c.required} if mapping else set()
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(roles.get(f.name, "data")).alias("role"),
                F.lit(f.name in needed).alias("required"),
            )
            for i, f in enumerate(df.schema, 1)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(F.inline(rows), "total_records")

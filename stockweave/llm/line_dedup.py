"""Line dedup: lines that many documents share are dropped (built-in functions only).

Lines are exploded to the hashes of their keys, distinct documents are counted
per hash, and the places of the lines to drop go back to their documents, where
the kept stretches are put together by position. No text is shuffled but in the
last join, which brings each text to its own places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import BLANKS, ascii_lower
from stockweave.session import BROADCAST_ROWS, written_and_counted


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def dedup_lines(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drop the lines whose key is found in ``min_docs`` documents or more.

    Returns all columns of ``df`` with the new text, then ``n_lines`` (before)
    and ``n_dropped``. Only keys of at least ``min_chars`` code points count,
    and the largest ``doc_id`` that holds a key keeps all its lines.

    A null or empty text is one empty line (a null text becomes an empty one).
    Repeated rows of one ``doc_id`` count as one document and each keeps its own
    lines. Rows with a null ``doc_id`` are left as they are and not counted. An
    empty table gives an empty table. ``df`` may hold any other columns; those
    named ``n_lines`` or ``n_dropped`` are replaced.

    A hot line is counted per task before it moves. The keys to drop are written:
    few of them are sent to the lines, which stay; for many, the places of a hot line
    are split by Spark's handling of skewed joins. The texts are joined by document.
    """
    rest = [c for c in df.columns if c not in (text, doc_id, "n_lines", "n_dropped")]
    docs = df.select(
        F.col(f"`{doc_id}`").alias("_doc"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")
        if rest
        else F.lit(None).cast("int").alias("_rest"),
    ).withColumn("_hash", F.xxhash64("_text"))
    lines = (
        docs.where(F.col("_doc").isNotNull())
        .select("_doc", "_hash", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select("_doc", "_hash", "_pos", F.unhex(F.md5("_key")).alias("_key"))
    )
    shared = (
        lines.select("_key", "_doc")
        .distinct()
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_keeper"))
        .where(F.col("_n") >= min_docs)
        .select("_key", "_keeper")
    )
    shared, n = written_and_counted(shared, "shared-lines")
    drops = (
        lines.join(F.broadcast(shared) if n <= BROADCAST_ROWS else shared, "_key")
        .where(F.col("_doc") != F.col("_keeper"))
        .groupBy("_doc", "_hash")
        .agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))
    )
    split = F.split("_text", "\n")
    whole = docs.join(drops, ["_doc", "_hash"], "left").withColumn("_lines", split)
    n, drop = F.size("_lines"), F.col("_drop")
    # The stretch before the j-th dropped line, and the one after the last.
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(drop, j - 1) + 1)
    end = lambda j: F.coalesce(F.get(drop, j), n)
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(drop)),
            lambda j: F.slice(F.col("_lines"), start(j) + 1, end(j) - start(j)),
        )
    )
    new_text = F.when(drop.isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return whole.select(
        F.col("_doc").alias(doc_id),
        new_text.alias(text),
        *[F.col("_rest").getField(c).alias(c) for c in rest],
        n.cast("long").alias("n_lines"),
        F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )

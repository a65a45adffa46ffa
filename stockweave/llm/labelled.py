"""Bounded samples of labelled rows, for the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 1


def sample_ids(ids: DataFrame, n: int) -> DataFrame:
    """At most ``n`` ids, the same ones whatever the partitions."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def labelled_sample(
    df: DataFrame,
    labels: DataFrame,
    label: str,
    n: dict[int, int],
    n_any: int = 0,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Texts of at most ``n[v]`` training rows of each label value, as (kind, text).

    ``kind`` is the label value; with ``n_any``, further rows of kind -1 are drawn
    from all training rows, labelled or not. Held-out rows are never drawn. Ids
    are drawn first, from narrow columns, and sent to the scan of the texts: their
    number is bounded by the parameters, so no text is shuffled.
    """
    known = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(label).cast("int").alias("v"))
        .where(F.col("doc_id").isNotNull() & F.col("v").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("v").alias("v"))
    )
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    parts = [
        sample_ids(known.where(F.col("v") == v).select("doc_id"), k).withColumn("kind", F.lit(v))
        for v, k in n.items()
    ]
    if n_any:
        parts.append(sample_ids(docs.select("doc_id"), n_any).withColumn("kind", F.lit(-1)))
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    # Repeated rows of an id could outgrow the bound, so one text of each stays.
    return (
        docs.join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "kind")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select("kind", "text")
    )

"""Global and per-key positions without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.session import BROADCAST_ROWS, written, written_and_counted


def positions(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row inside its ``by`` key, in a total order.

    Rows are range-partitioned by key *and* order, so a key that holds most of
    the rows spreads over many tasks. Each row's place inside its partition is
    written out once; the offsets of the earlier partitions come from a table
    with one row per (key, partition). ``total`` adds the row count of the key.
    """
    keys = [F.col(k) for k in by]
    placed = written(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "positions",
    ).withColumn("_part", F.shiftright("_place", 33))
    marks = [F.col(k).alias(f"_key{i}") for i, k in enumerate(by)]
    names = [f"_key{i}" for i in range(len(marks))]
    parts, n_parts = written_and_counted(
        placed.groupBy(*marks, F.col("_part").alias("_key")).agg(
            F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
        ),
        "offsets",
    )
    key = Window.partitionBy(*names)
    earlier = key.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *names, "_key", "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(key).alias("_total"),
    )
    if n_parts <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names, strict=True)]
    return placed.join(offsets, [*same, F.col("_part") == F.col("_key")]).select(
        *df.columns,
        (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(name),
        *([F.col("_total").alias(total)] if total else []),
    )


def first_by_hash(
    df: DataFrame, hash_hex: Column, keys: Sequence[Column], n: int, name: str = "position"
) -> DataFrame:
    """The first ``n`` rows in the order (hash, keys), with their position.

    The hash spreads evenly, so its leading digits cut the rows into 65536 equal
    slices. Slice counts tell which slices can hold one of the first ``n``;
    only those are sorted, each on its own.
    """
    hashed = df.withColumn("_hash", hash_hex).withColumn(
        "_slice", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    )
    counts = hashed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65536 rows, whatever the size of the data.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where(F.col("_before") < n)
        .drop("_n")
    )
    inside = Window.partitionBy("_slice").orderBy("_hash", *keys)
    return (
        hashed.join(F.broadcast(needed), "_slice")
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .where(F.col(name) <= n)
        .drop("_slice", "_hash", "_before")
    )

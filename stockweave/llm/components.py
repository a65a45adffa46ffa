"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.session import written, written_and_counted


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that its links (``a``, ``b``) reach.

    Large and small stars in turn: every node is hung on the smallest node it
    knows, until all hang on their root. The number of rounds grows with the
    logarithm of the longest chain. Each round pre-aggregates before it shuffles
    and is written to the shared folder. Nodes without a link are not returned.
    """
    links = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    stars, n = written_and_counted(links.distinct(), "links")
    settled = n == 0
    while not settled:
        # Large star: the larger neighbours of a node go to the least one it knows.
        around = stars.select("a", "b").union(stars.select(F.col("b"), F.col("a")))
        # Written, so that the join can split the links of a node that very many have.
        least = written(
            around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least"
        )
        large = (
            around.join(least, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large, _ = written_and_counted(large, "large-star")
        # Small star: the smaller neighbours of a node go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        other = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(least, "a").select(other.alias("a"), F.col("m").alias("b")).distinct()
        stars, _ = written_and_counted(small, "small-star")
        # Settled when every node hangs on one root and no root hangs on another.
        twice = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        hung = stars.select("b").join(stars.select(F.col("a").alias("b")), "b", "left_semi")
        settled = twice.isEmpty() and hung.isEmpty()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

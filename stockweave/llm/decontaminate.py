"""Benchmark decontamination by spaced seeds (built-in functions only).

A mask looks at some of the tokens below it and skips the others, so a hash of
what it sees survives a substitution in a skipped place. The hashes of all masks
at all places of the benchmark items are joined with those of the documents; a
hit names an item and a diagonal (place in the document less place in the item),
and only there are the tokens compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.session import BROADCAST_ROWS, written, written_and_counted

# A document holds an item if WINDOW consecutive tokens of the item (all of them
# if it is shorter) stand in it at the same distances with at most MISMATCHES
# substituted. Items shorter than WINDOW may have one token substituted, those of
# fewer than MIN_TOKENS tokens none.
WINDOW = 13
MISMATCHES = 2
MIN_TOKENS = 10

# Offsets that each mask looks at. Together they hit every window of WINDOW
# tokens with MISMATCHES substitutions, and every one of MIN_TOKENS with one
# (tested exhaustively).
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 8, 9))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; null gives no token."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _seeds(masks) -> list:
    """Functions from token hashes to the hashes of a mask at all places.

    The mask's number is hashed along; ``masks`` may be a dictionary by number.
    """
    numbered = masks.items() if isinstance(masks, dict) else enumerate(masks)
    return [
        lambda h, m=m, k=k: F.when(
            F.size(h) > m[-1],
            F.transform(
                F.slice(h, F.lit(1), F.greatest(F.size(h) - m[-1], F.lit(0))),
                lambda first, i: F.xxhash64(
                    F.lit(k), first, *[F.get(h, i + o) for o in m[1:]]
                ),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        for k, m in numbered
    ]


def _seed_rows(df: DataFrame, words: Column, keys: list[str], masks) -> DataFrame:
    """One row per mask and place: ``keys``, ``_seed``, ``_at``."""
    hashed = df.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    per_mask = hashed.select(
        *keys, F.explode(F.array(*[m(F.col("_h")) for m in _seeds(masks)])).alias("_seeds")
    )
    return per_mask.select(*keys, F.posexplode("_seeds").alias("_at", "_seed"))


def _allowed(n: Column, window: int, mismatches: int, min_tokens: int) -> Column:
    one = F.when(n >= min_tokens, F.least(F.lit(1), F.lit(mismatches))).otherwise(0)
    return F.when(n >= window, mismatches).otherwise(one)


def _once(value: Column) -> Column:
    """A column that is computed once a row, also if lambdas above refer to it."""
    return F.explode(F.array(value))


def find_overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    masks=MASKS,
    window: int = WINDOW,
    mismatches: int = MISMATCHES,
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Documents and the benchmark items that they hold: doc_id, item_id, n_matched.

    ``n_matched`` is the largest number of the item's tokens found on one
    diagonal. One row per document and item, however often it is held.

    An item of fewer than ``min_tokens`` tokens is sought as a whole, by one seed over
    all of them, and no token may differ; an item without tokens is held by nothing.

    Null texts hold nothing; rows with a null id of either table are left out.
    Repeated rows count once; rows that share a ``doc_id`` with other texts give
    what any of them holds. An empty table on either side gives no rows. Other
    columns are not read.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    docs = docs.where(F.col("_doc").isNotNull()).withColumn("_hash", F.xxhash64("_text"))
    items = (
        benchmark.where(F.col(f"`{item_id}`").isNotNull())
        .select(
            F.col(f"`{item_id}`").alias("_item"),
            tokens(F.col(f"`{item_text}`")).alias("_words"),
        )
        .where(F.size("_words") > 0)
        .distinct()
    )
    items = written(items, "items")
    short = items.where(F.size("_words") < min_tokens)
    # At most ``min_tokens`` lengths; each one in use is a mask of its own.
    lengths = [r.n for r in short.select(F.size("_words").alias("n")).distinct().collect()]
    whole = {n: tuple(range(n)) for n in sorted(lengths)}
    seeds = _seed_rows(items.where(F.size("_words") >= min_tokens), F.col("_words"), ["_item"], masks)
    for n, mask in whole.items():
        own = short.where(F.size("_words") == n)
        seeds = seeds.union(_seed_rows(own, F.col("_words"), ["_item"], {-n: mask}))
    wanted, n = written_and_counted(seeds.distinct(), "seeds")
    wanted = wanted.withColumnRenamed("_at", "_place")
    every = dict(enumerate(masks)) | {-n: mask for n, mask in whole.items()}
    sought = _seed_rows(docs, tokens(F.col("_text")), ["_doc", "_hash"], every)
    hits = (
        sought.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "_seed")
        .select("_doc", "_hash", "_item", (F.col("_at") - F.col("_place")).alias("_diagonal"))
        .distinct()
    )
    hits, n_hits = written_and_counted(hits, "hits")
    # Few documents hold anything: theirs are read again and not shuffled, unless
    # the hits are too many to send to all tasks. A document is cut into tokens once.
    few = n_hits <= BROADCAST_ROWS
    with_hits = hits.select("_doc", "_hash").distinct()
    own = docs.join(
        F.broadcast(with_hits) if few else with_hits, ["_doc", "_hash"], "left_semi"
    ).select("_doc", "_hash", _once(tokens(F.col("_text"))).alias("_own"))
    at = own.join(F.broadcast(hits) if few else hits, ["_doc", "_hash"]).join(items, "_item")
    size = F.size("_words")
    same = F.transform(
        F.col("_words"),
        lambda w, j: F.coalesce(F.get(F.col("_own"), F.col("_diagonal") + j) == w, F.lit(False)),
    )
    same = F.transform(same, lambda x: x.cast("int"))
    at = at.select("_doc", "_item", "_words", _once(same).alias("_same"))
    width = F.least(size, F.lit(window))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    found = F.exists(
        F.sequence(F.lit(0), size - width),
        lambda s: total(F.slice(F.col("_same"), s + 1, width))
        >= width - _allowed(size, window, mismatches, min_tokens),
    )
    return (
        at.where(found)
        .groupBy("_doc", "_item")
        .agg(F.max(total(F.col("_same"))).alias("n_matched"))
        .select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "n_matched")
    )


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per document that holds an item: doc_id, n_items, item_ids, n_matched."""
    found = find_overlaps(df, benchmark, doc_id=doc_id, **how)
    item = how.get("item_id", "item_id")
    return found.groupBy(doc_id).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_set(item)).alias("item_ids"),
        F.max("n_matched").alias("n_matched"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``df`` without the documents that hold an item; all columns stay."""
    found = find_overlaps(df, benchmark, doc_id=doc_id, **how)
    bad = found.select(F.col(doc_id).alias("_bad_doc")).distinct()
    return df.join(bad, F.col(f"`{doc_id}`") == F.col("_bad_doc"), "left_anti")

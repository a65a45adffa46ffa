"""Token blocks, token statistics, splits and the training budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import (
    BATCH_SIZE,
    MAX_TOKENS,
    TRAINING_STEPS,
    VALIDATION_SPLIT,
)
from stockweave.functions.hashing import key_text, md5_number
from stockweave.functions.ranking import first_by_hash
from stockweave.functions.text import words

PAD_ID = 0
VOCABULARY = 50257

Tokenizer = Callable[[list[str]], list[list[int]]]


def word_ids(tokens: Column, vocabulary: int = VOCABULARY) -> Column:
    """Stand-in token ids: md5 of the word over the vocabulary, 0 kept for padding."""
    return F.transform(
        tokens, lambda w: (md5_number(w) % F.lit(vocabulary - 1) + 1).cast("int")
    )


def token_ids(df: DataFrame, column: str, tokenizer: Tokenizer | None = None) -> Column:
    """All token ids of the text: built-in words, or a tokeniser in Arrow batches."""
    if tokenizer is None:
        return word_ids(words(F.coalesce(F.col(column), F.lit(""))))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(tokenizer(texts.fillna("").tolist()), index=texts.index)

    return encode.asNondeterministic()(F.col(column))


def fit_tokens(
    df: DataFrame,
    column: str,
    max_tokens: int = MAX_TOKENS,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Adds ``n_tokens`` (before the cut), ``input_ids`` and ``attention_mask``.

    Both arrays have exactly ``max_tokens`` entries: longer texts are cut,
    shorter ones padded on the right.
    """
    if tokenizer is None:
        # Words beyond the cut are counted but need no id.
        split = words(F.coalesce(F.col(column), F.lit("")))
        staged = df.withColumn("_words", split).select(
            *df.columns,
            F.size("_words").alias("n_tokens"),
            word_ids(F.slice("_words", 1, max_tokens)).alias("_ids"),
        )
    else:
        staged = df.withColumn("_all", token_ids(df, column, tokenizer)).select(
            *df.columns,
            F.size("_all").alias("n_tokens"),
            F.slice("_all", 1, max_tokens).alias("_ids"),
        )
    used = F.least(F.col("n_tokens"), F.lit(max_tokens))
    padding = F.lit(max_tokens) - used
    return staged.select(
        *df.columns,
        "n_tokens",
        F.concat("_ids", F.array_repeat(F.lit(PAD_ID), padding)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), padding)
        ).alias("attention_mask"),
    )


def token_stats(
    df: DataFrame, column: str, max_tokens: int = MAX_TOKENS, by: Sequence[str] = ()
) -> DataFrame:
    """What the cut and the padding cost: one aggregate over word counts."""
    counted = df.select(
        *by, F.size(words(F.coalesce(F.col(column), F.lit("")))).alias("_n")
    )
    kept = F.least(F.col("_n"), F.lit(max_tokens))
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("_n") > max_tokens).alias("n_over"),
        F.round(F.avg((F.col("_n") > max_tokens).cast("double")), 6).alias("share_over"),
        F.min("_n").alias("min_tokens"),
        F.round(F.avg("_n"), 6).alias("avg_tokens"),
        F.max("_n").alias("max_tokens"),
        F.sum(F.col("_n") - kept).alias("tokens_cut"),
        F.sum(F.lit(max_tokens) - kept).alias("padding"),
    )


def hash_split(
    df: DataFrame,
    keys: Sequence[str],
    share: float = VALIDATION_SPLIT,
    seed: int | str = 0,
    out: str = "split",
) -> DataFrame:
    """``valid`` for about ``share`` of the keys, ``train`` for the rest.

    The same key always falls on the same side; no shuffle.
    """
    ticket = md5_number(key_text(*keys, seed=seed)) % F.lit(10000)
    side = F.when(ticket < int(round(share * 10000)), F.lit("valid")).otherwise("train")
    return df.withColumn(out, side)


def training_budget(
    df: DataFrame,
    keys: Sequence[str],
    batch_size: int = BATCH_SIZE,
    max_steps: int = TRAINING_STEPS,
    seed: int | str = 0,
) -> DataFrame:
    """The samples a run of ``max_steps`` batches sees, with batch numbers.

    ``keys`` must identify a row. The order is that of the hashed key.
    """
    picked = first_by_hash(
        df,
        F.md5(key_text(*keys, seed=seed)),
        [F.col(k) for k in keys],
        max_steps * batch_size,
    )
    return picked.withColumn(
        "batch_id", F.floor((F.col("position") - 1) / batch_size).cast("int")
    )

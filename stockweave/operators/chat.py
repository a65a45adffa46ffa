"""Routing of chat utterances: canned replies or a product search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import (
    CHAT_ITEMS,
    CHAT_PATTERNS,
    CHAT_REPLIES,
    MIN_SCORE,
    NO_RESULTS_TEXT,
    RESULTS_HEADER,
)
from stockweave.functions.hashing import key_text, md5_number
from stockweave.functions.text import is_blank, strip
from stockweave.mapping import SchemaMapping
from stockweave.operators.search import search
from stockweave.operators.textprep import result_card_column
from stockweave.session import written

Rules = Sequence[tuple[str, str]]


def utterance_class(
    text: Column, rules: Rules = CHAT_PATTERNS, word_boundary: bool = False
) -> Column:
    """First matching rule, else ``search``. Patterns match anywhere in the text
    (so ``hi`` is found in ``machine``) unless ``word_boundary`` is set."""
    kind = F.lit("search")
    for name, pattern in reversed(rules):
        full = rf"(?i)\b({pattern})\b" if word_boundary else f"(?i)({pattern})"
        kind = F.when(text.rlike(full), F.lit(name)).otherwise(kind)
    return kind


def classify_utterance(
    df: DataFrame,
    column: str = "text",
    rules: Rules = CHAT_PATTERNS,
    word_boundary: bool = False,
) -> DataFrame:
    """Trim, drop blank utterances, and add ``utterance_class``."""
    kept = df.where(~is_blank(F.col(column))).withColumn(column, strip(F.col(column)))
    return kept.withColumn(
        "utterance_class", utterance_class(F.col(column), rules, word_boundary)
    )


def pick_reply(kind: Column, keys: Sequence[str], seed: int | str = 0) -> Column:
    """One of the canned texts of a class, fixed by the key of the row."""
    ticket = md5_number(key_text(*keys, seed=seed))
    reply = F.lit(None).cast("string")
    for name, texts in CHAT_REPLIES.items():
        choice = F.element_at(
            F.array(*[F.lit(t) for t in texts]),
            (ticket % F.lit(len(texts)) + 1).cast("int"),
        )
        reply = F.when(kind == name, choice).otherwise(reply)
    return reply


def canned_response(
    df: DataFrame, keys: Sequence[str], seed: int | str = 0, out: str = "reply"
) -> DataFrame:
    return df.withColumn(out, pick_reply(F.col("utterance_class"), keys, seed))


def intent_counts(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Utterances per class, optionally per conversation."""
    return classified.groupBy(*by, "utterance_class").agg(F.count(F.lit(1)).alias("n"))


def intent_shares(classified: DataFrame) -> DataFrame:
    """Count and share of each class over all utterances.

    The total comes from the class counts, of which there are only a handful.
    """
    counts = intent_counts(classified)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def render_results(asked: DataFrame, results: DataFrame) -> DataFrame:
    """Markdown answer per request: its cards in rank order, or the no-hit text.

    A request has at most ``k`` results, so the collected list is small.
    """
    cards = (
        results.select("query_id", F.struct("rank", result_card_column().alias("card")).alias("_c"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list("_c")).alias("_cards"))
    )
    body = F.concat(
        F.lit(f"{RESULTS_HEADER}\n\n"), F.array_join(F.col("_cards.card"), "\n\n"), F.lit("\n\n")
    )
    query_line = F.concat(F.lit('---\n*Search Query: "'), F.col("query"), F.lit('"*'))
    return asked.join(cards, "query_id", "left").select(
        "query_id",
        F.coalesce(F.size("_cards"), F.lit(0)).alias("n_results"),
        F.concat(
            F.coalesce(body, F.lit(f"{NO_RESULTS_TEXT}\n\n")), query_line
        ).alias("answer"),
    )


def chat_to_search(
    utterances: DataFrame,
    keys: Sequence[str],
    catalog: DataFrame,
    vectors: DataFrame,
    mapping: SchemaMapping,
    embed: Callable[[DataFrame, str], DataFrame],
    k: int = CHAT_ITEMS,
    floor: float | None = MIN_SCORE,
    seed: int | str = 0,
    **sizes: int,
) -> DataFrame:
    """Answer every ``search`` utterance with rendered product cards.

    ``embed(df, column)`` adds the request vector. A request whose vector could
    not be made gets one of the fixed ``unknown`` replies.
    """
    asked = (
        classify_utterance(utterances)
        .where(F.col("utterance_class") == "search")
        .select(key_text(*keys).alias("query_id"), F.col("text").alias("query"))
    )
    # Written once: the vectors are needed twice and the encoder is the costly part.
    requests = written(embed(asked, "query").select("query_id", "embedding"), "requests")
    results = search(catalog, vectors, requests, mapping, k, floor, **sizes)
    answers = render_results(asked, results)
    failed = requests.where(F.col("embedding").isNull()).select(
        "query_id", F.lit(True).alias("_failed")
    )
    return answers.join(failed, "query_id", "left").select(
        "query_id",
        "n_results",
        F.when(
            F.col("_failed"), pick_reply(F.lit("unknown"), ["query_id"], seed)
        ).otherwise(F.col("answer")).alias("answer"),
    )

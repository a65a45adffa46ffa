"""Texts for the encoder and training rows for the generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import (
    CONTEXT_HEADER,
    CONTEXT_RESULTS,
    EMPTY_RESPONSE_TEXT,
    FIELD_TEMPLATE,
    PROMPT_OPEN,
    PROMPT_WITH_RESPONSE,
    QUESTION_TEMPLATES,
    RESPONSE_MARK,
    TRAINING_FIELDS,
)
from stockweave.functions.text import (
    field_label,
    join_filled,
    or_text,
    render,
    strip,
)
from stockweave.mapping import (
    SchemaMapping,
    present_customs,
    require_columns,
    text_col,
)
from stockweave.operators.project import standard_columns


def embedding_text_column(df: DataFrame, mapping: SchemaMapping) -> Column:
    """Name, description, category and training columns, joined by one blank."""
    users = [mapping.user_column(f) for f in TRAINING_FIELDS]
    users += [c.user_column for c in mapping.customs(["training"])]
    parts = [or_text(text_col(u), "") for u in users if u and u in df.columns]
    if not parts:
        raise ValueError("No valid columns found for text processing")
    return join_filled(" ", parts)


def embedding_text(
    df: DataFrame,
    mapping: SchemaMapping,
    key: str | None = None,
    keep: Sequence[Column] = (),
) -> DataFrame:
    """``id, text`` per row; ``key`` names another id column, ``keep`` adds columns."""
    require_columns(df, mapping, ["id"])
    return df.select(
        text_col(key or mapping.id_column).alias("id"),
        embedding_text_column(df, mapping).alias("text"),
        *keep,
    )


def _sample_values(
    df: DataFrame, mapping: SchemaMapping, null_text: str
) -> dict[str, Column]:
    require_columns(df, mapping, TRAINING_FIELDS)
    cols = standard_columns(df, mapping)
    if mapping.id_column not in df.columns:
        cols.pop("id", None)
    return {k: or_text(c, null_text) for k, c in cols.items()}


def _custom_keys(df: DataFrame, mapping: SchemaMapping) -> list[str]:
    """Standard names of the custom columns in order, each once."""
    named = [c.standard_column for c in present_customs(df, mapping)]
    return [k for k in dict.fromkeys(named) if k not in TRAINING_FIELDS]


def product_context_column(
    df: DataFrame, mapping: SchemaMapping, null_text: str = ""
) -> Column:
    values = _sample_values(df, mapping, null_text)

    def line(label: str, key: str) -> Column:
        return F.concat(F.lit(f"{label}: "), values[key])

    def filled(label: str, key: str) -> Column:
        return F.when(values[key] != "", line(label, key))

    return F.concat_ws(
        "\n",
        line("Product", "name"),
        filled("Description", "description"),
        line("Category", "category"),
        *[filled(field_label(k), k) for k in _custom_keys(df, mapping)],
    )


def training_pairs_column(
    df: DataFrame, mapping: SchemaMapping, null_text: str = ""
) -> Column:
    """Array of ``(pair_no, query, response)``: fixed questions, then one per
    filled custom field."""
    values = _sample_values(df, mapping, null_text)
    pairs = [
        F.struct(
            F.lit(i).alias("pair_no"),
            render(query, values).alias("query"),
            render(response, values).alias("response"),
        )
        for i, (query, response) in enumerate(QUESTION_TEMPLATES, 1)
    ]
    query, response = FIELD_TEMPLATE
    for i, key in enumerate(_custom_keys(df, mapping), len(pairs) + 1):
        fields = {"key": F.lit(key), "name": values["name"], "value": values[key]}
        pairs.append(
            F.when(
                values[key] != "",
                F.struct(
                    F.lit(i).alias("pair_no"),
                    render(query, fields).alias("query"),
                    render(response, fields).alias("response"),
                ),
            )
        )
    return F.array_compact(F.array(*pairs))


def _id_column(df: DataFrame, mapping: SchemaMapping) -> list[Column]:
    present = mapping.id_column in df.columns
    return [text_col(mapping.id_column).alias("id")] if present else []


def product_context(
    df: DataFrame, mapping: SchemaMapping, null_text: str = ""
) -> DataFrame:
    return df.select(
        *_id_column(df, mapping),
        product_context_column(df, mapping, null_text).alias("context"),
    )


def training_pairs(
    df: DataFrame, mapping: SchemaMapping, null_text: str = ""
) -> DataFrame:
    """One narrow generator per row; no shuffle.

    The array is never empty, and the outer form spares the optimiser's extra
    test for that, which would build the array twice.
    """
    return df.select(
        *_id_column(df, mapping),
        F.inline_outer(training_pairs_column(df, mapping, null_text)),
    )


def training_samples(
    df: DataFrame, mapping: SchemaMapping, null_text: str = ""
) -> DataFrame:
    """Rows (id, pair_no, query, context, response) from every product row.

    The context is built once per product, before the rows multiply.
    """
    ids = [c for c in ("id",) if mapping.id_column in df.columns]
    built = df.select(
        *_id_column(df, mapping),
        product_context_column(df, mapping, null_text).alias("context"),
        training_pairs_column(df, mapping, null_text).alias("_pairs"),
    )
    return built.select(*ids, "context", F.inline_outer("_pairs")).select(
        *ids, "pair_no", "query", "context", "response"
    )


def require_rows(df: DataFrame, message: str = "No valid training data found") -> None:
    """Fail early on an empty input; looks for one row only."""
    if df.isEmpty():
        raise ValueError(message)


def format_prompt(
    df: DataFrame, with_response: bool = True, out: str = "prompt"
) -> DataFrame:
    template = PROMPT_WITH_RESPONSE if with_response else PROMPT_OPEN
    fields = {n: or_text(F.col(n), "") for n in ("query", "context")}
    if with_response:
        fields["response"] = or_text(F.col("response"), "")
    return df.withColumn(out, render(template, fields))


def result_line(key: str, value: Column, indent: str = "   ") -> Column:
    return F.concat(F.lit(f"{indent}{key}: "), or_text(value, ""))


def result_context(
    results: DataFrame, n: int = CONTEXT_RESULTS, query: str = "query_id"
) -> DataFrame:
    """The block of the best ``n`` results of each query, for its prompt.

    Only ranks up to ``n`` are collected, so a group never holds more rows.
    """
    extra = F.transform(
        F.map_entries("metadata"),
        lambda e: F.concat(F.lit("   "), e["key"], F.lit(": "), e["value"]),
    )
    lines = F.concat(
        F.array(
            F.concat(F.col("rank").cast("string"), F.lit(". "), or_text(F.col("name"), "")),
            result_line("Description", F.col("description")),
            result_line("Category", F.col("category")),
        ),
        F.coalesce(extra, F.array()),
        F.array(F.lit("")),
    )
    block = F.struct("rank", F.array_join(lines, "\n").alias("text"))
    return (
        results.where(F.col("rank") <= n)
        .select(query, block.alias("_block"))
        .groupBy(query)
        .agg(F.array_sort(F.collect_list("_block")).alias("_blocks"))
        .select(
            query,
            F.concat(
                F.lit(f"{CONTEXT_HEADER}\n\n"),
                F.array_join(F.col("_blocks.text"), "\n"),
                F.lit("\n"),
            ).alias("context"),
        )
    )


def extract_response(df: DataFrame, column: str, out: str = "response") -> DataFrame:
    """The text after the last response mark, or the fixed apology."""
    tail = strip(F.substring_index(F.col(column), RESPONSE_MARK, -1))
    return df.withColumn(
        out, F.coalesce(F.nullif(tail, F.lit("")), F.lit(EMPTY_RESPONSE_TEXT))
    )


def result_card_column() -> Column:
    """Markdown card of one result row. The percentage is decimal arithmetic,
    so half-way cases round up the same way everywhere."""
    percent = F.round(F.col("score").cast("decimal(18,6)") * 100, 1).cast("string")
    extra = F.transform(
        F.map_entries("metadata"),
        lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]),
    )
    return F.concat(
        F.lit("**"), or_text(F.col("name"), ""), F.lit("**\n"),
        F.lit("Description: "), or_text(F.col("description"), ""), F.lit("\n"),
        F.lit("Category: "), or_text(F.col("category"), ""), F.lit("\n"),
        F.lit("Match Score: "), percent, F.lit("%\n"),
        F.array_join(F.coalesce(extra, F.array()), "\n"),
    )


def result_card(results: DataFrame, out: str = "card") -> DataFrame:
    return results.withColumn(out, result_card_column())


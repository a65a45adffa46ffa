"""Build a catalogue version: from raw rows to published tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.constants import BATCH_SIZE, MAX_TOKENS, TRAINING_FIELDS, VALIDATION_SPLIT
from stockweave.mapping import SchemaMapping, require_columns, text_col, user_col
from stockweave.operators.embed import HashEncoder, embed_column
from stockweave.operators.textprep import (
    embedding_text,
    format_prompt,
    require_rows,
    training_samples,
)
from stockweave.operators.tokens import Tokenizer, fit_tokens, hash_split
from stockweave.operators.validate import validate_rows
from stockweave.operators.versions import resolve_catalog
from stockweave.sources.catalog_csv import normalize_missing, read_catalog_csv
from stockweave.sources.store import (
    publish_products,
    publish_vectors,
    read_catalog_version,
)

ROW_KEY = "row_key"


@dataclass(frozen=True)
class TrainingConfig:
    batch_size: int = BATCH_SIZE
    max_tokens: int = MAX_TOKENS
    validation_split: float = VALIDATION_SPLIT


def load_catalog(
    spark: SparkSession,
    location: str,
    mapping: SchemaMapping,
    mode: str = "replace",
    root: str | None = None,
    previous_version: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a catalogue file, appended if asked to."""
    new = normalize_missing(read_catalog_csv(spark, location))
    ok, bad = validate_rows(new, mapping)
    previous = None
    if mode == "append" and previous_version:
        previous, _ = read_catalog_version(spark, root, previous_version)
    return resolve_catalog(mode, previous, ok), bad


def embed_catalog(
    catalog: DataFrame,
    mapping: SchemaMapping,
    make_encoder: Callable = HashEncoder,
    row_key: str | None = None,
) -> DataFrame:
    """``id, embedding`` per catalogue row, with category and filter columns.

    Those come from the same row in the same pass; a search can then filter the
    vector scan itself instead of joining ids.
    """
    customs = [c for c in mapping.customs(["filter"]) if c.user_column in catalog.columns]
    carried = {c.standard_column: user_col(c.user_column) for c in customs}
    if mapping.category_column in catalog.columns:
        carried["category"] = text_col(mapping.category_column)
    keep = [c.alias(n) for n, c in carried.items() if n not in ("id", "text")]
    texts = embedding_text(catalog, mapping, row_key, keep)
    return embed_column(texts, "text", make_encoder).drop("text")


def training_set(
    catalog: DataFrame,
    mapping: SchemaMapping,
    settings: TrainingConfig = TrainingConfig(),
    tokenizer: Tokenizer | None = None,
    null_text: str = "",
) -> DataFrame:
    """Training rows with prompt, token block and split, in one narrow plan."""
    samples = training_samples(catalog, mapping, null_text)
    split = hash_split(samples, ["id", "pair_no"], settings.validation_split)
    return fit_tokens(format_prompt(split), "prompt", settings.max_tokens, tokenizer)


def build_version(
    spark: SparkSession,
    location: str,
    root: str,
    version: str,
    mapping: SchemaMapping,
    mode: str = "replace",
    previous_version: str | None = None,
    make_encoder: Callable = HashEncoder,
) -> DataFrame:
    """Read, validate, append, embed and publish one version.

    Returns the rejected rows. Ids may repeat in an appended catalogue, so every
    row gets a key of its own (``ROW_KEY``) that its vector refers to. The keyed
    catalogue is written first and the vectors are made from what is stored.
    """
    catalog, bad = load_catalog(spark, location, mapping, mode, root, previous_version)
    require_columns(catalog, mapping, TRAINING_FIELDS, declared=True)
    require_rows(catalog)
    fresh = F.concat(
        F.lit(f"{version}-"), F.monotonically_increasing_id().cast("string")
    )
    old = F.col(ROW_KEY) if ROW_KEY in catalog.columns else F.lit(None).cast("string")
    stored = publish_products(catalog.withColumn(ROW_KEY, F.coalesce(old, fresh)), root, version)
    vectors = embed_catalog(stored, mapping, make_encoder, ROW_KEY)
    publish_vectors(stored, vectors, root, version, ROW_KEY, mapping.to_dict())
    return bad

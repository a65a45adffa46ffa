"""Whole config records: nested JSON in and out, their rules, their creation.

A record says where a catalogue comes from, how its columns are mapped, how it is
trained and how far that has got. It stays nested here, arrays of columns included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import ALL_ROLES, BATCH_SIZE, MAX_TOKENS, VALIDATION_SPLIT
from stockweave.mapping import user_col
from stockweave.operators.validate import config_rules, validate_records
from stockweave.operators.versions import check_previous_version

# Field names and types are fixed: other programs read and write these records.
STATS_TYPES = {
    "start_time": "string", "end_time": "string", "processed_records": "bigint",
    "total_records": "bigint", "training_accuracy": "double", "validation_score": "double",
    "error_rate": "double", "progress": "double", "llm_model": "string",
    "llm_model_name": "string", "completed_at": "string",
}
CONFIG_TYPES = {
    "_id": "string",
    "name": "string",
    "description": "string",
    "model_path": "string",
    "data_source": "struct<type: string, location: string, file_type: string, columns: "
    "array<struct<name: string, type: string, role: string, required: boolean>>, "
    "total_records: bigint>",
    "schema_mapping": "struct<id_column: string, name_column: string, "
    "description_column: string, category_column: string, custom_columns: "
    "array<struct<user_column: string, standard_column: string, role: string, "
    "required: boolean>>, required_columns: array<string>>",
    "training_config": "struct<model_type: string, embedding_model: string, "
    "batch_size: int, max_tokens: int, llm_model: string, "
    "training_params: map<string, string>, validation_split: double>",
    "status": "string",
    "error": "string",
    "mode": "string",
    "previous_version": "string",
    "version": "string",
    "created_at": "string",
    "updated_at": "string",
    "training_stats": "struct<" + ", ".join(f"{n}: {t}" for n, t in STATS_TYPES.items()) + ">",
}
CONFIG_FIELDS = tuple(CONFIG_TYPES)
JOB_TYPES = {
    "config_id": "string",
    "config": "struct<" + ", ".join(f"{n}: {t}" for n, t in CONFIG_TYPES.items()) + ">",
    "timestamp": "string",
}
_BAD = "_corrupt_record"
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
VERSION_FORMAT = "yyyyMMddHHmmss"


def parse_nested(
    df: DataFrame, column: str, types: Mapping[str, str], keep: Sequence[str] = (),
    required: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Typed records, nested as they are, and the rows that are not such records.

    A row that is no JSON object, has a field of another type, or lacks one of the
    ``required`` fields goes to the second output with its text.
    """
    schema = ", ".join(f"{n} {t}" for n, t in {**types, _BAD: "string"}.items())
    # One exploded element keeps the optimiser from repeating the parse per field.
    record = F.from_json(user_col(column), schema, {"columnNameOfCorruptRecord": _BAD})
    parsed = df.withColumn("_r", F.explode_outer(F.array(record)))
    good = F.col("_r").isNotNull() & F.col(f"_r.{_BAD}").isNull()
    for name in required:
        good = good & F.col(f"_r.{name}").isNotNull()
    good = F.coalesce(good, F.lit(False))
    kept = [user_col(k) for k in keep]
    return (
        parsed.where(good).select(*kept, *[F.col(f"_r.{n}").alias(n) for n in types]),
        parsed.where(~good).select(*kept, user_col(column).alias("raw")),
    )


def parse_configs(
    df: DataFrame, column: str = "record", keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Config records out of JSON, and malformed rows."""
    return parse_nested(df, column, CONFIG_TYPES, keep)


def parse_config_jobs(
    df: DataFrame, column: str = "message", keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Queued jobs with their whole config in ``config``, and malformed rows."""
    return parse_nested(df, column, JOB_TYPES, keep, ["config_id", "config"])


def config_json(configs: DataFrame, keep: Sequence[str] = (), out: str = "record") -> DataFrame:
    """Config records as JSON; absent fields are left out. Inverse of `parse_configs`."""
    body = F.struct(*[F.col(n) for n in CONFIG_FIELDS])
    return configs.select(*[user_col(k) for k in keep], F.to_json(body).alias(out))


def config_jobs(
    configs: DataFrame, timestamp: Column, keep: Sequence[str] = (), out: str = "message"
) -> DataFrame:
    """The queue message of each config. Inverse of `parse_config_jobs`."""
    body = F.struct(
        F.col("_id").alias("config_id"),
        F.struct(*[F.col(n) for n in CONFIG_FIELDS]).alias("config"),
        timestamp.alias("timestamp"),
    )
    return configs.select(*[user_col(k) for k in keep], F.to_json(body).alias(out))


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def record_rules(strict: bool = False) -> list[tuple[Column, str]]:
    """The ordered rules of a config record; ``strict`` looks into its columns too."""
    paths = {
        "data_source_type": "data_source.type",
        "name_column": "schema_mapping.name_column",
        "id_column": "schema_mapping.id_column",
    }
    rules = config_rules(lambda name: F.col(paths.get(name, name)))
    if not strict:
        return rules
    customs = F.coalesce(F.col("schema_mapping.custom_columns"), F.array())
    standard = F.transform(customs, lambda c: c["standard_column"])
    needed = F.coalesce(F.col("schema_mapping.required_columns"), F.array())
    source = F.col("data_source.columns")
    known = F.transform(F.coalesce(source, F.array()), lambda c: c["name"])
    mapped = F.concat(
        F.array(*[F.col(f"schema_mapping.{f}_column")
                  for f in ("id", "name", "description", "category")]),
        F.transform(customs, lambda c: c["user_column"]),
    )
    named = F.filter(mapped, lambda c: ~_blank(c))
    listed = F.size(known) > 0
    return [
        *rules,
        (F.exists(customs, lambda c: _blank(c["user_column"]) | _blank(c["standard_column"])),
         "schema_mapping.custom_columns need user_column and standard_column"),
        (F.exists(customs, lambda c: ~F.coalesce(c["role"], F.lit("")).isin(*ALL_ROLES)),
         f"schema_mapping.custom_columns roles are {', '.join(ALL_ROLES)}"),
        (F.size(F.array_distinct(standard)) < F.size(standard),
         "schema_mapping.custom_columns name a standard column twice"),
        (listed & (F.size(F.array_except(named, known)) > 0),
         "schema_mapping names a column that data_source.columns lacks"),
        (listed & (F.size(F.array_except(needed, known)) > 0),
         "schema_mapping.required_columns are not in data_source.columns"),
    ]


def validate_config_records(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``error``: the first rule that a record breaks, null if it is fine."""
    kept = df.withColumnRenamed("error", "_reported") if "error" in df.columns else df
    checked = validate_records(kept, record_rules(strict), "_failed")
    return checked.select(
        *[F.col("_reported" if c == "error" else c).alias(c) for c in df.columns if c != "error"],
        F.col("_failed").alias("error"),
    )


def _default(value: Column, default: object) -> Column:
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def new_configs(
    records: DataFrame, configs: DataFrame, now: Column, key: Column, file: Column,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """New config records, complete, and the records that were rejected, with ``error``.

    A record that breaks a rule is rejected, and one that appends to a version that is
    not there or not completed. The others get their id (``key``), time, status,
    version, paths (``file`` is the name of the uploaded file) and defaults. ``configs``
    has ``config_id, status`` of what there is.
    """
    checked = validate_config_records(records.withColumn("_id", key), strict)
    appends = (F.col("mode") == "append") & F.col("error").isNull()
    asked = checked.where(appends).select(
        F.col("_id").alias("config_id"), "mode", "previous_version"
    )
    refused = (
        check_previous_version(asked, configs)
        .where("NOT accepted")
        .select(F.col("config_id").alias("_id"), F.col("reason").alias("_refused"))
    )
    judged = checked.join(refused, "_id", "left").withColumn(
        "error", F.coalesce("error", "_refused")
    )
    bad = judged.where(F.col("error").isNotNull()).select("_id", "name", "error")
    time = F.date_format(now, RFC3339)
    training = F.col("training_config")
    for name, value in (
        ("batch_size", BATCH_SIZE), ("max_tokens", MAX_TOKENS),
        ("validation_split", VALIDATION_SPLIT),
    ):
        training = training.withField(name, _default(F.col(f"training_config.{name}"), value))
    first = {"start_time": time, "progress": F.lit(0.0), "processed_records": F.lit(0).cast("long"),
             "total_records": F.lit(0).cast("long")}
    made = {
        "model_path": F.concat(F.lit("models/"), F.col("_id")),
        "data_source": F.col("data_source").withField(
            "location", F.concat(F.lit("data/"), F.col("_id"), F.lit("/"), file)),
        "training_config": training,
        "status": F.lit("pending"),
        "error": F.lit(None).cast("string"),
        "version": F.date_format(now, VERSION_FORMAT),
        "created_at": time,
        "updated_at": time,
        "training_stats": F.struct(
            *[first.get(n, F.lit(None).cast(t)).alias(n) for n, t in STATS_TYPES.items()]),
    }
    good = judged.where(F.col("error").isNull()).select(
        *[made.get(n, F.col(n)).alias(n) for n in CONFIG_FIELDS]
    )
    return good, bad

"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the word and line contracts: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker.

    Code travels by value, so a module global would be new in each task.
    """
    import sys
    import types

    key = f"_stockweave_{name}"
    if key not in sys.modules:
        sys.modules[key] = types.ModuleType(key)
        sys.modules[key].state = {}
    return sys.modules[key].state


def tokenizer_file(name: str) -> str:
    """The content of a public tokenizer file, which the driver reads once."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()

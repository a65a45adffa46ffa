"""Config, status and job tables: listings, current state, queue, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import (
    PAGE_SIZE,
    RUNNING_STATUSES,
    STAGE_PROGRESS,
    STATUS_TTL_SECONDS,
    STATUSES,
    UNKNOWN_CONFIG_ERROR,
)
from stockweave.functions.ranking import positions
from stockweave.mapping import user_col

DEEP_ROWS = 10_000


def list_page(
    df: DataFrame,
    filters: Mapping[str, object] | None = None,
    sort: str = "created_at",
    key: str = "config_id",
    page: int = 1,
    size: int = PAGE_SIZE,
    ascending: bool = False,
) -> DataFrame:
    """One page of a filtered, sorted listing, with the total and page number.

    The total is a scalar subquery over the same filter; it reads only the
    filter columns.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    tests = [user_col(c) == F.lit(v) for c, v in (filters or {}).items() if v not in (None, "")]
    kept = df.where(reduce(and_, tests)) if tests else df
    order = [F.asc(sort) if ascending else F.desc(sort), F.asc(key)]
    first, last = (page - 1) * size, page * size
    if last > DEEP_ROWS:
        # A page this deep is cut out by position instead of sorted at the driver.
        return (
            positions(kept, order, total="total")
            .where(F.col("position").between(first + 1, last))
            .orderBy("position")
            .drop("position")
            .withColumn("page", F.lit(page))
        )
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return (
        kept.orderBy(*order)
        .offset(first)
        .limit(size)
        .withColumn("total", total.scalar())
        .withColumn("page", F.lit(page))
    )


def lookup(df: DataFrame, ids: DataFrame | Sequence, key: str = "config_id") -> DataFrame:
    """The record of each id, with ``found`` false for unknown ids.

    A list of ids becomes an ``IN`` predicate at the scan; a table of ids is
    semi-joined first, so the big table is not shuffled for a few hits.
    """
    if not isinstance(ids, DataFrame):
        wanted = list(dict.fromkeys(ids))
        hits = df.where(F.col(key).isin(wanted))
        kind = df.schema[key].dataType
        asked = df.sparkSession.createDataFrame([(i,) for i in wanted], "id string").select(
            F.col("id").cast(kind).alias(key)
        )
    else:
        asked = ids.select(key)
        hits = df.join(asked, key, "left_semi")
    return asked.join(hits.withColumn("_hit", F.lit(True)), key, "left").select(
        *df.columns, F.coalesce("_hit", F.lit(False)).alias("found")
    )


def latest_completed(configs: DataFrame) -> DataFrame:
    """The newest completed record, by creation time and then id."""
    newest = F.max_by(
        F.struct(*[user_col(c) for c in configs.columns]),
        F.struct("created_at", "config_id"),
    )
    return (
        configs.where(F.col("status") == "completed")
        .agg(newest.alias("_row"))
        .where(F.col("_row").isNotNull())
        .select("_row.*")
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Current state per config: the latest event decides every field.

    An event without progress resets it to 0, one without error clears it.
    Partial aggregation keeps one row per config and task before the shuffle.
    """
    state = F.struct(
        "status",
        F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("progress", F.lit(0.0)).alias("progress"),
        F.col("ts").alias("updated_at"),
    )
    return (
        events.groupBy("config_id")
        .agg(F.max_by(state, F.struct("ts", "event_id")).alias("_now"))
        .select("config_id", "_now.*")
    )


STATE_FIELDS = ("status", "error", "progress", "updated_at")


def merge_status(configs: DataFrame, updates: DataFrame) -> DataFrame:
    """The config table with the current state from ``latest_status`` merged in."""
    new = updates.select(
        "config_id", *[F.col(c).alias(f"_{c}") for c in STATE_FIELDS], F.lit(True).alias("_new")
    )
    rest = [c for c in configs.columns if c not in STATE_FIELDS]
    return configs.join(new, "config_id", "left").select(
        *rest,
        *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in STATE_FIELDS],
    )


def unknown_updates(configs: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates for configs that do not exist."""
    return updates.join(configs.select("config_id"), "config_id", "left_anti").withColumn(
        "reason", F.lit(UNKNOWN_CONFIG_ERROR)
    )


def status_with_fallback(
    asked: DataFrame,
    fresh: DataFrame,
    stored: DataFrame,
    now: Column,
    ttl_seconds: int = STATUS_TTL_SECONDS,
) -> DataFrame:
    """Per asked config: the fresh state if still valid, else the stored one,
    else ``not_found``. Expired states are dropped before the join."""
    oldest = now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    fields = ("status", "error", "progress")

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("config_id", F.struct(*fields).alias(mark))

    live = side(fresh.where(F.col("updated_at") > oldest), "_fresh")
    joined = asked.join(live, "config_id", "left").join(
        side(stored, "_stored"), "config_id", "left"
    )
    state = F.coalesce("_fresh", "_stored")
    source = (
        F.when(F.col("_fresh").isNotNull(), "fresh")
        .when(F.col("_stored").isNotNull(), "stored")
        .otherwise("none")
    )
    return joined.select(
        "config_id",
        F.coalesce(state["status"], F.lit("not_found")).alias("status"),
        F.coalesce(state["error"], F.lit("")).alias("error"),
        F.coalesce(state["progress"], F.lit(0.0)).alias("progress"),
        source.alias("source"),
    )


def queue_view(jobs: DataFrame, done: DataFrame | None = None, queue: str = "queue") -> DataFrame:
    """Waiting jobs with their place in line and the length of their queue.

    ``position`` 1 is served next (first in, first out); ``newest`` 1 is the
    latest arrival. Order is (timestamp, config id).
    """
    waiting = jobs if done is None else jobs.join(done, "config_id", "left_anti")
    placed = positions(
        waiting, [F.asc("timestamp"), F.asc("config_id")], [queue], total="queue_length"
    )
    return placed.withColumn("newest", F.col("queue_length") - F.col("position") + 1)


def job_progress(events: DataFrame) -> DataFrame:
    """Percent of the furthest stage each job has reached."""
    steps = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    percent = F.coalesce(F.try_element_at(steps, F.col("stage")), F.lit(0))
    return events.groupBy("config_id").agg(F.max(percent).alias("progress"))


def status_domain_check(df: DataFrame, column: str = "status") -> DataFrame:
    """Adds ``in_domain`` and ``is_terminal`` to each row."""
    status = F.coalesce(F.col(column), F.lit(""))
    return df.withColumn("in_domain", status.isin(*STATUSES)).withColumn(
        "is_terminal", ~status.isin(*RUNNING_STATUSES)
    )


def success_summary(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls that went well out of all, and the seconds they took."""
    micros = F.unix_micros("ts")
    return calls.groupBy(*by).agg(
        F.count_if("ok").alias("n_ok"),
        F.count(F.lit(1)).alias("n_total"),
        F.round(F.count_if("ok") * 100 / F.count(F.lit(1)), 2).alias("success_rate"),
        F.round((F.max(micros) - F.min(micros)) / 1_000_000, 2).alias("elapsed_seconds"),
    )

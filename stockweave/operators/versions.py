"""Replace and append modes, version checks and version history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.constants import MODES, PREVIOUS_VERSION_ERROR
from stockweave.mapping import user_col
from stockweave.session import written, written_and_counted

HOPS = 3


def resolve_catalog(mode: str, previous: DataFrame | None, new: DataFrame) -> DataFrame:
    """``replace``: the new rows. ``append``: previous rows and new rows.

    Columns are matched by name and may be missing on either side. Rows are
    not de-duplicated. Two sides that disagree on a type meet as text.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "replace" or previous is None:
        return new
    kinds = {f.name: f.dataType for f in previous.schema}
    clash = [f.name for f in new.schema if kinds.get(f.name, f.dataType) != f.dataType]

    def as_text(df: DataFrame) -> DataFrame:
        return df.withColumns({c: user_col(c).cast("string") for c in clash})

    if clash:
        previous, new = as_text(previous), as_text(new)
    return previous.unionByName(new, allowMissingColumns=True)


def latest_by_id(df: DataFrame, id_column: str, order_column: str) -> DataFrame:
    """Option for appended catalogues: the newest row of each id.

    A null order value is older than any other; rows of equal order are decided
    by their own text, so the result does not depend on the order of reading.
    """
    row = F.struct(*[user_col(c) for c in df.columns])
    order = user_col(order_column)
    newest = F.max_by(row, F.struct(order.isNotNull(), order, F.to_json(row)))
    return df.groupBy(user_col(id_column).alias("_id")).agg(newest.alias("_row")).select("_row.*")


def check_previous_version(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds ``accepted`` and ``reason``; an append needs a completed base.

    Only append requests take part in the join.
    """
    appends = (F.col("mode") == "append") & (
        F.coalesce("previous_version", F.lit("")) != ""
    )
    appends = F.coalesce(appends, F.lit(False))
    done = (
        configs.where(F.col("status") == "completed")
        .select(F.col("config_id").alias("previous_version"), F.lit(True).alias("_done"))
        .distinct()
    )
    rest = requests.where(~appends).withColumn("_done", F.lit(True))
    checked = requests.where(appends).join(done, "previous_version", "left")
    return (
        checked.unionByName(rest)
        .withColumn("accepted", F.coalesce("_done", F.lit(False)))
        .withColumn("reason", F.when(~F.col("accepted"), F.lit(PREVIOUS_VERSION_ERROR)))
        .select(*requests.columns, "accepted", "reason")
    )


def _hop(rows: DataFrame, up: DataFrame) -> DataFrame:
    """Move open rows on to where their ``root`` points.

    Rows that arrived keep a key of their own, so they spread evenly and match
    nothing instead of meeting at one root.
    """
    key = F.when(F.col("_open"), F.concat(F.lit(">"), "root")).otherwise(
        F.concat(F.lit("="), "config_id")
    )
    return (
        rows.withColumn("_key", key)
        .join(up, "_key", "left")
        .select(
            "config_id",
            F.coalesce("_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            (F.col("total_rows") + F.coalesce("_rows", F.lit(0))).alias("total_rows"),
            F.coalesce("_more", F.lit(False)).alias("_open"),
        )
    )


def _loops(rows: DataFrame, n: int) -> DataFrame:
    """``config_id, cycle, on_cycle`` of rows whose bases never end.

    ``rows`` has ``config_id, _base``, and every base is a row too. Pointers jump on,
    with the least id they passed, until they have gone further than there are rows:
    each is on a loop then, a row on a loop has passed all of it, and the rows that
    pointers lead to are just those on loops.
    """
    state = written(
        rows.select("config_id", F.col("_base").alias("_to"), F.col("config_id").alias("_low")),
        "loops",
    )
    reach = 1
    while reach < n:
        up = state.select(
            F.col("config_id").alias("_to"), F.col("_to").alias("_next"),
            F.col("_low").alias("_lower"),
        )
        state = written(
            state.join(up, "_to").select(
                "config_id", F.col("_next").alias("_to"), F.least("_low", "_lower").alias("_low")
            ),
            "loops",
        )
        reach *= 2
    loops = written(state.select("_to").distinct(), "on-loops")
    lows = state.select(F.col("config_id").alias("_to"), F.col("_low").alias("cycle"))
    on = loops.select(F.col("_to").alias("config_id"), F.lit(True).alias("_on"))
    return (
        state.join(lows, "_to")
        .join(on, "config_id", "left")
        .select("config_id", "cycle", F.coalesce("_on", F.lit(False)).alias("on_cycle"))
    )


def version_lineage(
    configs: DataFrame, max_depth: int = 1 << 20, report_cycles: bool = False
) -> DataFrame:
    """Root version, depth and cumulative rows of every version.

    Needs ``config_id, mode, previous_version, n_rows``. A version that does
    not append, or whose base is unknown, is its own root.

    Pointers reach four times as far each round: when every open row knows the
    sum over its nearest n ancestors, three look-ups in that same table make it
    4n. Each round is written out, and rows that reached their root leave it.

    A history that runs in a circle has no root. It is an error, or with
    ``report_cycles`` its rows get nulls and two more columns tell of it: ``cycle`` is
    the least id on the circle, for its members and for all that build on them, and
    ``on_cycle`` marks the members. All other rows get their answer.
    """
    base = F.when(
        (F.col("mode") == "append") & (F.coalesce("previous_version", F.lit("")) != ""),
        F.col("previous_version"),
    )
    nodes = configs.select("config_id", base.alias("_base"), F.col("n_rows").cast("bigint"))
    known = configs.select(F.col("config_id").alias("_base"), F.lit(True).alias("_known"))
    linked = (
        nodes.where(F.col("_base").isNotNull())
        .join(known, "_base", "left")
        .select("config_id", F.when(F.col("_known"), F.col("_base")).alias("_base"), "n_rows")
    )
    start = linked.unionByName(nodes.where(F.col("_base").isNull()))
    first, n_open = written_and_counted(
        start.select(
            "config_id",
            F.coalesce("_base", "config_id").alias("root"),
            F.when(F.col("_base").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
            F.col("n_rows").alias("total_rows"),
            F.col("_base").isNotNull().alias("_open"),
        ),
        "lineage",
        F.col("_open"),
    )
    state, before, reach = first, None, 1
    # An open row's total covers itself up to, not including, its `root`. A history
    # that ends has rows of every depth up to its own, so a round in which none
    # arrives leaves only those that never end.
    while n_open and n_open != before:
        if reach > max_depth and not report_cycles:
            raise ValueError("version history is longer than max_depth or has a cycle")
        up = state.select(
            F.concat(F.lit(">"), "config_id").alias("_key"),
            F.col("root").alias("_root"),
            F.col("depth").alias("_depth"),
            F.col("total_rows").alias("_rows"),
            F.col("_open").alias("_more"),
        )
        moved = state.where("_open")
        for _ in range(HOPS):
            moved = _hop(moved, up)
        before = n_open
        state, n_open = written_and_counted(
            state.where(~F.col("_open")).unionByName(moved), "lineage", F.col("_open")
        )
        reach *= HOPS + 1
    if n_open and not report_cycles:
        raise ValueError("a version history has a cycle")
    done = state.where(~F.col("_open")).select("config_id", "root", "depth", "total_rows")
    if not report_cycles:
        return done
    done = done.select(
        "*", F.lit(None).cast("string").alias("cycle"), F.lit(False).alias("on_cycle")
    )
    if not n_open:
        return done
    endless = state.where("_open").select("config_id")
    links = first.select("config_id", F.col("root").alias("_base"))
    found = _loops(endless.join(links, "config_id"), n_open)
    return done.unionByName(
        found.select(
            "config_id",
            *[F.lit(None).cast(t).alias(c)
              for c, t in (("root", "string"), ("depth", "bigint"), ("total_rows", "bigint"))],
            "cycle", "on_cycle",
        )
    )


def append_summary(bases: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The append request for each base version that has new rows.

    ``new_rows`` carries the ``config_id`` of its base; it is counted before
    the join. Schema and training settings come from the base as they are.
    """
    counts = new_rows.groupBy("config_id").agg(F.count(F.lit(1)).alias("_n"))
    carried = [c for c in ("schema_mapping", "training_config") if c in bases.columns]
    return bases.join(counts, "config_id").select(
        F.concat(F.lit("Append to "), F.col("name")).alias("name"),
        F.concat(F.lit("Appending "), F.col("_n").cast("string"), F.lit(" products")).alias(
            "description"
        ),
        F.lit("append").alias("mode"),
        F.col("config_id").alias("previous_version"),
        *carried,
        F.lit("csv").alias("source_type"),
        F.lit("csv").alias("file_type"),
    )

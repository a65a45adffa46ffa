"""Search over a catalogue: score, rank, and return product records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.constants import (
    MAX_ITEMS,
    MIN_SCORE,
    NO_RESULTS_TEXT,
    SEARCH_PAGE_SIZE,
)
from stockweave.functions.text import is_blank
from stockweave.functions.vectors import has_bad_value, squared_norm
from stockweave.mapping import SchemaMapping, require_columns, text_col, user_col
from stockweave.operators.filters import (
    ALIASES,
    active_filters,
    apply_filters,
    covers,
    filter_columns,
)
from stockweave.operators.project import product_records
from stockweave.operators.deep_pages import deep_ranks
from stockweave.operators.score import (
    BROADCAST_BYTES,
    candidates,
    gather_requests,
    ranked,
    thinned,
)
from stockweave.operators.tables import latest_completed
from stockweave.session import BROADCAST_ROWS, written, written_and_counted


# Rows up to the end of a page that a search keeps per request and task.
DEEP_ROWS = 2000


def join_vectors(products: DataFrame, vectors: DataFrame, on: str = "id") -> DataFrame:
    """Attach each vector to its row by id; rows without a vector drop out.

    :func:`vector_checks` counts what does not match.
    """
    return products.join(vectors.select(on, "embedding"), on)


def vector_checks(vectors: DataFrame, products: DataFrame) -> DataFrame:
    """One row of facts on a vector block and how well it fits its catalogue.

    Both id columns go through one pre-aggregated count per id, so repeated ids
    neither multiply rows nor load one task.
    """
    shape = vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.count_if(has_bad_value(F.col("embedding"))).alias("n_bad_values"),
        F.round(F.sqrt(F.min(squared_norm(F.col("embedding")))), 6).alias("min_norm"),
        F.round(F.sqrt(F.max(squared_norm(F.col("embedding")))), 6).alias("max_norm"),
    )
    return shape.withColumn("_ids", id_mismatches(vectors, products).scalar()).select(
        *shape.columns,
        F.col("_ids.n_left").alias("vectors_without_row"),
        F.col("_ids.n_right").alias("rows_without_vector"),
    )


def id_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of each side whose id the other side lacks, as one struct cell."""
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    sides = left.select("id", one.alias("l"), none.alias("r")).unionAll(
        right.select("id", none.alias("l"), one.alias("r"))
    )
    per_id = sides.groupBy("id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    only_left = F.sum(F.when(F.col("r") == 0, F.col("l")).otherwise(0))
    only_right = F.sum(F.when(F.col("l") == 0, F.col("r")).otherwise(0))
    return per_id.agg(
        F.struct(
            F.coalesce(only_left, F.lit(0)).alias("n_left"),
            F.coalesce(only_right, F.lit(0)).alias("n_right"),
        ).alias("mismatches")
    )


def attach_records(
    ranks: DataFrame,
    catalog: DataFrame,
    mapping: SchemaMapping,
    n_ranks: int | None,
    null_text: str = "",
    row_key: str | None = None,
) -> DataFrame:
    """Turn ranked vector ids into result records.

    The ranks are few: with a proven bound they are broadcast and the catalogue
    is scanned in place, else the join is left to the optimiser.
    """
    key = text_col(row_key or mapping.id_column).alias("_key")
    records = product_records(catalog, mapping, null_text, [key])
    small = n_ranks is not None and n_ranks <= BROADCAST_ROWS
    found = ranks.withColumnRenamed("id", "_key")
    return records.join(F.broadcast(found) if small else found, "_key").drop("_key")


RESULT_COLUMNS = (
    "query_id", "rank", "id", "name", "description", "category", "score", "metadata"
)


def in_place(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors whose id is in ``ids``, without moving them where that can be avoided.

    Only ids are looked at first. If few are wanted, or few of those that there are
    are not, that list is broadcast to the scan; its length is counted. Only if both
    are long, the vectors are joined, once, and written.
    """
    wanted, n = written_and_counted(ids.where("id IS NOT NULL").distinct(), "wanted-ids")
    if n <= BROADCAST_ROWS:
        return vectors.join(F.broadcast(wanted), "id", "left_semi")
    lost, m = written_and_counted(
        vectors.select("id").join(wanted, "id", "left_anti").distinct(), "other-ids"
    )
    if m > BROADCAST_ROWS:
        return written(vectors.join(wanted, "id", "left_semi"), "wanted-vectors")
    known = vectors.where("id IS NOT NULL")
    return known.join(F.broadcast(lost), "id", "left_anti") if m else known


def vectors_with_rows(
    catalog: DataFrame, vectors: DataFrame, mapping: SchemaMapping, settled: bool
) -> DataFrame:
    """Vectors that a catalogue row belongs to; others must not take ranks.

    ``settled`` says that all do, as those of a published version.
    """
    if settled:
        return vectors
    return in_place(vectors, catalog.select(text_col(mapping.id_column).alias("id")))


def filtered_vectors(
    catalog: DataFrame,
    vectors: DataFrame,
    mapping: SchemaMapping,
    filters: Mapping[str, object],
    row_key: str | None = None,
    settled: bool = False,
) -> DataFrame:
    """Vectors of the rows that pass the filters, before any ranking.

    A vector table published with its filter columns is filtered where it is;
    otherwise the ids of the passing rows are.
    """
    active = active_filters(filters)
    if not active:
        return vectors_with_rows(catalog, vectors, mapping, settled)
    if covers(filter_columns(vectors, None), active):
        return vectors_with_rows(catalog, apply_filters(vectors, active), mapping, settled)
    passing = apply_filters(catalog, active, mapping)
    return in_place(vectors, passing.select(text_col(row_key or mapping.id_column).alias("id")))


def search(
    catalog: DataFrame,
    vectors: DataFrame,
    requests: DataFrame,
    mapping: SchemaMapping,
    k: int = MAX_ITEMS,
    floor: float | None = MIN_SCORE,
    filters: Mapping[str, object] | None = None,
    group: str | None = None,
    null_text: str = "",
    row_key: str | None = None,
    settled: bool | None = None,
    **sizes: int,
) -> DataFrame:
    """Result records of a table of requests ``(query_id, embedding)``.

    Filters come before ranking, so a filtered search still fills its ``k``
    rows. With ``group`` (a model path, say) each request is answered from the
    vectors of its own group only. ``row_key`` names the catalogue column that
    the vector ids refer to, if that is not the mapped id. Tables with one were
    built together; ``settled`` says so of others, and spares a look at all ids.
    """
    require_columns(catalog, mapping, ["id", "name"])
    settled = row_key is not None if settled is None else settled
    pool = filtered_vectors(catalog, vectors, mapping, filters or {}, row_key, settled)
    found = candidates(pool, requests, k, floor, group, **sizes)
    return attach_records(
        ranked(found.rows, k), catalog, mapping, found.n_items, null_text, row_key
    ).select(*RESULT_COLUMNS)


def filterable_vectors(
    catalog: DataFrame,
    vectors: DataFrame,
    mapping: SchemaMapping,
    keys: set[str] | None,
    row_key: str | None = None,
    settled: bool = False,
) -> tuple[DataFrame, dict[str, str]]:
    """Vectors with a column for each filter key (None: every key of the mapping).

    A vector table published with its filter columns is left as it is; the catalogue
    is joined only if a column is absent.
    """
    own, users = filter_columns(vectors, None), filter_columns(catalog, mapping)
    keys = {ALIASES.get(k, k) if k not in users else k for k in keys} if keys is not None \
        else set(users)
    if covers(own, dict.fromkeys(keys, True)):
        return vectors_with_rows(catalog, vectors, mapping, settled), {k: own[k] for k in keys}
    names = {k: f"_filter{i}" for i, k in enumerate(sorted(keys & users.keys()))}
    keyed = catalog.select(
        text_col(row_key or mapping.id_column).alias("id"),
        *[user_col(users[k]).alias(n) for k, n in names.items()],
    )
    more = [c for c in vectors.columns if c not in names.values()]
    return vectors.select(*map(user_col, more)).join(keyed, "id"), names


def _asked(requests: DataFrame, k: int, items: Column, group: str | None) -> DataFrame:
    given = F.col("filters") if "filters" in requests.columns else F.lit(None)
    return requests.select(
        "query_id", "embedding", *([group] if group else []),
        F.coalesce(given, F.lit("")).alias("filters"), items.alias("items"),
    )


def _own(requests: DataFrame, column: str, default: int) -> Column:
    """A request's own whole number from 1, else the default."""
    if column not in requests.columns:
        return F.lit(default).cast("bigint")
    value = F.col(column).cast("bigint")
    return F.when(value >= 1, value).otherwise(default)


def search_each(
    catalog: DataFrame,
    vectors: DataFrame,
    requests: DataFrame,
    mapping: SchemaMapping,
    k: int = MAX_ITEMS,
    floor: float | None = MIN_SCORE,
    row_key: str | None = None,
    settled: bool | None = None,
    group: str | None = None,
    **sizes: int,
) -> DataFrame:
    """Like :func:`search`, for requests that bring their own settings.

    ``filters`` is JSON text per request, such as
    ``{"category": "Ovens", "price": [0, 1000]}``; ``max_items`` is the cut of the
    request, absent or below 1 meaning ``k``; ``group`` names a column (a model path,
    say) in which request and vector must agree. Any of them may be left out. All
    requests share one scan, however many different filters they have
    (`request_index`), and each keeps as many rows per task as it wants itself.
    """
    settled = row_key is not None if settled is None else settled
    asked = _asked(requests, k, _own(requests, "max_items", k), group)
    found = candidates(
        vectors, asked, k, floor, group, **sizes,
        pool=lambda keys: filterable_vectors(catalog, vectors, mapping, keys, row_key, settled),
    )
    most = None if found.n_items is None or "max_items" in requests.columns else k
    return attach_records(
        ranked(found.rows, most), catalog, mapping, found.n_items, row_key=row_key
    ).select(*RESULT_COLUMNS)


def search_requests(
    catalog: DataFrame,
    vectors: DataFrame,
    requests: DataFrame,
    mapping: SchemaMapping,
    k: int = MAX_ITEMS,
    floor: float | None = MIN_SCORE,
    row_key: str | None = None,
    settled: bool | None = None,
    group: str | None = None,
    **sizes: int,
) -> DataFrame:
    """The page that each request asks for, with its own filters, cut and model.

    As :func:`search_each`, and a request may name its ``page`` (from 1); pages are
    ``max_items`` rows long. ``total`` counts the rows that pass the filters and
    reach the floor, in the same scan that finds the rows of the page.
    """
    settled = row_key is not None if settled is None else settled
    size, page = _own(requests, "max_items", k), _own(requests, "page", 1)
    asked = _asked(requests, k, size * page, group)
    found = candidates(
        vectors, asked, k, floor, group, counts=True, **sizes,
        pool=lambda keys: filterable_vectors(catalog, vectors, mapping, keys, row_key, settled),
    )
    settings = requests.select("query_id", size.alias("_size"), page.alias("page"))
    if found.n_items is not None:  # as few as the requests that were gathered
        settings = F.broadcast(settings)
    best = Window.partitionBy("query_id").orderBy(
        F.col("id").isNull(), F.desc("score"), F.asc("id")
    )
    totals = Window.partitionBy("query_id")
    size, page = F.col("_size"), F.col("page")
    ranks = (
        thinned(found.rows, None)
        .withColumn("total", F.sum("passing").over(totals))
        .withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("id").isNotNull() & (F.col("rank") <= F.col("items")))
        .join(settings, "query_id")
        .where(F.col("rank") > (page - 1) * size)
        .select("query_id", "id", "score", "rank", "total", "page",
                F.ceil(F.col("total") / size).cast("bigint").alias("total_pages"))
    )
    return attach_records(ranks, catalog, mapping, found.n_items, row_key=row_key).select(
        "query_id", "page", "total", "total_pages", *RESULT_COLUMNS[1:]
    )


def search_page(
    catalog: DataFrame,
    vectors: DataFrame,
    requests: DataFrame,
    mapping: SchemaMapping,
    page: int = 1,
    size: int = SEARCH_PAGE_SIZE,
    floor: float | None = MIN_SCORE,
    filters: Mapping[str, object] | None = None,
    row_key: str | None = None,
    settled: bool | None = None,
    **sizes: int,
) -> DataFrame:
    """Page ``page`` of each request's ranked list, with totals.

    ``total`` counts every catalogue row that reaches the floor, so it is the
    number of rows that all pages show. The scan that finds the
    best ``page * size`` rows counts those too, so one pass serves both. A page that
    ends beyond ``DEEP_ROWS`` is found by counting scores (`deep_pages`): then no task
    keeps the rows in front of it.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    settled = row_key is not None if settled is None else settled
    pool = filtered_vectors(catalog, vectors, mapping, filters or {}, row_key, settled)
    first, last = (page - 1) * size + 1, page * size
    ranks = n_items = None
    if last > DEEP_ROWS:
        asked = requests.select("query_id", "embedding")
        most = sizes.get("broadcast_bytes", BROADCAST_BYTES)
        matrix, _, requests = gather_requests(asked, None, 1, most)
        if matrix is not None and matrix:
            ranks = deep_ranks(pool.select("id", "embedding"), matrix, first, last, floor)
            n_items = size * len(matrix[None][0])
    if ranks is None:
        found = candidates(pool, requests, last, floor, None, counts=True, **sizes)
        n_items = found.n_items
        best = Window.partitionBy("query_id").orderBy(
            F.col("id").isNull(), F.desc("score"), F.asc("id")
        )
        totals = Window.partitionBy("query_id")
        ranks = (
            thinned(found.rows, last)
            .withColumn("total", F.sum("passing").over(totals))
            .withColumn("rank", F.row_number().over(best).cast("bigint"))
            .where(F.col("id").isNotNull() & F.col("rank").between(first, last))
        )
    ranks = ranks.select(
        "query_id", "id", "score", "rank", "total",
        F.ceil(F.col("total") / size).cast("bigint").alias("total_pages"),
        F.lit(page).alias("page"),
    )
    return attach_records(ranks, catalog, mapping, n_items, row_key=row_key).select(
        "query_id", "page", "total", "total_pages", *RESULT_COLUMNS[1:]
    )


def search_summary(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Per request: result count, original query, model path, fixed no-hit text.

    Results are counted per request before they meet the request table.
    """
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.col("n"), F.lit(0))
    return requests.join(counts, "query_id", "left").select(
        "query_id",
        F.col("query").alias("original"),
        "model_path",
        total.alias("total"),
        F.when(total == 0, F.lit(NO_RESULTS_TEXT)).alias("natural_response"),
    )


def route_requests(
    requests: DataFrame, configs: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Fill in ``model_path``: own path, else that of ``config_id``, else latest.

    Requests with an empty query get an ``error`` instead. Only requests that
    need a config look one up, so requests without one do not meet in one task.
    Those of the columns ``keep`` that there are stay.
    """
    blank_query = is_blank(F.col("query"))
    own = F.nullif(F.col("model_path"), F.lit(""))
    marked = requests.withColumn("_own", own)
    latest = latest_completed(configs).select("model_path")
    by_config = configs.select(
        F.col("config_id"), F.col("model_path").alias("_by_config")
    )
    looks_up = F.col("_own").isNull() & F.col("config_id").isNotNull()
    direct = marked.where(~looks_up).withColumn("_by_config", F.lit(None).cast("string"))
    looked = marked.where(looks_up).join(by_config, "config_id", "left")
    return direct.unionByName(looked).select(
        "query_id",
        "query",
        "config_id",
        F.when(
            ~blank_query, F.coalesce("_own", "_by_config", latest.scalar())
        ).alias("model_path"),
        F.when(blank_query, F.lit("query is required")).alias("error"),
        *[c for c in keep if c in requests.columns],
    )

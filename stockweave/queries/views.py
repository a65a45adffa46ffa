"""How the operators see the given tables: catalogues, requests, configs, jobs.

Every view is derived by Spark from a whole table; the matching SQL text is
kept next to it for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions.hashing import key_text
from stockweave.mapping import CustomColumn, SchemaMapping
from stockweave.operators.embed import hash_embed
from stockweave.operators.tables import latest_status, merge_status
from stockweave.operators.textprep import embedding_text
from stockweave.session import spread
from stockweave.sources.records import job_messages

PART = SchemaMapping(
    id_column="p_partkey",
    name_column="p_name",
    description_column="p_type",
    category_column="p_brand",
    custom_columns=(
        CustomColumn("p_size", "size", "training", True),
        CustomColumn("p_retailprice", "price", "metadata"),
    ),
    required_columns=("p_partkey", "p_name", "p_brand"),
)
# The same catalogue with the price as a filter column, and one column the data lacks.
PART_FILTERS = SchemaMapping(
    id_column="p_partkey",
    name_column="p_name",
    description_column="p_type",
    category_column="p_brand",
    custom_columns=(
        CustomColumn("p_size", "size", "filter"),
        CustomColumn("p_retailprice", "list_price", "filter"),
        CustomColumn("p_retailprice", "price", "metadata"),
        CustomColumn("p_color", "color", "training"),
    ),
)
DOCS = SchemaMapping(
    id_column="doc_id",
    name_column="source",
    description_column="text",
    category_column="lang",
    custom_columns=(CustomColumn("n_chars", "length", "metadata"),),
)

SQL_TOKEN = "cast(concat('0x', substr(md5({0}), 1, 8)) AS bigint)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


# --- catalogue versions -----------------------------------------------------

def previous_part(spark, d):
    """Even part keys, published before the size column existed."""
    return table(spark, d, "part").where("p_partkey % 2 = 0").drop("p_size")


def new_part(spark, d):
    return table(spark, d, "part").where("p_partkey % 2 = 1")


def patchy_part(spark, d):
    """Parts with blank names and missing keys, for the row checks."""
    return table(spark, d, "part").withColumns(
        {
            "p_name": F.when(F.col("p_type") == "ECONOMY", F.lit("  ")).otherwise(F.col("p_name")),
            "p_partkey": F.when(F.col("p_brand") != "Brand#2", F.col("p_partkey")),
        }
    )


SQL_PATCHY = """patchy AS (
  SELECT CASE WHEN p_brand <> 'Brand#2' THEN p_partkey END AS p_partkey,
         CASE WHEN p_type = 'ECONOMY' THEN '  ' ELSE p_name END AS p_name,
         p_brand, p_type, p_size, p_retailprice
  FROM part)"""


# --- vectors and requests ---------------------------------------------------

def part_vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", "label"
    )


def label_requests(spark, d):
    """One request per label: the mean direction of its members.

    The mean is taken per component, with partial sums before the shuffle.
    """
    means = (
        table(spark, d, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
    )
    by_label = means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c"),
        F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("_norm"),
    )
    return by_label.select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"),
        F.transform("_c", lambda c: F.round(c["m"] / F.col("_norm"), 6)).alias("embedding"),
        "label",
    )


SQL_LABEL_REQUESTS = """means AS (
  SELECT label, pos, avg(v) AS m
  FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos
        FROM embeddings)
  GROUP BY label, pos),
comp AS (
  SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS m FROM means),
requests AS (
  SELECT 'label-' || label AS query_id, label, list(m ORDER BY pos) AS embedding
  FROM comp GROUP BY label),
scores AS (
  SELECT r.query_id, r.label AS request_label, e.label AS vector_label,
         cast(e.vec_id AS varchar) AS id,
         round(list_inner_product(r.embedding, e.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM requests r, embeddings e)"""

SQL_PART_RECORDS = """records AS (
  SELECT cast(p_partkey AS varchar) AS id, p_name AS name, p_type AS description,
         p_brand AS category, 'price=' || cast(p_retailprice AS varchar) AS metadata,
         p_retailprice
  FROM part)"""


def document_texts(spark, d):
    return spread(embedding_text(table(spark, d, "documents"), DOCS), "id")


def document_vectors(spark, d):
    return hash_embed(document_texts(spark, d), "text").select("id", "embedding")


def user_turns(spark, d):
    return table(spark, d, "conversations").where("role = 'user'")


def turn_requests(spark, d):
    """Every user turn as a text request."""
    return user_turns(spark, d).select(
        key_text("conv_id", "turn").alias("query_id"), F.col("text").alias("query")
    )


def turn_vectors(spark, d):
    return hash_embed(turn_requests(spark, d), "query").select("query_id", "embedding")


def sql_hash_vectors(name: str, source: str, key: str, text: str) -> str:
    """CTEs for sparse hash vectors: ``<name>(key, bucket, v)``."""
    token = SQL_TOKEN.format("w")
    return f"""{name}_n AS (
  SELECT k, bucket, count(*) AS n FROM (
    SELECT k, {token} % 256 AS bucket FROM (
      SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS w FROM {source})
    WHERE w <> '')
  GROUP BY k, bucket),
{name} AS (
  SELECT k, bucket, n,
         cast(n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS FLOAT)::DOUBLE AS v
  FROM {name}_n)"""


SQL_DOC_TEXT = "concat_ws(' ', nullif(source, ''), nullif(text, ''), nullif(lang, ''))"
SQL_DOC_VECTORS = sql_hash_vectors("dv", "documents", "cast(doc_id AS varchar)", SQL_DOC_TEXT)
SQL_TURN_VECTORS = sql_hash_vectors(
    "qv", "conversations WHERE role = 'user'",
    "cast(conv_id AS varchar) || '|' || cast(turn AS varchar)", "text",
)
SQL_TURN_SCORES = f"""{SQL_DOC_VECTORS},
{SQL_TURN_VECTORS},
scores AS (
  SELECT q.k AS query_id, d.k AS id, round(sum(q.v * d.v), 6) + 0.0 AS score
  FROM qv q JOIN dv d ON q.bucket = d.bucket GROUP BY q.k, d.k),
ranks AS (
  SELECT query_id, id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank
  FROM scores)"""


# --- configs, status events, jobs --------------------------------------------

STATUS_OF = {
    "signup": "pending",
    "view": "queued",
    "click": "processing",
    "purchase": "completed",
    "error": "failed",
}
STAGE_OF = {"signup": "loaded", "view": "embedded", "click": "samples", "purchase": "completed"}


def _lookup(mapping: dict[str, str], column: str):
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(pairs, F.col(column))


def status_events(spark, d):
    """Events as status reports; a failure brings no progress."""
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("config_id"),
        _lookup(STATUS_OF, "event_type").alias("status"),
        F.when(failed, F.concat(F.lit("failed at event "), F.col("event_id").cast("string"))).alias(
            "error"
        ),
        F.when(~failed, F.col("value")).alias("progress"),
        _lookup(STAGE_OF, "event_type").alias("stage"),
        "ts",
    )


def bare_configs(spark, d):
    """One config per user, before any status report reached it."""
    user = F.col("user_id")
    appends = (user % 3 == 0) & (user >= 3)
    return (
        table(spark, d, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n_rows"))
        .select(
            user.cast("string").alias("config_id"),
            F.concat(F.lit("cfg-"), user.cast("string")).alias("name"),
            F.concat(F.lit("models/"), user.cast("string")).alias("model_path"),
            F.when(appends, "append").otherwise("replace").alias("mode"),
            F.when(appends, (user - 3).cast("string")).alias("previous_version"),
            F.lit("pending").alias("status"),
            F.lit("").alias("error"),
            F.lit(0.0).alias("progress"),
            "created_at",
            F.col("created_at").alias("updated_at"),
            "n_rows",
        )
    )


def configs(spark, d):
    """The config table with its current state."""
    return merge_status(bare_configs(spark, d), latest_status(status_events(spark, d)))


SQL_STATUS_EVENTS = """status_events AS (
  SELECT event_id, cast(user_id AS varchar) AS config_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'queued'
              WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
              WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_type = 'error' THEN 'failed at event ' || event_id END AS error,
         CASE WHEN event_type <> 'error' THEN value END AS progress,
         CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 30
              WHEN 'click' THEN 50 WHEN 'purchase' THEN 100 ELSE 0 END AS percent,
         ts
  FROM events)"""
SQL_LATEST = f"""{SQL_STATUS_EVENTS},
latest AS (
  SELECT config_id, status, coalesce(error, '') AS error, coalesce(progress, 0.0) AS progress,
         ts AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY ts DESC, event_id DESC) AS n
        FROM status_events)
  WHERE n = 1)"""
SQL_CONFIGS = f"""{SQL_LATEST},
bare AS (
  SELECT cast(user_id AS varchar) AS config_id, 'cfg-' || user_id AS name,
         'models/' || user_id AS model_path,
         CASE WHEN user_id % 3 = 0 AND user_id >= 3 THEN 'append' ELSE 'replace' END AS mode,
         CASE WHEN user_id % 3 = 0 AND user_id >= 3 THEN cast(user_id - 3 AS varchar) END
           AS previous_version,
         min(ts) AS created_at, count(*) AS n_rows
  FROM events GROUP BY user_id),
configs AS (
  SELECT b.*, l.status, l.error, l.progress, l.updated_at
  FROM bare b JOIN latest l USING (config_id))"""


def job_queue(spark, d):
    """Every event as a queued job message; every seventh arrives cut off."""
    user = F.col("user_id").cast("string")
    jobs = table(spark, d, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("config_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("cfg-"), user)).alias("name"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("models/"), user)).alias(
            "model_path"
        ),
        F.when(F.col("event_type") == "purchase", F.lit("append")).alias("mode"),
    )
    sent = job_messages(jobs, keep=["event_id", "ts"])
    cut = F.substring("message", 1, 4)
    return sent.withColumn(
        "message", F.when(F.col("event_id") % 7 == 0, cut).otherwise(F.col("message"))
    )


SQL_JOBS = """jobs AS (
  SELECT event_id, 'job-' || event_id AS config_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
         CASE WHEN event_type <> 'view' THEN 'cfg-' || user_id ELSE 'Unnamed' END AS name,
         CASE WHEN event_type <> 'click' THEN 'models/' || user_id ELSE 'unknown' END AS model_path,
         CASE WHEN event_type = 'purchase' THEN 'append' ELSE 'replace' END AS mode
  FROM events WHERE event_id % 7 <> 0)"""

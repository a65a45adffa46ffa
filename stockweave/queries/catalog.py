"""Sources, mapping, validation, filters and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.constants import MISSING_TOKENS
from stockweave.mapping import text_col
from stockweave.operators.embed import hash_embed
from stockweave.operators.filters import apply_filters
from stockweave.operators.project import (
    apply_schema_mapping,
    check_required_columns,
    fill_missing_text,
    metadata_map,
    preview,
)
from stockweave.operators.search import join_vectors
from stockweave.operators.validate import (
    CONFIG_DEFAULTS,
    apply_defaults,
    rejection_counts,
    validate_configs,
    validate_rows,
    with_reject_reasons,
)
from stockweave.operators.versions import (
    append_summary,
    check_previous_version,
    latest_by_id,
    resolve_catalog,
    version_lineage,
)
from stockweave.plans.build import build_version
from stockweave.queries.views import (
    PART,
    PART_FILTERS,
    SQL_CONFIGS,
    SQL_JOBS,
    SQL_PATCHY,
    bare_configs,
    configs,
    job_queue,
    new_part,
    part_vectors,
    patchy_part,
    previous_part,
    sql_hash_vectors,
    table,
)
from stockweave.session import fresh_folder
from stockweave.sources.catalog_csv import (
    describe_source,
    export_catalog_csv,
    normalize_missing,
    read_catalog_csv,
)
from stockweave.sources.configs import (
    config_jobs,
    new_configs,
    parse_config_jobs,
    parse_configs,
)
from stockweave.sources.records import JOB_SCHEMA, job_messages, parse_jobs, parse_requests
from stockweave.sources.store import (
    artifact_manifest,
    open_version,
    publish_vectors,
    read_catalog_version,
    read_vectors,
    write_catalog_version,
)

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def as_text(df):
    return df.select(*[text_col(c).alias(c) for c in df.columns])


# --- S: sources and sinks -----------------------------------------------------

@query
def s1_read_catalog_csv(spark, d):
    path = fresh_folder(spark, "part-csv")
    export_catalog_csv(table(spark, d, "part"), path)
    return read_catalog_csv(spark, path)


ORACLE["s1_read_catalog_csv"] = """
SELECT cast(p_partkey AS varchar) AS p_partkey, nullif(p_name, '') AS p_name,
       p_brand, p_type, cast(p_size AS varchar) AS p_size,
       cast(p_retailprice AS varchar) AS p_retailprice
FROM part"""


@query
def s1_read_quoted_csv(spark, d):
    """Long texts with line breaks, commas and quotes survive the round trip."""
    path = fresh_folder(spark, "documents-csv")
    export_catalog_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    read = read_catalog_csv(spark, path, ["doc_id", "text", "lang"])
    return read.select("doc_id", "lang", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


@query
def s1_read_split_csv(spark, d):
    """All documents in large quoted files, cut into records by many tasks.

    A file is what one task of the scan reads: one for small tables, never all of a
    large one.
    """
    path = fresh_folder(spark, "one-csv")
    export_catalog_csv(table(spark, d, "documents"), path)
    read = read_catalog_csv(spark, path, block_bytes=1 << 17)
    return read.withColumn("text", F.md5("text"))


ORACLE["s1_read_split_csv"] = """
SELECT cast(doc_id AS varchar) AS doc_id, md5(nullif(text, '')) AS text,
       nullif(lang, '') AS lang, nullif(source, '') AS source, cast(n_chars AS varchar) AS n_chars
FROM documents"""


ORACLE["s1_read_quoted_csv"] = """
SELECT cast(doc_id AS varchar) AS doc_id, lang, length(text) AS n, md5(text) AS text_md5
FROM (SELECT doc_id, lang, nullif(text, '') AS text FROM documents)"""


@query
def s2_normalize_missing(spark, d):
    """Two thirds of the names are overwritten with the missing-cell texts."""
    tokens = F.array(*[F.lit(t) for t in MISSING_TOKENS])
    slot = (F.col("p_partkey") % 30).cast("int")
    dirty = table(spark, d, "part").withColumn(
        "p_name", F.when(slot < len(MISSING_TOKENS), F.get(tokens, slot)).otherwise(F.col("p_name"))
    )
    return normalize_missing(dirty)


ORACLE["s2_normalize_missing"] = """
SELECT p_partkey, CASE WHEN p_partkey % 30 >= 19 THEN p_name END AS p_name,
       p_brand, p_type, p_size, p_retailprice
FROM part"""


@query
def s3_describe_source(spark, d):
    return describe_source(table(spark, d, "part"), PART)


ORACLE["s3_describe_source"] = """
WITH n AS (SELECT count(*) AS total_records FROM part)
SELECT v.*, n.total_records FROM n, (VALUES
  (1, 'p_partkey', 'bigint', 'data', true), (2, 'p_name', 'string', 'data', true),
  (3, 'p_brand', 'string', 'data', true), (4, 'p_type', 'string', 'data', false),
  (5, 'p_size', 'int', 'training', true), (6, 'p_retailprice', 'double', 'metadata', false)
) v(ordinal, name, type, role, required)"""


@query
def s4_write_catalog_version(spark, d):
    """Publish part with its vectors, read the version back as stored."""
    root = fresh_folder(spark, "store")
    products = table(spark, d, "part")
    write_catalog_version(products, part_vectors(spark, d), root, "1", key="p_partkey")
    stored, vectors = read_catalog_version(spark, root, "1")
    return stored.join(
        vectors.select(F.col("id").cast("bigint").alias("p_partkey"), F.lit(True).alias("_v")),
        "p_partkey", "left",
    ).select(*products.columns, F.coalesce("_v", F.lit(False)).alias("has_vector"))


ORACLE["s4_write_catalog_version"] = """
SELECT p.*, e.vec_id IS NOT NULL AS has_vector
FROM part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey"""


def published_part(spark, d):
    """Part and its vectors, with their filter columns, stored by row key."""
    root = fresh_folder(spark, "store")
    part = table(spark, d, "part").withColumn("row_key", text_col("p_partkey"))
    carried = part.select(
        F.col("row_key").alias("id"), F.col("p_brand").alias("category"),
        F.col("p_retailprice").alias("price"),
    )
    vectors = part_vectors(spark, d).join(carried, "id", "left")
    write_catalog_version(part, vectors, root, "1", key="row_key", buckets=4)
    return open_version(spark, root, "1")


@query
def s4_append_and_search(spark, d):
    """Two catalogue files become a version and an appended one, which is searched."""
    work = fresh_folder(spark, "build")
    export_catalog_csv(previous_part(spark, d), f"{work}/old")
    export_catalog_csv(new_part(spark, d), f"{work}/new")
    build_version(spark, f"{work}/old", f"{work}/store", "1", PART_FILTERS)
    build_version(spark, f"{work}/new", f"{work}/store", "2", PART_FILTERS, "append", "1")
    version = open_version(spark, f"{work}/store", "2")
    asked = table(spark, d, "part").select(
        text_col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand").alias("q")
    )
    requests = hash_embed(asked, "q").select("query_id", "embedding")
    # Equal scores are ordered by row keys, which SQL cannot know: ranks and scores only.
    return version.search(requests, PART_FILTERS, k=3).select("query_id", "rank", "score")


SQL_PART_TEXT = sql_hash_vectors(
    "pv", "part", "cast(p_partkey AS varchar)", "concat_ws(' ', p_name, p_type, p_brand)"
)
SQL_PART_ASKED = sql_hash_vectors(
    "pq", "part", "cast(p_partkey AS varchar)", "concat_ws(' ', p_name, p_brand)"
)
ORACLE["s4_append_and_search"] = f"""
WITH {SQL_PART_TEXT}, {SQL_PART_ASKED},
scores AS (
  SELECT q.k AS query_id, p.k AS id, round(sum(q.v * p.v), 6) + 0.0 AS score
  FROM pq q JOIN pv p ON q.bucket = p.bucket GROUP BY q.k, p.k),
ranks AS (
  SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank
  FROM scores)
SELECT query_id, rank, score FROM ranks WHERE rank <= 3 AND NOT (score < 0.2)"""


@query
def s5_read_vectors(spark, d):
    """Every component of every stored vector."""
    root = fresh_folder(spark, "store")
    vectors = part_vectors(spark, d)
    publish_vectors(vectors, vectors, root, "1")
    return read_vectors(spark, f"{root}/vectors/version=1").select(
        "id", F.posexplode("embedding").alias("pos", "v")
    ).select("id", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))


ORACLE["s5_read_vectors"] = """
SELECT id, cast(pos - 1 AS integer) AS pos, round(v, 6) AS v FROM (
  SELECT cast(vec_id AS varchar) AS id, generate_subscripts(embedding, 1) AS pos,
         unnest(embedding)::DOUBLE AS v FROM embeddings)"""


@query
def s6_artifact_manifest(spark, d):
    ids = table(spark, d, "part").select(text_col("p_partkey").alias("id"))
    made = artifact_manifest(ids, part_vectors(spark, d), {"name": "part"})
    return made.select(
        "num_samples",
        F.col("embedding_shape")[0].alias("num_vectors"),
        F.col("embedding_shape")[1].alias("dim"),
        "vectors_without_row", "rows_without_vector", "is_complete", "config",
    )


ORACLE["s6_artifact_manifest"] = """
SELECT (SELECT count(*) FROM part) AS num_samples, count(*) AS num_vectors,
       max(len(embedding)) AS dim,
       count(*) FILTER (vec_id NOT IN (SELECT p_partkey FROM part)) AS vectors_without_row,
       (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings))
         AS rows_without_vector,
       count(*) = (SELECT count(*) FROM part)
         AND bool_and(vec_id IN (SELECT p_partkey FROM part)) AS is_complete,
       '{"name": "part"}' AS config
FROM embeddings"""


@query
def s8_parse_json_records(spark, d):
    return parse_jobs(job_queue(spark, d), "message", keep=["event_id"])[0]


ORACLE["s8_parse_json_records"] = f"WITH {SQL_JOBS} SELECT * FROM jobs"


@query
def s8_malformed_records(spark, d):
    return parse_jobs(job_queue(spark, d), "message", keep=["event_id"])[1]


ORACLE["s8_malformed_records"] = """
SELECT event_id, '{"co' AS raw FROM events WHERE event_id % 7 = 0"""


@query
def s8_parse_requests(spark, d):
    """Every user turn as a JSON search request; the turn number is its cut."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    body = F.struct(
        F.col("text").alias("query"), F.col("conv_id").cast("string").alias("config_id"),
        F.col("turn").cast("int").alias("max_items"),
        F.struct(F.col("role").alias("category")).alias("filters"),
    )
    sent = turns.select("conv_id", "turn", F.to_json(body).alias("message"))
    return parse_requests(sent, keep=["conv_id", "turn"])[0].drop("model_path", "page")


ORACLE["s8_parse_requests"] = """
SELECT conv_id, turn, text AS query, cast(conv_id AS varchar) AS config_id,
       cast(CASE WHEN turn = 0 THEN 10 ELSE turn END AS integer) AS max_items,
       '{"category":"user"}' AS filters
FROM conversations WHERE role = 'user'"""


@query
def s8_job_message_round_trip(spark, d):
    """Config to job message and back gives the same job."""
    jobs = configs(spark, d).withColumn("timestamp", F.col("created_at").cast("string"))
    back = job_messages(jobs).select(F.from_json("message", JOB_SCHEMA).alias("j"))
    return back.select("j.config_id", "j.config.*")


ORACLE["s8_job_message_round_trip"] = (
    f"WITH {SQL_CONFIGS} SELECT config_id, name, model_path, mode FROM configs"
)


# --- P: mapping and validation ------------------------------------------------

@query
def p1_apply_schema_mapping(spark, d):
    return apply_schema_mapping(table(spark, d, "part"), PART)


ORACLE["p1_apply_schema_mapping"] = """
SELECT cast(p_partkey AS varchar) AS id, p_name AS name, p_type AS description,
       p_brand AS category, cast(p_size AS varchar) AS size,
       cast(p_retailprice AS varchar) AS price
FROM part"""


@query
def p2_metadata_map(spark, d):
    made = metadata_map(resolve_catalog("append", previous_part(spark, d), new_part(spark, d)),
                        PART_FILTERS)
    return made.select("id", F.explode("metadata").alias("key", "value"))


ORACLE["p2_metadata_map"] = """
SELECT cast(p_partkey AS varchar) AS id, 'price' AS key, cast(p_retailprice AS varchar) AS value
FROM part"""


@query
def p3_check_required_columns(spark, d):
    """The price and the colour are asked for; part has no colour."""
    return check_required_columns(
        patchy_part(spark, d),
        type(PART)(**{**PART.to_dict(), "custom_columns": (),
                      "required_columns": ("p_partkey", "p_retailprice", "p_color")}),
    )


ORACLE["p3_check_required_columns"] = f"""
WITH {SQL_PATCHY}
SELECT 'p_name' AS column_name, true AS is_present, count(p_name) AS rows_filled FROM patchy
UNION ALL SELECT 'p_type', true, count(p_type) FROM patchy
UNION ALL SELECT 'p_brand', true, count(p_brand) FROM patchy
UNION ALL SELECT 'p_partkey', true, count(p_partkey) FROM patchy
UNION ALL SELECT 'p_retailprice', true, count(p_retailprice) FROM patchy
UNION ALL SELECT 'p_color', false, 0"""


@query
def p4_validate_rows(spark, d):
    ok, _ = validate_rows(patchy_part(spark, d), PART)
    return ok


ORACLE["p4_validate_rows"] = f"""
WITH {SQL_PATCHY} SELECT * FROM patchy WHERE p_partkey IS NOT NULL AND trim(p_name) <> ''"""


@query
def p4_rejected_rows(spark, d):
    marked = with_reject_reasons(patchy_part(spark, d), PART)
    return marked.where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ", "))


ORACLE["p4_rejected_rows"] = f"""
WITH {SQL_PATCHY}
SELECT *, concat_ws(', ', CASE WHEN p_partkey IS NULL THEN 'blank id' END,
                    CASE WHEN trim(p_name) = '' THEN 'blank name' END) AS reasons
FROM patchy WHERE p_partkey IS NULL OR trim(p_name) = ''"""


@query
def p4_rejection_counts(spark, d):
    return rejection_counts(validate_rows(patchy_part(spark, d), PART)[1])


ORACLE["p4_rejection_counts"] = f"""
WITH {SQL_PATCHY}
SELECT 'blank id' AS reason, count(*) AS n_rows FROM patchy WHERE p_partkey IS NULL
UNION ALL SELECT 'blank name', count(*) FROM patchy WHERE trim(p_name) = ''"""


def config_requests(spark, d):
    """One config request per event; the event type decides what is wrong with it."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        F.when(kind != "error", F.concat(F.lit("cfg-"), F.col("user_id").cast("string"))).alias("name"),
        F.when(kind == "view", "").otherwise("csv").alias("data_source_type"),
        F.when(F.col("event_id") % 5 == 0, "merge")
        .when(F.col("event_id") % 5 == 1, "append").otherwise("replace").alias("mode"),
        F.when(kind == "click", F.col("user_id").cast("string")).alias("previous_version"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise("p_name").alias("name_column"),
        F.when(F.col("event_id") % 13 != 0, "p_partkey").alias("id_column"),
        (F.col("event_id") % 4 * 32).cast("int").alias("batch_size"),
        F.when(F.col("event_id") % 3 == 0, 256).alias("max_tokens"),
        (F.col("event_id") % 2 * 0.1).alias("validation_split"),
    )


@query
def p5_validate_configs(spark, d):
    return validate_configs(config_requests(spark, d)).select("event_id", "error")


ORACLE["p5_validate_configs"] = """
SELECT event_id, CASE
  WHEN event_type = 'error' THEN 'name is required'
  WHEN event_type = 'view' THEN 'data_source.type is required'
  WHEN event_id % 5 = 0 THEN 'mode must be either ''replace'' or ''append'''
  WHEN event_id % 5 = 1 AND event_type <> 'click'
    THEN 'previous_version is required for append mode'
  WHEN event_id % 11 = 0 THEN 'schema_mapping.name_column is required'
  WHEN event_id % 13 = 0 THEN 'schema_mapping.id_column is required'
  END AS error
FROM events"""


def whole_configs(spark, d):
    """A whole config record per event, as JSON; every seventh is cut off."""
    event = F.col("event_id")

    def custom(user, standard, role):
        return F.struct(F.lit(user).alias("user_column"), F.lit(standard).alias("standard_column"),
                        role.alias("role"), F.lit(False).alias("required"))

    columns = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit("string").alias("type"), F.lit("data").alias("role"),
                 F.lit(n == "p_partkey").alias("required"))
        for n in ("p_partkey", "p_name", "p_size")])
    role = F.when(event % 17 == 0, F.lit("other")).otherwise("metadata")
    record = F.struct(
        F.when(F.col("event_type") != "error", F.concat(F.lit("cfg-"), event)).alias("name"),
        F.struct(F.lit("csv").alias("type"), columns.alias("columns"),
                 event.alias("total_records")).alias("data_source"),
        F.struct(F.lit("p_partkey").alias("id_column"),
                 F.when(event % 11 != 0, "p_name").alias("name_column"),
                 F.array(custom("p_size", "size", role),
                         custom("p_name", "title", F.lit("training"))).alias("custom_columns"),
                 F.array(F.lit("p_partkey")).alias("required_columns")).alias("schema_mapping"),
        F.struct((event % 4 * 32).cast("int").alias("batch_size"),
                 F.create_map(F.lit("lr"), F.concat(F.lit("0."), event)).alias("training_params"),
                 ).alias("training_config"),
        F.when(event % 5 == 1, "append").otherwise("replace").alias("mode"),
        F.when(event % 5 == 1, F.col("user_id").cast("string")).alias("previous_version"),
    )
    sent = table(spark, d, "events").select(
        "event_id", "ts", F.to_json(record).alias("record"))
    cut = F.when(event % 7 == 0, F.substring("record", 1, 9)).otherwise(F.col("record"))
    return sent.withColumn("record", cut)


@query
def s8_config_round_trip(spark, d):
    """JSON to nested records, to queue messages, and back to the same records."""
    good, _ = parse_configs(whole_configs(spark, d), keep=["event_id"])
    keyed = good.withColumn("_id", F.concat(F.lit("id-"), F.col("event_id").cast("string")))
    sent = config_jobs(keyed, F.lit("now"), keep=["event_id"])
    back, _ = parse_config_jobs(sent, keep=["event_id"])
    mapping, training = F.col("config.schema_mapping"), F.col("config.training_config")
    return back.select(
        "event_id", "config_id", "timestamp", F.col("config.name").alias("name"),
        F.array_join(F.col("config.data_source.columns.name"), ",").alias("columns"),
        F.col("config.data_source.total_records").alias("total_records"),
        mapping["name_column"].alias("name_column"),
        F.array_join(mapping["custom_columns"]["role"], ",").alias("roles"),
        F.array_join(mapping["required_columns"], ",").alias("required_columns"),
        training["batch_size"].alias("batch_size"),
        training["training_params"]["lr"].alias("lr"),
        F.col("config.mode").alias("mode"),
        F.col("config.previous_version").alias("previous_version"),
    )


ORACLE["s8_config_round_trip"] = """
SELECT event_id, 'id-' || event_id AS config_id, 'now' AS "timestamp",
  CASE WHEN event_type <> 'error' THEN 'cfg-' || event_id END AS name,
  'p_partkey,p_name,p_size' AS columns, event_id AS total_records,
  CASE WHEN event_id % 11 <> 0 THEN 'p_name' END AS name_column,
  CASE WHEN event_id % 17 = 0 THEN 'other' ELSE 'metadata' END || ',training' AS roles,
  'p_partkey' AS required_columns, cast(event_id % 4 * 32 AS integer) AS batch_size,
  '0.' || event_id AS lr, CASE WHEN event_id % 5 = 1 THEN 'append' ELSE 'replace' END AS mode,
  CASE WHEN event_id % 5 = 1 THEN cast(user_id AS varchar) END AS previous_version
FROM events WHERE event_id % 7 <> 0"""


def created_configs(spark, d):
    good, _ = parse_configs(whole_configs(spark, d), keep=["event_id", "ts"])
    key = F.concat(F.lit("id-"), F.col("event_id").cast("string"))
    return new_configs(good, configs(spark, d), F.col("ts"), key, F.lit("a.csv"), strict=True)


@query
def p5_new_config(spark, d):
    """Complete new records: the fields that creation fills in."""
    good, _ = created_configs(spark, d)
    training, stats = F.col("training_config"), F.col("training_stats")
    return good.select(
        "_id", "name", "model_path", F.col("data_source.location").alias("location"), "status",
        "mode", "version", "created_at", stats["start_time"].alias("start_time"),
        stats["progress"].alias("progress"), training["batch_size"].alias("batch_size"),
        training["max_tokens"].alias("max_tokens"),
        training["validation_split"].alias("validation_split"),
        F.size("schema_mapping.custom_columns").alias("n_custom"),
    )


SQL_CREATED = f"""{SQL_CONFIGS},
judged AS (
  SELECT event_id, 'id-' || event_id AS _id, 'cfg-' || event_id AS name, event_type, user_id, ts,
    CASE WHEN event_id % 5 = 1 THEN 'append' ELSE 'replace' END AS mode,
    CASE WHEN event_type = 'error' THEN 'name is required'
      WHEN event_id % 11 = 0 THEN 'schema_mapping.name_column is required'
      WHEN event_id % 17 = 0
        THEN 'schema_mapping.custom_columns roles are training, metadata, filter'
      WHEN event_id % 5 = 1 AND cast(user_id AS varchar) NOT IN
        (SELECT config_id FROM configs WHERE status = 'completed')
        THEN 'previous version not found or not completed' END AS error
  FROM events WHERE event_id % 7 <> 0)"""
ORACLE["p5_new_config"] = f"""
WITH {SQL_CREATED}
SELECT _id, name, 'models/' || _id AS model_path, 'data/' || _id || '/a.csv' AS location,
  'pending' AS status, mode, strftime(ts, '%Y%m%d%H%M%S') AS version,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start_time, 0.0::DOUBLE AS progress,
  CASE WHEN event_id % 4 = 0 THEN 128 ELSE cast(event_id % 4 * 32 AS integer) END AS batch_size,
  512 AS max_tokens, 0.2::DOUBLE AS validation_split, 2 AS n_custom
FROM judged WHERE error IS NULL"""


@query
def p5_rejected_config(spark, d):
    """Records that creation rejects, with the first rule that they break."""
    return created_configs(spark, d)[1]


ORACLE["p5_rejected_config"] = f"""
WITH {SQL_CREATED}
SELECT _id, CASE WHEN event_type <> 'error' THEN name END AS name, error
FROM judged WHERE error IS NOT NULL"""


@query
def p6_apply_defaults(spark, d):
    return apply_defaults(config_requests(spark, d), CONFIG_DEFAULTS).select(
        "event_id", "batch_size", "max_tokens", "validation_split"
    )


ORACLE["p6_apply_defaults"] = """
SELECT event_id,
       CASE WHEN event_id % 4 = 0 THEN 128 ELSE cast(event_id % 4 * 32 AS integer) END AS batch_size,
       CASE WHEN event_id % 3 = 0 THEN 256 ELSE 512 END AS max_tokens,
       CASE WHEN event_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS validation_split
FROM events"""


@query
def p7_fill_missing_text(spark, d):
    return fill_missing_text(
        resolve_catalog("append", previous_part(spark, d), new_part(spark, d)), ["p_name", "p_size"]
    )


ORACLE["p7_fill_missing_text"] = """
SELECT p_partkey, coalesce(p_name, '') AS p_name, p_brand, p_type,
       CASE WHEN p_partkey % 2 = 1 THEN cast(p_size AS varchar) ELSE '' END AS p_size, p_retailprice
FROM part"""


@query
def p8_preview_projection(spark, d):
    return preview(
        resolve_catalog("append", previous_part(spark, d), new_part(spark, d)), PART, 20
    )


ORACLE["p8_preview_projection"] = """
SELECT cast(p_partkey AS varchar) AS p_partkey, coalesce(nullif(p_name, ''), '-') AS p_name,
       p_type, p_brand,
       CASE WHEN p_partkey % 2 = 1 THEN cast(p_size AS varchar) ELSE '-' END AS p_size,
       cast(p_retailprice AS varchar) AS p_retailprice
FROM part ORDER BY cast(p_partkey AS varchar) LIMIT 20"""


# --- F: filters ---------------------------------------------------------------

@query
def f1_filter_equals(spark, d):
    return apply_filters(table(spark, d, "part"), {"category": "Brand#4"}, PART)


ORACLE["f1_filter_equals"] = "SELECT * FROM part WHERE p_brand = 'Brand#4'"


@query
def f1_filter_number(spark, d):
    """Equality on a number, given as a number of another type."""
    return apply_filters(table(spark, d, "part"), {"size": 7.0}, PART)


ORACLE["f1_filter_number"] = "SELECT * FROM part WHERE p_size = 7"


@query
def f2_filter_range(spark, d):
    return apply_filters(table(spark, d, "part"), {"price_range": [None, 950]}, PART)


ORACLE["f2_filter_range"] = "SELECT * FROM part WHERE p_retailprice BETWEEN 0 AND 950"


@query
def f2_filter_range_text(spark, d):
    """The same range over a CSV catalogue, where prices are text."""
    return apply_filters(as_text(table(spark, d, "part")), {"price": [910, ""]}, PART)


ORACLE["f2_filter_range_text"] = """
SELECT cast(p_partkey AS varchar) AS p_partkey, p_name, p_brand, p_type,
       cast(p_size AS varchar) AS p_size, cast(p_retailprice AS varchar) AS p_retailprice
FROM part WHERE p_retailprice >= 910"""


@query
def f3_filter_all(spark, d):
    wanted = {"category": "Brand#4", "price": [905, 990], "size": [10, 40], "brand": ""}
    return apply_filters(table(spark, d, "part"), wanted, PART)


ORACLE["f3_filter_all"] = """
SELECT * FROM part WHERE p_brand = 'Brand#4' AND p_retailprice BETWEEN 905 AND 990
  AND p_size BETWEEN 10 AND 40"""


# --- V: versions --------------------------------------------------------------

@query
def v1_append_version(spark, d):
    return resolve_catalog("append", previous_part(spark, d), new_part(spark, d))


ORACLE["v1_append_version"] = """
SELECT p_partkey, p_name, p_brand, p_type,
       CASE WHEN p_partkey % 2 = 1 THEN p_size END AS p_size, p_retailprice
FROM part"""


@query
def v1_replace_version(spark, d):
    return resolve_catalog("replace", previous_part(spark, d), table(spark, d, "part"))


ORACLE["v1_replace_version"] = "SELECT * FROM part"


@query
def v1_append_latest_by_id(spark, d):
    """Opt-in de-duplication: the newest event of each user."""
    return latest_by_id(table(spark, d, "events"), "user_id", "ts").select(
        "user_id", "event_id", "event_type", "value"
    )


ORACLE["v1_append_latest_by_id"] = """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"""


@query
def v3_check_previous_version(spark, d):
    asked = bare_configs(spark, d).select("config_id", "mode", "previous_version")
    return check_previous_version(asked, configs(spark, d))


ORACLE["v3_check_previous_version"] = f"""
WITH {SQL_CONFIGS}, done AS (SELECT config_id AS id FROM configs WHERE status = 'completed')
SELECT config_id, mode, previous_version,
       mode = 'replace' OR id IS NOT NULL AS accepted,
       CASE WHEN mode = 'append' AND id IS NULL
            THEN 'previous version not found or not completed' END AS reason
FROM configs LEFT JOIN done ON previous_version = id"""


@query
def v4_version_lineage(spark, d):
    return version_lineage(bare_configs(spark, d))


ORACLE["v4_version_lineage"] = f"""
WITH RECURSIVE {SQL_CONFIGS},
line AS (
  SELECT config_id, config_id AS root, 0::BIGINT AS depth, n_rows::BIGINT AS total_rows
  FROM configs WHERE mode = 'replace'
    OR previous_version NOT IN (SELECT config_id FROM configs)
  UNION ALL
  SELECT c.config_id, l.root, l.depth + 1, l.total_rows + c.n_rows
  FROM configs c JOIN line l ON c.mode = 'append' AND c.previous_version = l.config_id)
SELECT * FROM line"""


@query
def v4_cycles(spark, d):
    """Four versions of each dozen build on each other in a circle, four more on those."""
    user = F.col("config_id").cast("bigint")
    looped = F.when(user % 12 == 1, user + 9).when(user % 3 == 1, user - 3).when(
        user % 3 == 2, user - 1)
    closed = bare_configs(spark, d).withColumns({
        "mode": F.when(user % 3 > 0, "append").otherwise(F.col("mode")),
        "previous_version": F.coalesce(looped.cast("string"), "previous_version"),
    })
    return version_lineage(closed, report_cycles=True)


ORACLE["v4_cycles"] = """
WITH RECURSIVE c AS (
  SELECT user_id AS u, cast(user_id AS varchar) AS config_id, count(*) AS n_rows,
    CASE WHEN user_id % 12 = 1 THEN user_id + 9 WHEN user_id % 3 = 1 THEN user_id - 3
         WHEN user_id % 3 = 2 THEN user_id - 1 WHEN user_id >= 3 THEN user_id - 3 END AS base
  FROM events GROUP BY user_id),
line AS (
  SELECT u, config_id, config_id AS root, 0::BIGINT AS depth, n_rows::BIGINT AS total_rows
  FROM c WHERE base IS NULL OR base NOT IN (SELECT u FROM c)
  UNION ALL
  SELECT c.u, c.config_id, l.root, l.depth + 1, l.total_rows + c.n_rows
  FROM c JOIN line l ON c.base = l.u)
SELECT config_id, root, depth, total_rows, NULL::VARCHAR AS cycle, false AS on_cycle FROM line
UNION ALL
SELECT config_id, NULL, NULL, NULL,
  (SELECT min(m.config_id) FROM c m WHERE m.u % 3 = 1 AND m.u // 12 = c.u // 12), u % 3 = 1
FROM c WHERE u NOT IN (SELECT u FROM line)"""


@query
def v5_append_summary(spark, d):
    """Each completed config gets its user's events as new products."""
    bases = configs(spark, d).where("status = 'completed'").withColumn(
        "schema_mapping", F.concat(F.lit("map-"), F.col("config_id"))
    )
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("config_id"))
    return append_summary(bases, rows)


ORACLE["v5_append_summary"] = f"""
WITH {SQL_CONFIGS}
SELECT 'Append to ' || name AS name, 'Appending ' || n_rows || ' products' AS description,
       'append' AS mode, config_id AS previous_version, 'map-' || config_id AS schema_mapping,
       'csv' AS source_type, 'csv' AS file_type
FROM configs WHERE status = 'completed'"""


@query
def v6_join_vectors(spark, d):
    products = apply_schema_mapping(table(spark, d, "part"), PART)
    return join_vectors(products, part_vectors(spark, d)).select(
        "id", "name", "category", F.size("embedding").cast("bigint").alias("dim"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
    )


@query
def v6_join_published(spark, d):
    """Products and vectors stored by row key: every component of every pair."""
    version = published_part(spark, d)
    products = version.products.select(F.col("row_key").alias("id"), "p_name")
    return (
        join_vectors(products, version.vectors)
        .select("id", "p_name", F.posexplode("embedding").alias("pos", "v"))
        .select("id", "p_name", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))
    )


ORACLE["v6_join_published"] = """
SELECT id, p_name, cast(pos - 1 AS integer) AS pos, round(v, 6) AS v FROM (
  SELECT cast(vec_id AS varchar) AS id, p_name, generate_subscripts(embedding, 1) AS pos,
         unnest(embedding)::DOUBLE AS v FROM part JOIN embeddings ON vec_id = p_partkey)"""


ORACLE["v6_join_vectors"] = """
SELECT cast(p_partkey AS varchar) AS id, p_name AS name, p_brand AS category,
       len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS first_value
FROM part JOIN embeddings ON vec_id = p_partkey"""

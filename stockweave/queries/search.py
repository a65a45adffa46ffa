"""Embedding, scoring, search, routing and vector checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.mapping import text_col
from stockweave.operators.answers import answer_requests
from stockweave.operators.cells import publish_cells, search_cells
from stockweave.operators.embed import (
    HashEncoder,
    embed_column,
    hash_bucket_counts,
    map_prompts,
)
from stockweave.operators.filters import min_score
from stockweave.operators.score import pair_scores, search_vectors, top_k
from stockweave.operators.search import (
    route_requests,
    search,
    search_each,
    search_page,
    search_requests,
    search_summary,
    vector_checks,
)
from stockweave.queries.catalog import published_part
from stockweave.queries.views import (
    DOCS,
    PART,
    SQL_CONFIGS,
    SQL_DOC_VECTORS,
    SQL_LABEL_REQUESTS,
    SQL_PART_RECORDS,
    SQL_TURN_SCORES,
    SQL_TURN_VECTORS,
    configs,
    document_texts,
    document_vectors,
    label_requests,
    part_vectors,
    table,
    turn_requests,
    turn_vectors,
    user_turns,
)
from stockweave.session import fresh_folder
from stockweave.sources.store import open_version, write_catalog_version

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def flat(results):
    """Metadata as text, so that results compare as plain values."""
    lines = F.transform(
        F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return results.withColumn("metadata", F.array_join(lines, ";"))


def nonzero(df, key):
    return (
        df.select(key, F.posexplode("embedding").alias("bucket", "v"))
        .where("v <> 0")
        .select(key, "bucket", F.round(F.col("v").cast("double"), 6).alias("v"))
    )


@query
def e1_embed_column(spark, d):
    """The encoder interface over whole documents; every non-zero component."""
    return nonzero(embed_column(document_texts(spark, d), "text", HashEncoder), "id")


ORACLE["e1_embed_column"] = f"""
WITH {SQL_DOC_VECTORS}
SELECT k AS id, cast(bucket AS integer) AS bucket, round(v, 6) AS v FROM dv"""


@query
def e2_hash_embed(spark, d):
    """The same vectors with hashing inside the JVM, for the request side."""
    return nonzero(turn_vectors(spark, d), "query_id")


ORACLE["e2_hash_embed"] = f"""
WITH {SQL_TURN_VECTORS}
SELECT k AS query_id, cast(bucket AS integer) AS bucket, round(v, 6) AS v FROM qv"""


@query
def e2_hash_bucket_counts(spark, d):
    return hash_bucket_counts(document_texts(spark, d), "id", "text")


ORACLE["e2_hash_bucket_counts"] = f"""
WITH {SQL_DOC_VECTORS} SELECT k AS id, cast(bucket AS integer) AS bucket, n FROM dv"""


@query
def e4_dot_scores(spark, d):
    """Each vector with the requests of its own label and of the next one."""
    vectors, requests = part_vectors(spark, d), label_requests(spark, d)
    labels = F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("label")
    pairs = vectors.select("id", labels).join(requests.select("query_id", "label"), "label")
    return pair_scores(pairs, vectors, requests)


ORACLE["e4_dot_scores"] = f"""
WITH {SQL_LABEL_REQUESTS} SELECT query_id, id, score FROM scores
WHERE request_label IN (vector_label, (vector_label + 1) % 10)"""


def overall_request(spark, d):
    """A single request: the mean of all label means."""
    vector = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return (
        label_requests(spark, d)
        .select(F.posexplode("embedding").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.avg("v").alias("m"))
        .agg(vector.alias("embedding"))
        .select(F.lit("all").alias("query_id"), "embedding")
    )


@query
def e5_top_k(spark, d):
    found = search_vectors(part_vectors(spark, d), overall_request(spark, d), 10, floor=None)
    return top_k(found.drop("rank"), 10)


ORACLE["e5_top_k"] = f"""
WITH {SQL_LABEL_REQUESTS},
whole AS (SELECT list(m ORDER BY pos) AS embedding FROM (
  SELECT pos, avg(m) AS m FROM comp GROUP BY pos))
SELECT 'all' AS query_id, cast(vec_id AS varchar) AS id,
       round(list_inner_product(w.embedding, e.embedding::DOUBLE[]), 6) + 0.0 AS score
FROM whole w, embeddings e
ORDER BY score DESC, id ASC LIMIT 10"""


@query
def e6_top_k_per_query(spark, d):
    return search_vectors(part_vectors(spark, d), label_requests(spark, d), 10, floor=None)


SQL_LABEL_RANKS = f"""{SQL_LABEL_REQUESTS},
ranks AS (SELECT query_id, id, score,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank
          FROM scores)"""
ORACLE["e6_top_k_per_query"] = f"WITH {SQL_LABEL_RANKS} SELECT * FROM ranks WHERE rank <= 10"


@query
def e6_search_cells(spark, d):
    """The same ranks from vectors stored in cells, of which only some are read."""
    root = fresh_folder(spark, "cells")
    publish_cells(part_vectors(spark, d), root, cells=24)
    return search_cells(spark, root, label_requests(spark, d), 10, floor=None).rows


ORACLE["e6_search_cells"] = ORACLE["e6_top_k_per_query"]


@query
def f4_min_score(spark, d):
    """The floor after the cut: fewer than k rows may be left."""
    ranks = search_vectors(part_vectors(spark, d), label_requests(spark, d), 50, floor=None)
    return min_score(ranks, 0.2)


ORACLE["f4_min_score"] = f"""
WITH {SQL_LABEL_RANKS} SELECT * FROM ranks WHERE rank <= 50 AND NOT (score < 0.2)"""


@query
def e6_nearest_neighbours(spark, d):
    """Every stored vector as a request against all of them."""
    vectors = part_vectors(spark, d)
    requests = vectors.select(F.col("id").alias("query_id"), "embedding")
    return search_vectors(vectors, requests, k=10)


ORACLE["e6_nearest_neighbours"] = """
WITH scores AS (
  SELECT cast(q.vec_id AS varchar) AS query_id, cast(e.vec_id AS varchar) AS id,
         round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM embeddings q, embeddings e),
ranks AS (SELECT query_id, id, score,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank
          FROM scores)
SELECT * FROM ranks WHERE rank <= 10 AND NOT (score < 0.2)"""


@query
def e7_search(spark, d):
    return flat(
        search(table(spark, d, "part"), part_vectors(spark, d), label_requests(spark, d), PART)
    )


# Vectors without a catalogue row take no ranks.
SQL_RESULTS = f"""{SQL_LABEL_REQUESTS}, {SQL_PART_RECORDS},
ranks AS (SELECT query_id, request_label, id, score,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank
          FROM scores WHERE id IN (SELECT id FROM records))"""
ORACLE["e7_search"] = f"""
WITH {SQL_RESULTS}
SELECT query_id, rank, r.id, name, description, category, score, metadata
FROM ranks r JOIN records USING (id) WHERE rank <= 10 AND NOT (score < 0.2)"""


@query
def e7_search_text(spark, d):
    """Every user turn as a text query against all documents."""
    found = search(
        table(spark, d, "documents"), document_vectors(spark, d), turn_vectors(spark, d), DOCS, k=10
    )
    return flat(found).select("query_id", "rank", "id", "name", "category", "score", "metadata")


ORACLE["e7_search_text"] = f"""
WITH {SQL_TURN_SCORES}
SELECT query_id, rank, r.id, source AS name, lang AS category, score,
       'length=' || cast(n_chars AS varchar) AS metadata
FROM ranks r JOIN documents ON cast(doc_id AS varchar) = r.id
WHERE rank <= 10 AND NOT (score < 0.2)"""


@query
def e7_search_text_grid(spark, d):
    """The same search by blocks of both sides, as for very many requests."""
    found = search(
        table(spark, d, "documents"), document_vectors(spark, d), turn_vectors(spark, d), DOCS,
        k=10, broadcast_bytes=0, block_bytes=128 * 2048,
    )
    return flat(found).select("query_id", "rank", "id", "name", "category", "score", "metadata")


ORACLE["e7_search_text_grid"] = ORACLE["e7_search_text"]


@query
def e8_search_filtered(spark, d):
    """Category and price filters, applied before ranking."""
    wanted = {"category": "Brand#4", "price_range": [900, 980]}
    return flat(
        search(table(spark, d, "part"), part_vectors(spark, d), label_requests(spark, d), PART,
               k=3, floor=-1.0, filters=wanted)
    )


ORACLE["e8_search_filtered"] = f"""
WITH {SQL_LABEL_REQUESTS}, {SQL_PART_RECORDS},
ranks AS (SELECT query_id, r.id, name, description, category, score, metadata,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r.id ASC) AS rank
          FROM scores s JOIN records r ON r.id = s.id
          WHERE category = 'Brand#4' AND p_retailprice BETWEEN 900 AND 980)
SELECT * FROM ranks WHERE rank <= 3"""


@query
def e8_filtered_vector_table(spark, d):
    """The filter columns travel with the vectors, so no ids are joined."""
    part = table(spark, d, "part")
    carried = part_vectors(spark, d).join(
        part.select(text_col("p_partkey").alias("id"), F.col("p_brand").alias("category"),
                    F.col("p_retailprice").alias("price")), "id")
    return flat(
        search(part, carried, label_requests(spark, d), PART, k=3, floor=-1.0,
               filters={"category": "Brand#4", "price": [900, 980]})
    )


ORACLE["e8_filtered_vector_table"] = ORACLE["e8_search_filtered"]


@query
def e8_search_each(spark, d):
    """Every request brings its own filters: brand by label, price by label."""
    label = F.col("label").cast("string")
    filters = (
        F.when(F.col("label") % 3 == 0, F.format_string('{"category": "Brand#%s"}', label))
        .when(F.col("label") % 3 == 1, F.format_string('{"price": [90%s, 99%s]}', label, label))
    )
    asked = label_requests(spark, d).withColumn("filters", filters)
    return flat(
        search_each(table(spark, d, "part"), part_vectors(spark, d), asked, PART, k=5, floor=-1.0)
    )


ORACLE["e8_search_each"] = f"""
WITH {SQL_LABEL_REQUESTS}, {SQL_PART_RECORDS},
ranks AS (SELECT query_id, r.id, name, description, category, score, metadata,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r.id ASC) AS rank
          FROM scores s JOIN records r ON r.id = s.id
          WHERE CASE request_label % 3 WHEN 0 THEN category = 'Brand#' || request_label
                  WHEN 1 THEN p_retailprice BETWEEN 900 + request_label AND 990 + request_label
                  ELSE true END)
SELECT * FROM ranks WHERE rank <= 5"""


@query
def e8_search_max_items(spark, d):
    """The label is also the number of rows a request wants; none means ten."""
    asked = label_requests(spark, d).withColumn("max_items", F.col("label"))
    return flat(search_each(table(spark, d, "part"), part_vectors(spark, d), asked, PART))


ORACLE["e8_search_max_items"] = f"""
WITH {SQL_RESULTS}
SELECT query_id, rank, r.id, name, description, category, score, metadata
FROM ranks r JOIN records USING (id)
WHERE NOT (score < 0.2)
  AND rank <= CASE WHEN request_label >= 1 THEN request_label ELSE 10 END"""


@query
def e7_search_published(spark, d):
    """The search over a published version: vectors are settled and stay in place."""
    return flat(published_part(spark, d).search(label_requests(spark, d), PART))


ORACLE["e7_search_published"] = ORACLE["e7_search"]


@query
def e8_search_request(spark, d):
    """Three pages for each label, with filters, cut and model of their own."""
    version, label = published_part(spark, d), F.col("label")
    text = label.cast("string")
    filters = (
        F.when(label % 3 == 0, F.format_string('{"category": "Brand#%s"}', text))
        .when(label % 3 == 1, F.format_string('{"price": [90%s, 99%s], "category": ""}', text, text))
    )

    def model(n):
        return F.concat(F.lit("models/"), (n % 2).cast("string"))

    asked = label_requests(spark, d).withColumns(
        {"filters": filters, "max_items": 3 + label % 4, "model_path": model(label)}
    ).withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(3))))
    asked = asked.withColumn("query_id", F.concat_ws("/", "query_id", F.col("page").cast("string")))
    return flat(
        search_requests(
            version.products, version.vectors.withColumn("model_path", model(label)), asked, PART,
            floor=-1.0, row_key=version.row_key, group="model_path",
        )
    )


ORACLE["e8_search_request"] = f"""
WITH {SQL_LABEL_REQUESTS}, {SQL_PART_RECORDS},
seen AS (SELECT query_id, request_label, r.id, name, description, category, score, metadata,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r.id ASC) AS rank,
           count(*) OVER (PARTITION BY query_id) AS total
         FROM scores s JOIN records r ON r.id = s.id
         WHERE request_label % 2 = vector_label % 2
           AND CASE request_label % 3 WHEN 0 THEN category = 'Brand#' || request_label
             WHEN 1 THEN p_retailprice BETWEEN 900 + request_label AND 990 + request_label
             ELSE true END),
pages AS (SELECT *, 3 + request_label % 4 AS size FROM seen, range(1, 4) t(page))
SELECT query_id || '/' || page AS query_id, page, total,
  cast(ceil(total / size) AS bigint) AS total_pages, rank, id, name, description, category,
  score, metadata
FROM pages WHERE rank > (page - 1) * size AND rank <= page * size"""


@query
def e9_search_paged(spark, d):
    return flat(
        search_page(table(spark, d, "part"), part_vectors(spark, d), label_requests(spark, d),
                    PART, page=2, size=7)
    )


ORACLE["e9_search_paged"] = f"""
WITH {SQL_RESULTS},
kept AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM ranks
         WHERE NOT (score < 0.2))
SELECT query_id, 2 AS page, total, cast(ceil(total / 7) AS bigint) AS total_pages, rank, k.id,
       name, description, category, score, metadata
FROM kept k JOIN records USING (id) WHERE rank BETWEEN 8 AND 14"""


def text_results(spark, d, floor=0.2):
    return search_vectors(document_vectors(spark, d), turn_vectors(spark, d), k=10, floor=floor)


@query
def e10_search_summary(spark, d):
    """A high floor, so that some requests find nothing."""
    asked = turn_requests(spark, d).withColumn("model_path", F.lit("models/documents"))
    return search_summary(asked, text_results(spark, d, 0.8))


ORACLE["e10_search_summary"] = f"""
WITH {SQL_TURN_SCORES},
n AS (SELECT query_id, count(*) AS n FROM ranks WHERE rank <= 10 AND NOT (score < 0.8)
      GROUP BY query_id)
SELECT q.query_id, q.original, 'models/documents' AS model_path, coalesce(n, 0) AS total,
       CASE WHEN n IS NULL THEN 'No matching products found.' END AS natural_response
FROM (SELECT cast(conv_id AS varchar) || '|' || cast(turn AS varchar) AS query_id,
             text AS original FROM conversations WHERE role = 'user') q
LEFT JOIN n USING (query_id)"""


def failing_encoder():
    """Hashed words; texts of certain lengths cannot be encoded."""
    encode = HashEncoder()

    def run(texts):
        if any(len(t) % 13 == 0 for t in texts):
            raise ValueError("cannot encode")
        return encode(texts)

    return run


def repeat_length(prompts):
    """The prompt and its length, as a model that repeats its prompt; fails on some."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise ValueError("cannot answer")
    return [f"{p}{len(p)} characters" for p in prompts]


@query
def e10_search_answer(spark, d):
    """Every user turn answered from whole documents; encoder and generator may fail."""
    root = fresh_folder(spark, "store")
    write_catalog_version(
        table(spark, d, "documents").withColumn("row_key", text_col("doc_id")),
        document_vectors(spark, d), root, "1", key="row_key",
    )
    asked = turn_requests(spark, d).withColumn("model_path", F.lit("models/1"))

    def embed(df, column):
        return embed_column(df, column, failing_encoder, keep_going=True)

    version = open_version(spark, root, "1")
    return answer_requests(version, asked, DOCS, embed, repeat_length, floor=0.6)[1]


ORACLE["e10_search_answer"] = f"""
WITH {SQL_TURN_SCORES},
found AS (
  SELECT query_id, rank, rank || '. ' || source || chr(10) || '   Description: '
    || coalesce(text, '') || chr(10) || '   Category: ' || lang || chr(10) || '   length: '
    || n_chars || chr(10) || chr(10) AS block
  FROM ranks r JOIN documents ON cast(doc_id AS varchar) = r.id
  WHERE rank <= 10 AND NOT (score < 0.6)),
context AS (
  SELECT query_id, count(*) AS n, string_agg(block, '' ORDER BY rank) FILTER (rank <= 3) AS blocks
  FROM found GROUP BY query_id),
asked AS (
  SELECT cast(conv_id AS varchar) || '|' || cast(turn AS varchar) AS query_id, text AS original
  FROM conversations WHERE role = 'user'),
prompts AS (
  SELECT query_id, original, n, length(original) % 13 = 0 AS lost,
    length('Query: ' || original || chr(10) || 'Context: Available products:' || chr(10)
      || chr(10) || blocks || chr(10) || 'Response: ') AS size
  FROM asked LEFT JOIN context USING (query_id))
SELECT query_id, original, 'models/1' AS model_path,
  CASE WHEN lost THEN 0 ELSE coalesce(n, 0) END AS total,
  CASE WHEN lost THEN NULL WHEN n IS NULL THEN 'No matching products found.'
    WHEN size % 7 = 0 THEN 'I apologize, but I couldn''t process your query.'
    ELSE size || ' characters' END AS natural_response,
  CASE WHEN lost THEN 'query could not be encoded'
    WHEN n IS NOT NULL AND size % 7 = 0 THEN 'cannot answer' END AS error
FROM prompts"""


def routed(spark, d):
    """User turns: some name a model, some a config, some neither, some no text."""
    conv = F.col("conv_id")
    asked = user_turns(spark, d).select(
        F.concat_ws("|", "conv_id", "turn").alias("query_id"),
        F.when(conv % 11 != 0, F.col("text")).otherwise("").alias("query"),
        F.when(conv % 3 == 1, conv.cast("string")).alias("config_id"),
        F.when(conv % 3 == 2, F.concat(F.lit("own/"), conv.cast("string"))).alias("model_path"),
    )
    return route_requests(asked, configs(spark, d))


@query
def e11_route_to_model(spark, d):
    return routed(spark, d).drop("query")


ORACLE["e11_route_to_model"] = f"""
WITH {SQL_CONFIGS},
newest AS (SELECT model_path FROM configs WHERE status = 'completed'
           ORDER BY created_at DESC, config_id DESC LIMIT 1),
asked AS (SELECT *, conv_id || '|' || turn AS query_id FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN conv_id % 3 = 1 THEN cast(conv_id AS varchar) END AS config_id,
  CASE WHEN conv_id % 11 <> 0 THEN coalesce(
    CASE WHEN conv_id % 3 = 2 THEN 'own/' || conv_id END,
    CASE WHEN conv_id % 3 = 1 THEN c.model_path END,
    (SELECT model_path FROM newest)) END AS model_path,
  CASE WHEN conv_id % 11 = 0 THEN 'query is required' END AS error
FROM asked a LEFT JOIN configs c ON c.config_id = cast(a.conv_id AS varchar)"""


@query
def e11_search_routed(spark, d):
    """Each label is a model of its own; a request only sees its model's vectors."""
    def model(df):
        return df.withColumn(
            "model_path", F.concat(F.lit("models/"), F.col("label").cast("string"))
        )

    return search_vectors(
        model(part_vectors(spark, d)), model(label_requests(spark, d)), k=5, group="model_path"
    )


ORACLE["e11_search_routed"] = f"""
WITH {SQL_LABEL_REQUESTS},
ranks AS (SELECT query_id, id, score,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank
          FROM scores WHERE request_label = vector_label)
SELECT * FROM ranks WHERE rank <= 5 AND NOT (score < 0.2)"""


@query
def e12_vector_checks(spark, d):
    ids = table(spark, d, "part").select(text_col("p_partkey").alias("id"))
    return vector_checks(part_vectors(spark, d), ids)


ORACLE["e12_vector_checks"] = """
WITH n AS (SELECT vec_id, len(embedding) AS dim,
             sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
           FROM embeddings)
SELECT count(*) AS n_vectors, cast(min(dim) AS integer) AS min_dim,
       cast(max(dim) AS integer) AS max_dim,
       count(*) FILTER (isnan(norm) OR isinf(norm)) AS n_bad_values,
       round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm,
       cast(count(*) FILTER (vec_id NOT IN (SELECT p_partkey FROM part)) AS bigint)
         AS vectors_without_row,
       cast((SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings))
         AS bigint) AS rows_without_vector
FROM n"""


@query
def e13_map_prompts(spark, d):
    """A generator that fails on short prompts; the others are not affected."""

    def generate(prompts):
        if any(len(p) < 100 for p in prompts):
            raise ValueError("prompt too short")
        return [f"{len(p)} characters" for p in prompts]

    turns = user_turns(spark, d).select("conv_id", "turn", "text")
    return map_prompts(turns, "text", generate).drop("text")


ORACLE["e13_map_prompts"] = """
SELECT conv_id, turn,
  CASE WHEN length(text) < 100 THEN 'I apologize, but I couldn''t process your query.'
       ELSE length(text) || ' characters' END AS generated,
  CASE WHEN length(text) < 100 THEN 'prompt too short' END AS error
FROM conversations WHERE role = 'user'"""

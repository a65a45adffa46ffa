"""Text and training-row operators, tokens, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators.search import search
from stockweave.operators.textprep import (
    embedding_text,
    extract_response,
    format_prompt,
    product_context,
    result_card,
    result_context,
    training_pairs,
    training_samples,
)
from stockweave.operators.tokens import (
    fit_tokens,
    hash_split,
    token_stats,
    training_budget,
)
from stockweave.operators.versions import resolve_catalog
from stockweave.queries.views import (
    DOCS,
    PART,
    SQL_LABEL_REQUESTS,
    SQL_PART_RECORDS,
    SQL_TOKEN,
    label_requests,
    new_part,
    part_vectors,
    previous_part,
    table,
)
from stockweave.session import spread

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def appended_part(spark, d):
    """Both versions of part; the older rows have no size."""
    return resolve_catalog("append", previous_part(spark, d), new_part(spark, d))


SQL_APPENDED = """appended AS (
  SELECT cast(p_partkey AS varchar) AS id, coalesce(p_name, '') AS name,
         coalesce(p_type, '') AS description, coalesce(p_brand, '') AS category,
         CASE WHEN p_partkey % 2 = 1 THEN cast(p_size AS varchar) ELSE '' END AS size,
         cast(p_retailprice AS varchar) AS price
  FROM part)"""


@query
def t1_embedding_text(spark, d):
    return embedding_text(appended_part(spark, d), PART)


ORACLE["t1_embedding_text"] = f"""
WITH {SQL_APPENDED}
SELECT id, concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(category, ''),
                     nullif(size, '')) AS text
FROM appended"""


@query
def t2_product_context(spark, d):
    return product_context(appended_part(spark, d), PART)


SQL_CONTEXT = """concat_ws(chr(10), 'Product: ' || name,
  CASE WHEN description <> '' THEN 'Description: ' || description END,
  'Category: ' || category,
  CASE WHEN size <> '' THEN 'Size: ' || size END,
  CASE WHEN price <> '' THEN 'Price: ' || price END)"""
ORACLE["t2_product_context"] = f"""
WITH {SQL_APPENDED} SELECT id, {SQL_CONTEXT} AS context FROM appended"""


@query
def t4_training_pairs(spark, d):
    return training_pairs(appended_part(spark, d), PART)


SQL_PAIRS = """pairs AS (
  SELECT id, 1 AS pair_no, 'Do you have ' || name || '?' AS query,
         'Yes, we have ' || name || '. ' || description AS response FROM appended
  UNION ALL SELECT id, 2, 'Tell me about ' || name,
         name || ' is ' || description || '. It belongs to the ' || category || ' category.'
  FROM appended
  UNION ALL SELECT id, 3, 'What products do you have in ' || category || '?',
         'In ' || category || ', we have ' || name || '. ' || description FROM appended
  UNION ALL SELECT id, 4, 'What is the size of ' || name || '?',
         'The size of ' || name || ' is ' || size || '.' FROM appended WHERE size <> ''
  UNION ALL SELECT id, 5, 'What is the price of ' || name || '?',
         'The price of ' || name || ' is ' || price || '.' FROM appended WHERE price <> '')"""
ORACLE["t4_training_pairs"] = f"WITH {SQL_APPENDED}, {SQL_PAIRS} SELECT * FROM pairs"


@query
def t5_training_samples(spark, d):
    return training_samples(appended_part(spark, d), PART)


SQL_SAMPLES = f"""{SQL_APPENDED}, {SQL_PAIRS},
samples AS (
  SELECT p.id, p.pair_no, p.query, {SQL_CONTEXT} AS context, p.response
  FROM pairs p JOIN appended a ON a.id = p.id)"""
ORACLE["t5_training_samples"] = f"WITH {SQL_SAMPLES} SELECT * FROM samples"


@query
def t5_samples_with_missing_text(spark, d):
    """The variant that writes a missing cell as the text ``nan``."""
    return training_samples(appended_part(spark, d), PART, null_text="nan")


ORACLE["t5_samples_with_missing_text"] = f"""
WITH {SQL_SAMPLES.replace("ELSE '' END AS size", "ELSE 'nan' END AS size")}
SELECT * FROM samples"""


@query
def t5_document_samples(spark, d):
    """Long descriptions: samples of the document catalogue, by digest."""
    made = training_samples(table(spark, d, "documents"), DOCS)
    return made.select("id", "pair_no", "query", F.md5("context").alias("context_md5"),
                       F.md5("response").alias("response_md5"))


ORACLE["t5_document_samples"] = """
WITH a AS (SELECT cast(doc_id AS varchar) AS id, source AS name, text AS description,
                  lang AS category, cast(n_chars AS varchar) AS len FROM documents),
c AS (SELECT *, concat_ws(chr(10), 'Product: ' || name,
        CASE WHEN description <> '' THEN 'Description: ' || description END,
        'Category: ' || category, 'Length: ' || len) AS context FROM a),
p AS (
  SELECT id, 1 AS pair_no, 'Do you have ' || name || '?' AS query, context,
         'Yes, we have ' || name || '. ' || description AS response FROM c
  UNION ALL SELECT id, 2, 'Tell me about ' || name, context,
         name || ' is ' || description || '. It belongs to the ' || category || ' category.' FROM c
  UNION ALL SELECT id, 3, 'What products do you have in ' || category || '?', context,
         'In ' || category || ', we have ' || name || '. ' || description FROM c
  UNION ALL SELECT id, 4, 'What is the length of ' || name || '?', context,
         'The length of ' || name || ' is ' || len || '.' FROM c)
SELECT id, pair_no, query, md5(context) AS context_md5, md5(response) AS response_md5 FROM p"""


@query
def t6_format_prompt(spark, d):
    full = format_prompt(training_samples(appended_part(spark, d), PART))
    return format_prompt(full, with_response=False, out="open_prompt").select(
        "id", "pair_no", "prompt", "open_prompt"
    )


ORACLE["t6_format_prompt"] = f"""
WITH {SQL_SAMPLES}
SELECT id, pair_no,
  'Query: ' || query || chr(10) || 'Context: ' || context || chr(10) || 'Response: ' || response
    AS prompt,
  'Query: ' || query || chr(10) || 'Context: ' || context || chr(10) || 'Response: ' AS open_prompt
FROM samples"""


@query
def t7_fit_tokens(spark, d):
    fitted = fit_tokens(spread(table(spark, d, "documents"), "doc_id"), "text", 64)
    return fitted.select(
        "doc_id", "n_tokens",
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
        F.size("attention_mask").alias("mask_size"),
    )


SQL_DOC_WORDS = """doc_words AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
    SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos
    FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS words FROM documents))
  WHERE w <> '')"""
ORACLE["t7_fit_tokens"] = f"""
WITH {SQL_DOC_WORDS},
per AS (SELECT doc_id, count(*) AS n_tokens,
          string_agg(cast({SQL_TOKEN.format('w')} % 50256 + 1 AS varchar), ' ' ORDER BY n)
            FILTER (n <= 64) AS ids
        FROM doc_words GROUP BY doc_id)
SELECT doc_id, cast(coalesce(n_tokens, 0) AS integer) AS n_tokens,
  CASE WHEN coalesce(n_tokens, 0) >= 64 THEN ids
       WHEN n_tokens IS NULL THEN rtrim(repeat('0 ', 64))
       ELSE ids || repeat(' 0', 64 - cast(n_tokens AS integer)) END AS input_ids,
  cast(least(coalesce(n_tokens, 0), 64) AS integer) AS n_attended, 64 AS mask_size
FROM documents LEFT JOIN per USING (doc_id)"""


@query
def t7_fit_tokens_udf(spark, d):
    """A tokeniser as a batch function: here every word becomes its length."""

    def lengths(texts):
        return [[len(w) for w in t.split(" ") if w] for t in texts]

    fitted = fit_tokens(table(spark, d, "part"), "p_name", 4, tokenizer=lengths)
    return fitted.select(
        "p_partkey", "n_tokens",
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
        F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), "").alias("mask"),
    )


ORACLE["t7_fit_tokens_udf"] = """
SELECT p_partkey, 2 AS n_tokens,
       length(split_part(p_name, ' ', 1)) || ' ' || length(split_part(p_name, ' ', 2)) || ' 0 0'
         AS input_ids,
       '1100' AS mask
FROM part"""


@query
def t8_token_stats(spark, d):
    documents = spread(table(spark, d, "documents"), "doc_id")
    return token_stats(documents, "text", 256, by=["lang"])


ORACLE["t8_token_stats"] = f"""
WITH {SQL_DOC_WORDS},
per AS (SELECT doc_id, lang, count(w) AS n FROM documents LEFT JOIN doc_words USING (doc_id)
        GROUP BY doc_id, lang)
SELECT lang, count(*) AS n_texts, count(*) FILTER (n > 256) AS n_over,
       round(avg(CASE WHEN n > 256 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_over,
       cast(min(n) AS integer) AS min_tokens, round(avg(n), 6) AS avg_tokens,
       cast(max(n) AS integer) AS max_tokens,
       cast(sum(n - least(n, 256)) AS bigint) AS tokens_cut,
       cast(sum(256 - least(n, 256)) AS bigint) AS padding
FROM per GROUP BY lang"""


@query
def t9_train_valid_split(spark, d):
    samples = training_samples(appended_part(spark, d), PART).select("id", "pair_no")
    return hash_split(samples, ["id", "pair_no"], seed=7)


ORACLE["t9_train_valid_split"] = f"""
WITH {SQL_SAMPLES}
SELECT id, pair_no,
  CASE WHEN {SQL_TOKEN.format("'7|' || id || '|' || pair_no")} % 10000 < 2000
       THEN 'valid' ELSE 'train' END AS split
FROM samples"""


@query
def t10_training_budget(spark, d):
    samples = training_samples(appended_part(spark, d), PART).select("id", "pair_no")
    return training_budget(samples, ["id", "pair_no"], batch_size=16, max_steps=100)


ORACLE["t10_training_budget"] = f"""
WITH {SQL_SAMPLES},
r AS (SELECT id, pair_no,
        row_number() OVER (ORDER BY md5('0|' || id || '|' || pair_no), id, pair_no) AS position
      FROM samples)
SELECT id, pair_no, position, cast((position - 1) // 16 AS integer) AS batch_id
FROM r WHERE position <= 1600"""


def label_results(spark, d, k=5):
    return search(table(spark, d, "part"), part_vectors(spark, d), label_requests(spark, d),
                  PART, k=k)


SQL_LABEL_RESULTS = f"""{SQL_LABEL_REQUESTS}, {SQL_PART_RECORDS},
ranks AS (SELECT query_id, id, score,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank
          FROM scores WHERE id IN (SELECT id FROM records)),
results AS (
  SELECT query_id, rank, r.id, name, description, category, score, metadata, p_retailprice
  FROM ranks r JOIN records USING (id)
  WHERE rank <= 5 AND NOT (score < 0.2))"""


@query
def t11_result_context(spark, d):
    return result_context(label_results(spark, d))


ORACLE["t11_result_context"] = f"""
WITH {SQL_LABEL_RESULTS}
SELECT query_id, 'Available products:' || chr(10) || chr(10) || string_agg(
  rank || '. ' || name || chr(10) || '   Description: ' || description || chr(10)
  || '   Category: ' || category || chr(10) || '   price: ' || cast(p_retailprice AS varchar)
  || chr(10) || chr(10), '' ORDER BY rank) AS context
FROM results WHERE rank <= 3 GROUP BY query_id"""


@query
def t12_extract_response(spark, d):
    """Whole assistant turns as answers, with a mark in front of every line."""
    turns = table(spark, d, "conversations")
    marked = F.concat(
        F.lit("Query: q\nResponse: "), F.regexp_replace("text", "\n", "\nResponse: ")
    )
    return extract_response(turns.withColumn("text", marked), "text").select(
        "conv_id", "turn", "response"
    )


ORACLE["t12_extract_response"] = r"""
SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(
  list_last(string_split('Response: ' || replace(text, chr(10), chr(10) || 'Response: '),
                         'Response: ')), '^\s+', ''), '\s+$', ''), ''),
  'I couldn''t generate a meaningful response.') AS response
FROM conversations"""


@query
def t13_result_card(spark, d):
    return result_card(label_results(spark, d)).select("query_id", "rank", "card")


SQL_CARD = """'**' || name || '**' || chr(10) || 'Description: ' || description || chr(10)
  || 'Category: ' || category || chr(10) || 'Match Score: '
  || cast(round(cast(score AS decimal(18,6)) * 100, 1) AS varchar) || '%' || chr(10)"""
ORACLE["t13_result_card"] = f"""
WITH {SQL_LABEL_RESULTS}
SELECT query_id, rank,
  {SQL_CARD} || '- price: ' || cast(p_retailprice AS varchar) AS card
FROM results"""

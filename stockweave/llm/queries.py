"""The registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm.bpe import encode
from stockweave.llm.centroids import cluster_vectors
from stockweave.llm.common import documents, tokenizer_file
from stockweave.llm.decision_list import BASE, quality_rules
from stockweave.llm.decontaminate import contaminated
from stockweave.llm.line_dedup import dedup_lines
from stockweave.llm.minhash import near_duplicates
from stockweave.llm.product_codes import compress_vectors
from stockweave.llm.quality import score_quality
from stockweave.llm.substring_dedup import dedup_runs
from stockweave.llm.suffix_dedup import remove_repeats
from stockweave.llm.token_files import fresh_token_folder, read_token_files, write_token_files
from stockweave.llm.toxicity import score_toxicity
from stockweave.llm.vector_dedup import near_vectors


def op1_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf).select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )


def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    return contaminated(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).drop("text")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).drop("text")


def op6_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    out = encode(docs, tokenizer_file("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup_runs(documents(spark, sf).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Written to files in the shared folder and read back from them."""
    files = write_token_files(
        documents(spark, sf), fresh_token_folder(spark), tokenizer_file("byte_bpe_50k.json")
    )
    return read_token_files(files, digests_only=True).drop("ids")


def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all embeddings, with the distances to their centroids."""
    return cluster_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op12_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all documents and what base rule and learnt rules make of them."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return quality_rules(documents(spark, sf), labels).select(
        "doc_id", *BASE, "base_failed", "kept", "rule", "held_out"
    )


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all embeddings, with the errors by vector and by label."""
    return compress_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_centroids": op11_centroids,
    "op12_quality_rules": op12_quality_rules,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

# All pairs of a label, then the reach of every vector.
OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label
    AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

# Finds the same overlaps another way: two substitutions leave four equal tokens
# in a row among any eleven of thirteen, so all runs of four are joined. Items of
# fewer than ten tokens must be there as they are.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
    '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
    '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
b AS (SELECT * FROM items WHERE len(v) >= 10),
whole AS (
  SELECT doc_id, item_id, len(v) AS matched
  FROM (SELECT * FROM items WHERE len(v) BETWEEN 1 AND 9) JOIN d
    ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(v, ' ') || ' ')),
dg AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
bg AS (
  SELECT item_id, j, v[j] || ' ' || v[j + 1] || ' ' || v[j + 2] || ' ' || v[j + 3] AS g
  FROM (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS j FROM b)),
h AS (SELECT DISTINCT doc_id, item_id, i - j AS diagonal FROM dg JOIN bg USING (g)),
s AS (
  SELECT doc_id, item_id, len(v) AS n, list_transform(range(1, len(v) + 1),
    lambda j: CASE WHEN diagonal + j >= 1 AND w[diagonal + j] = v[j] THEN 1 ELSE 0 END) AS m
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (
  SELECT doc_id, item_id, list_sum(m) AS matched FROM s
  WHERE list_bool_or(list_transform(range(1, n - least(n, 13) + 2),
    lambda p: list_sum(list_slice(m, p, p + least(n, 13) - 1))
      >= least(n, 13) - CASE WHEN n >= 13 THEN 2 ELSE 1 END)))
SELECT doc_id, count(DISTINCT item_id) AS n_items,
  list_sort(list(DISTINCT item_id)) AS item_ids, CAST(max(matched) AS INTEGER) AS n_matched
FROM (SELECT * FROM f UNION ALL SELECT * FROM whole) GROUP BY doc_id
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
l AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d),
s AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS dropped
  FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
    AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT run FROM s GROUP BY run HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM s JOIN r USING (run), range(35) AS t(k)),
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT w.*, g.p IS NOT NULL AS gone FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p),
a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

# Rows that can be used, as integers, numbered so that repeated ids stay apart.
SQL_INTEGERS = """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))"""
SQL_FLOOR = "CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT)"


def _op11_sql(rounds: int = 5) -> str:
    """Brute force, a pair of tables per round: a (assignments) and c (centroids)."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT r, min([list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
    c])AS best FROM v, c{i} GROUP BY r)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(z, y) AS y FROM c{i} LEFT JOIN (
    SELECT c, list(m ORDER BY j) AS z FROM (
      SELECT best[2] AS c, j, {SQL_FLOOR} AS m
      FROM (SELECT best, unnest(v.x) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (r))
      GROUP BY ALL) GROUP BY c) USING (c))"""

    steps = [s for i in range(rounds) for s in (assigned(i), moved(i))]
    return f"""
WITH {SQL_INTEGERS},
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y
  FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL
    ORDER BY h, x LIMIT 40)),
{", ".join(steps)}, {assigned(rounds)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
  CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = best[2]
"""


def _op13_sql(rounds: int = 2) -> str:
    """Brute force over the parts of all vectors (p) and the codebooks (b)."""

    def assigned(i: int) -> str:
        gap = " + ".join(f"(p.x[{j}] - b.x[{j}]) * (p.x[{j}] - b.x[{j}])" for j in range(1, 5))
        return f"""a{i} AS MATERIALIZED (
  SELECT r, part, min([{gap}, e]) AS best FROM p JOIN b{i} b USING (part) GROUP BY r, part)"""

    def moved(i: int) -> str:
        means = ", ".join(SQL_FLOOR.replace("x", f"p.x[{j}]") for j in range(1, 5))
        return f"""b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT part, best[2] AS e, [{means}] AS x FROM a{i} JOIN p USING (r, part) GROUP BY ALL) m
    ON m.part = b.part AND m.e = b.e)"""

    steps = [s for i in range(rounds) for s in (assigned(i), moved(i))]
    return f"""
WITH {SQL_INTEGERS},
p AS MATERIALIZED (
  SELECT r, part, list_slice(x, 4 * part + 1, 4 * part + 4) AS x FROM v, range(16) AS t(part)),
b0 AS MATERIALIZED (
  SELECT part, e, p.x AS x FROM p JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v WHERE vec_id IS NOT NULL
    ORDER BY vec_id, x LIMIT 64) USING (r)),
{", ".join(steps)}, {assigned(rounds)},
coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code,
    CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{rounds})
    AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


ORACLE = {
    "op1_vector_dedup": OP1_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_centroids": _op11_sql(),
    "op13_vector_codes": _op13_sql(),
}


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLE)

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.mapping import CustomColumn, SchemaMapping
from stockweave.operators import deep_pages
from stockweave.operators import score as score_module
from stockweave.operators import search as search_module
from stockweave.operators.embed import (
    HashEncoder,
    embed_column,
    hash_buckets,
    hash_embed,
    map_prompts,
)
from stockweave.operators.filters import min_score
from stockweave.operators.score import candidates, pair_scores, search_vectors, top_k
from stockweave.operators.search import (
    join_vectors,
    search,
    search_each,
    search_page,
    search_summary,
    vector_checks,
)

VECTORS = "id string, embedding array<float>"
REQUESTS = "query_id string, embedding array<double>"
SHOP = SchemaMapping("sku", "title", "text", "kind",
                     (CustomColumn("price", "price", "metadata"),))


def brute_force(vectors, requests, k, floor, groups=None):
    """Ranks by full sort, one request at a time."""
    out = set()
    for q, qv, *qg in requests:
        rows = []
        for i, v, *g in vectors:
            if groups and g != qg:
                continue
            s = float(np.dot(np.float32(v).astype(float), np.asarray(qv)))
            s = math.copysign(math.floor(abs(s) * 1e6 + 0.5) / 1e6, s)
            rows.append((s, i))
        rows.sort(key=lambda r: (-r[0], r[1]))
        kept = [r for r in rows[:k] if not r[0] < floor]
        out |= {(q, i, round(s, 6), n) for n, (s, i) in enumerate(kept, 1)}
    return out


def as_set(df):
    return {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data(spark):
    """Vectors on a coarse grid, so that many scores tie; a hot group and a hot id."""
    rng = np.random.default_rng(3)
    vectors = [
        (f"v{i}" if i % 3 else "v0", (rng.integers(-2, 3, 8) / 4).tolist(), "a" if i % 2 else "b")
        for i in range(600)
    ]
    requests = [(f"q{i}", (rng.integers(-2, 3, 8) / 2).tolist(), "a" if i % 3 else "b")
                for i in range(40)]
    v = spark.createDataFrame(vectors, VECTORS + ", model string").repartition(5)
    r = spark.createDataFrame(requests, REQUESTS + ", model string").repartition(3)
    return vectors, requests, v, r


@pytest.mark.parametrize("k", [1, 7, 50, 1000])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 64 * 11}])
def test_exact_top_k_with_ties(data, k, sizes):
    vectors, requests, v, r = data
    got = search_vectors(v, r, k, 0.2, **sizes)
    want = brute_force([x[:2] for x in vectors], [x[:2] for x in requests], k, 0.2)
    assert as_set(got) == want


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 64 * 11}])
def test_requests_only_see_their_group(data, sizes):
    vectors, requests, v, r = data
    got = search_vectors(v, r, 5, -9.0, group="model", **sizes)
    assert as_set(got) == brute_force(vectors, requests, 5, -9.0, groups=True)


def test_small_tiles_and_frequent_pruning_change_nothing(data):
    vectors, requests, _, _ = data
    ids = np.array([v[0] for v in vectors], dtype=object)
    matrix = np.array([v[1] for v in vectors], dtype=np.float64)
    asked = np.array([r[1] for r in requests])
    state = score_module._Best(np.full(len(asked), 4), 0.2)
    state.limit = 10
    for start in range(0, len(ids), 17):
        state.add(ids[start : start + 17], matrix[start : start + 17], asked)
    batch = state.batch(np.array([r[0] for r in requests], dtype=object), False).to_pydict()
    got = {(q, i, s) for q, i, s in zip(batch["query_id"], batch["id"], batch["score"], strict=True)}
    want = brute_force([x[:2] for x in vectors], [x[:2] for x in requests], 4, 0.2)
    assert got == {w[:3] for w in want}


def test_ranks_have_no_gaps(data):
    _, _, v, r = data
    stats = search_vectors(v, r, 9).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("d"))
    assert all(s["n"] == s["last"] == s["d"] for s in stats.collect())


def test_nan_score_is_first_and_not_under_the_floor(spark):
    v = spark.createDataFrame([("a", [1.0]), ("b", [float("nan")]), ("c", [0.1])], VECTORS)
    r = spark.createDataFrame([("q", [1.0])], REQUESTS)
    got = [(x["id"], x["rank"]) for x in search_vectors(v, r, 3).orderBy("rank").collect()]
    assert got == [("b", 1), ("a", 2)]
    scored = pair_scores(v.select("id").join(r.select("query_id")), v, r)
    assert [x["id"] for x in top_k(scored, 2).collect()] == ["b", "a"]
    assert min_score(scored, 0.2).count() == 2


def test_pair_scores_are_those_of_the_search(data):
    _, _, v, r = data
    found = search_vectors(v, r, 5, floor=None)
    given = found.select("query_id", "id").union(
        found.select(F.lit("no such request"), "id").limit(3)
    )
    scores = pair_scores(given, v, r)
    got = {(s["query_id"], s["id"], round(s["score"], 6)) for s in scores.collect()}
    # Ids that several vectors have give a score for each.
    assert {w[:3] for w in as_set(found)} <= got
    assert {g[:2] for g in got} == {w[:2] for w in as_set(found)}


def test_null_vectors_are_skipped(spark):
    v = spark.createDataFrame([("a", [1.0]), ("b", None)], VECTORS)
    r = spark.createDataFrame([("q", [1.0]), ("p", None)], REQUESTS)
    assert as_set(search_vectors(v, r)) == {("q", "a", 1.0, 1)}


def test_no_requests_and_no_vectors(spark, data):
    _, _, v, r = data
    assert search_vectors(v, r.where("false")).count() == 0
    assert search_vectors(v.where("false"), r).count() == 0


def test_k_starts_at_one(data):
    _, _, v, r = data
    with pytest.raises(ValueError, match="at least 1"):
        candidates(v, r, 0, 0.2)


def test_lengths_must_agree(spark, data):
    _, _, v, _ = data
    with pytest.raises(Exception, match="components"):
        search_vectors(v, spark.createDataFrame([("q", [1.0])], REQUESTS)).collect()


@pytest.fixture(scope="module")
def shop(spark):
    goods = spark.createDataFrame(
        [(f"s{i}", f"title {i}", "text", "red" if i % 2 else "blue", float(i)) for i in range(20)],
        "sku string, title string, text string, kind string, price double")
    vectors = spark.createDataFrame([(f"s{i}", [1.0 - i / 20, 0.0]) for i in range(20)], VECTORS)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("none", [-1.0, 0.0])], REQUESTS)
    return goods, vectors, asked


def test_filters_come_before_the_cut(shop):
    goods, vectors, asked = shop
    got = search(goods, vectors, asked, SHOP, k=3,
                 filters={"category": "red", "price": [5, 100], "brand": ""})
    rows = [(r["rank"], r["id"], r["metadata"]["price"]) for r in got.orderBy("rank").collect()]
    assert rows == [(1, "s5", "5.0"), (2, "s7", "7.0"), (3, "s9", "9.0")]


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 16 * 3}])
@pytest.mark.parametrize("carried", [False, True])
def test_each_request_has_its_own_filters(spark, shop, sizes, carried):
    goods, vectors, _ = shop
    if carried:
        vectors = vectors.join(goods.selectExpr("sku AS id", "kind AS category", "price"), "id")
    given = {
        "all": None,
        "red": '{"category": "red"}',
        "cheap": '{"price_range": [null, 4], "category": ""}',
        "both": '{"category": "blue", "price": [9, 99]}',
        "none": '{"category": "green"}',
    }
    asked = spark.createDataFrame([(q, [1.0, 0.0], f) for q, f in given.items()],
                                  REQUESTS + ", filters string")
    got = search_each(goods, vectors, asked, SHOP, k=3, floor=0.0, **sizes)
    rows = {q: [] for q in given}
    for r in got.orderBy("rank").collect():
        rows[r["query_id"]].append(r["id"])
    assert rows == {"all": ["s0", "s1", "s2"], "red": ["s1", "s3", "s5"],
                    "cheap": ["s0", "s1", "s2"], "both": ["s10", "s12", "s14"], "none": []}


def test_each_request_has_its_own_cut(spark, shop):
    goods, vectors, _ = shop
    asked = spark.createDataFrame(
        [("a", [1.0, 0.0], 3), ("b", [1.0, 0.0], 0), ("c", [1.0, 0.0], None), ("d", [1.0, 0.0], 12)],
        REQUESTS + ", max_items int")
    got = search_each(goods, vectors, asked, SHOP, k=5).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {"a": 3, "b": 5, "c": 5, "d": 12}


def test_pages_cover_the_list_once(shop):
    goods, vectors, asked = shop
    seen, total = [], None
    for page in (1, 2, 3, 4):
        rows = search_page(goods, vectors, asked, SHOP, page, 6).orderBy("rank").collect()
        seen += [r["id"] for r in rows]
        total = rows[0]["total"] if rows else total
    assert total == 17
    assert seen == [f"s{i}" for i in range(17)]
    first = search_page(goods, vectors, asked, SHOP, 1, 6).first()
    assert (first["total_pages"], first["page"]) == (3, 1)


@pytest.mark.parametrize("kept", [40, 100_000])
def test_deep_pages_are_those_of_the_plain_search(spark, monkeypatch, kept):
    """Many ties, NaN and negative scores; bins cut finer until few rows are left."""
    rng = np.random.default_rng(5)
    at = rng.integers(-3, 4, (900, 2)) / 4 + rng.choice([0, 1e-6, 2e-6], (900, 1))
    rows = [(f"s{i:03}", [float("nan") if i == 77 else float(a), float(b)])
            for i, (a, b) in enumerate(at)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    goods = vectors.selectExpr("id AS sku", "id AS title")
    shop = SchemaMapping("sku", "title")
    asked = spark.createDataFrame(
        [("a", [1.0, 0.25]), ("b", [-300.0, 2.0]), ("zero", [0.0, 0.0])], REQUESTS)
    names = ("query_id", "rank", "id", "score", "total", "total_pages")
    monkeypatch.setattr(deep_pages, "SORTED_ROWS", kept)
    for page, size, floor in ((2, 7, 0.2), (9, 50, -1e9), (901, 1, None)):
        def rows_of(df):
            return sorted(str(tuple(r[n] for n in names)) for r in df.collect())

        monkeypatch.setattr(search_module, "DEEP_ROWS", 10**9)
        want = rows_of(search_page(goods, vectors, asked, shop, page, size, floor))
        monkeypatch.setattr(search_module, "DEEP_ROWS", 0)
        assert rows_of(search_page(goods, vectors, asked, shop, page, size, floor)) == want
        assert page == 901 or want


def test_a_deep_page_keeps_few_rows(spark, monkeypatch):
    """Rows that leave the last scan are those of a few bins, not of all pages before."""
    monkeypatch.setattr(deep_pages, "SORTED_ROWS", 50)
    vectors = spark.range(20_000).selectExpr(
        "cast(id AS string) AS id", "array(cast(id / 20000 AS float)) AS embedding")
    matrix = {None: (np.array(["q"], object), np.array([[1.0]]), np.array([1]))}
    ranks = deep_pages.deep_ranks(vectors, matrix, 10_001, 10_020, None)
    got = sorted((r["rank"], int(r["id"])) for r in ranks.collect())
    assert got == [(n, 20_000 - n) for n in range(10_001, 10_021)]
    plan = ranks._jdf.queryExecution().optimizedPlan()
    files = [f for f in ranks.inputFiles() if "positions" in f]
    assert files and spark.read.parquet(*files).count() <= 100 and plan is not None


def test_many_best_rows_are_ranked_by_tasks(spark, monkeypatch):
    scored = spark.range(3000).selectExpr(
        "cast(id AS string) AS id", "cast(id % 700 AS double) AS score").repartition(4)
    want = sorted(((r["score"], r["id"]) for r in scored.collect()), key=lambda r: (-r[0], r[1]))
    monkeypatch.setattr(score_module, "MERGED_ROWS", 10)
    got = top_k(scored, 1234)
    assert {(r["score"], r["id"]) for r in got.collect()} == set(want[:1234])
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_summary_of_a_request_without_hits(spark, shop):
    goods, vectors, asked = shop
    results = search(goods, vectors, asked, SHOP, k=3)
    table = spark.createDataFrame([("q", "a?", "m/1"), ("none", "b?", "m/1")],
                                  "query_id string, query string, model_path string")
    rows = {r["query_id"]: (r["total"], r["natural_response"])
            for r in search_summary(table, results).collect()}
    assert rows == {"q": (3, None), "none": (0, "No matching products found.")}


def test_repeated_ids_are_told_apart_by_row_key(spark):
    goods = spark.createDataFrame([("1", "old", "r1"), ("1", "new", "r2")],
                                  "sku string, title string, row_key string")
    vectors = spark.createDataFrame([("r1", [0.5]), ("r2", [0.9])], VECTORS)
    asked = spark.createDataFrame([("q", [1.0])], REQUESTS)
    got = search(goods, vectors, asked, SchemaMapping("sku", "title"), row_key="row_key")
    assert [(r["id"], r["name"]) for r in got.orderBy("rank").collect()] == [
        ("1", "new"), ("1", "old")]


def test_vector_checks_find_what_does_not_match(spark):
    vectors = spark.createDataFrame(
        [("a", [3.0, 4.0]), ("b", [float("inf"), 0.0]), ("x", [1.0, 0.0, 0.0])], VECTORS)
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")
    row = vector_checks(vectors, ids).first()
    assert (row["n_vectors"], row["min_dim"], row["max_dim"], row["n_bad_values"]) == (3, 2, 3, 1)
    assert (row["vectors_without_row"], row["rows_without_vector"]) == (1, 2)
    assert join_vectors(ids, vectors).count() == 2


TEXTS = ["red red bolt", "", "  Blue\tÉTÉ\nbolt ", None, "x" * 50]


def test_jvm_and_python_hash_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", hash_buckets(F.col("t"), 32).alias("b")).collect()
    for r in rows:
        counts = np.bincount(np.array(r["b"], dtype=int), minlength=32)
        norm = np.sqrt((counts**2).sum()) or 1.0
        assert np.allclose(HashEncoder(32)([r["t"] or ""])[0], counts / norm)


def test_words_end_at_ascii_blanks_alone(monkeypatch):
    """Bytes are split once; other white space belongs to a word."""
    seen = []
    encode = HashEncoder()
    monkeypatch.setattr(type(encode.bucket), "__missing__", lambda self, w: seen.append(w) or 0)
    encode(["Ab\u3000c\x1cd\x85e  f\x0bg\x0ch\t\r\n", ""])
    assert seen == ["ab\u3000c\x1cd\x85e".encode(), b"f", b"g", b"h"]


def test_embedding_batches_and_encoder_once_per_task(spark):
    df = spark.createDataFrame([(i, TEXTS[i % 5]) for i in range(103)], "i int, t string")
    got = {r["i"]: r["embedding"] for r in embed_column(df, "t", HashEncoder, batch=8).collect()}
    want = HashEncoder()([TEXTS[i % 5] or "" for i in range(103)]).astype(np.float32)
    assert all(np.allclose(got[i], want[i]) for i in range(103))
    assert hash_embed(df.where("false"), "t").count() == 0


def test_encoder_runs_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting():
        def encode(texts):
            seen.add(len(texts))
            return np.ones((len(texts), 2))
        return encode

    df = spark.range(50).selectExpr("cast(id AS string) AS id", "'t' AS t")
    vectors = embed_column(df, "t", counting).where("embedding IS NOT NULL")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], REQUESTS)
    assert search_vectors(vectors, asked, 3).count() == 3
    assert seen.value == 50


def test_one_bad_prompt_does_not_spoil_the_batch(spark):
    def generate(prompts):
        if "bad" in prompts:
            raise RuntimeError("cannot")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "p string").coalesce(1)
    rows = {r["p"]: (r["generated"], r["error"]) for r in map_prompts(df, "p", generate).collect()}
    assert rows == {"a": ("A", None), "b": ("B", None),
                    "bad": ("I apologize, but I couldn't process your query.", "cannot")}

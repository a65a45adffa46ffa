"""Requests with settings of their own: the filter index, cuts, pages, models, answers."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockweave.mapping import CustomColumn, SchemaMapping
from stockweave.operators import search as search_module
from stockweave.operators.answers import answer_requests, search_answers
from stockweave.operators.embed import embed_column, hash_embed
from stockweave.operators.filters import apply_filters
from stockweave.operators.request_index import RequestIndex, index_columns
from stockweave.operators.search import search, search_each, search_page, search_requests
from stockweave.sources.store import open_store, open_version, write_catalog_version

SHOP = SchemaMapping("sku", "title", "text", "kind", (CustomColumn("price", "price", "filter"),))
GRID = {"broadcast_bytes": 0, "block_bytes": 16 * 3}


def moved(df):
    """Exchanges of a plan that carry vectors."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange" in x and "embedding" in x.lower()]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [
        (f"v{i}", rng.choice(["red", "blue", None, "5"]), rng.choice([None, 1, 2, 3, 5]),
         rng.choice([None, 0.1, 0.5, float("nan"), 2.5]), rng.choice([None, True, False]),
         rng.choice(["7", "1.5", "x", "", None]))
        for i in range(300)
    ]
    schema = "id string, kind string, size int, price float, sold boolean, note string"
    return spark.createDataFrame(data, schema)


def test_index_agrees_with_filters(spark, rows):
    """Every filter set sees the rows that the plain predicate passes."""
    given = [
        {}, {"kind": "red"}, {"kind": 5}, {"size": 2}, {"size": "3.0"}, {"size": 2.5},
        {"size": "x"}, {"size": [2, 3]}, {"size": [None, 2]}, {"price": 0.1}, {"price": [0.5, None]},
        {"price": [3, 1]}, {"note": [1, 7]}, {"note": "7"}, {"kind": "red", "price": [0, 1], "size": 1},
        {"sold": True}, {"sold": "false"}, {"sold": "maybe"}, {"kind": "none"}, {"kind": "", "size": []},
        {"price": 9.9}, {"kind": "blue", "sold": True, "note": [0, 10]},
    ]
    texts = [json.dumps(g) for g in given]
    columns = index_columns(rows, {c: c for c in rows.columns})
    index = RequestIndex(texts, columns)
    table = rows.select("id", *index.expressions()).toArrow().combine_chunks()
    ids = np.array(table.column("id").to_pylist())
    batch = table.to_batches()[0]
    got = {key: set(ids[at]) for key, at in index.rows(batch)}
    for text, g in zip(texts, given, strict=True):
        want = {r["id"] for r in apply_filters(rows, g).collect()}
        assert got.get(text, set()) == want, text


def test_index_of_thousands_of_sets_is_looked_up(spark, rows):
    texts = [json.dumps({"kind": f"k{i}", "price": [i, i + 1]}) for i in range(5000)]
    index = RequestIndex(texts, index_columns(rows, {"kind": "kind", "price": "price"}))
    batch = pa.record_batch({
        index.columns[0].text: pa.array([f"k{i % 6000}" for i in range(8000)]),
        index.columns[0].number: pa.array([None] * 8000, pa.float64()),
        index.columns[1].number: pa.array([float(i % 6000) for i in range(8000)]),
    })
    found = dict(index.rows(batch))
    assert len(found) == 5000
    assert list(found[texts[7]]) == [7, 6007]


def test_common_condition_reaches_the_scan(spark, folder, rows):
    rows.write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    columns = index_columns(df, {c: c for c in df.columns})
    both = RequestIndex(['{"kind": "red"}', '{"kind": "blue", "size": 2}'], columns)
    plan = df.where(both.common(df))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(kind,blue),EqualTo(kind,red))" in plan or "In(kind" in plan
    assert RequestIndex(['{"kind": "red"}', ""], columns).common(df) is None
    assert RequestIndex(['{"kind": "red"}', '{"size": 1}'], columns).common(df) is None


def test_unknown_columns_and_bad_filters_are_errors(spark, rows):
    columns = index_columns(rows, {"kind": "kind"})
    with pytest.raises(ValueError, match="unknown filter column"):
        RequestIndex(['{"weight": 1}'], columns)
    with pytest.raises(ValueError):
        RequestIndex(["[1]"], columns)


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(7)
    goods = spark.createDataFrame(
        [(f"s{i}", f"title {i}", "text", f"k{i % 4}", float(i % 50)) for i in range(200)],
        "sku string, title string, text string, kind string, price double")
    at = rng.integers(-3, 4, (220, 3)) / 2  # many ties; twenty vectors without a row
    vectors = spark.createDataFrame(
        [(f"s{i}", v.tolist(), f"models/{i % 2}") for i, v in enumerate(at)],
        "id string, embedding array<float>, model_path string")
    asked = []
    for i in range(30):
        filters = [None, {"category": f"k{i % 4}"}, {"price": [i % 7, 30 + i]},
                   {"category": "k1", "price": [3, 20]}, {"category": "k9"}][i % 5]
        asked.append((f"q{i}", (rng.integers(-2, 3, 3) / 2).tolist(), f"models/{i % 3}",
                      json.dumps(filters) if filters else None, i % 6, i % 4))
    requests = spark.createDataFrame(
        asked, "query_id string, embedding array<double>, model_path string, filters string, "
        "max_items int, page int")
    return goods, vectors, requests, asked


def one_by_one(goods, vectors, asked, group, page):
    """Each request on its own, by plain Python."""
    rows = {r["sku"]: r for r in goods.collect()}
    known = [(r["id"], r["embedding"], r["model_path"]) for r in vectors.collect() if r["id"] in rows]
    out = set()
    for q, v, model, text, items, p in asked:
        size, p = (items if items >= 1 else 4), (p if p >= 1 and page else 1)
        f = json.loads(text) if text else {}
        low, high = f.get("price", (-1, 1e9))
        seen = [
            (-round(float(np.dot(x, v)), 6), i) for i, x, m in known
            if (not group or m == model) and f.get("category") in (None, rows[i]["kind"])
            and low <= rows[i]["price"] <= high
        ]
        seen = sorted(s for s in seen if -s[0] >= 0.2)
        for rank, (s, i) in enumerate(seen, 1):
            if (p - 1) * size < rank <= p * size:
                out.add((q, rank, i, -s, *((p, len(seen), -(-len(seen) // size)) if page else ())))
    return out


@pytest.mark.parametrize("sizes", [{}, GRID])
@pytest.mark.parametrize("group", [None, "model_path"])
@pytest.mark.parametrize("carried", [False, True])
def test_requests_with_all_settings(shop, sizes, group, carried):
    goods, vectors, requests, asked = shop
    if carried:
        vectors = vectors.join(goods.selectExpr("sku AS id", "kind AS category", "price"), "id", "left")
    got = search_requests(goods, vectors, requests, SHOP, 4, group=group, **sizes)
    names = ("query_id", "rank", "id", "score", "page", "total", "total_pages")
    assert {tuple(r[n] for n in names) for r in got.collect()} == one_by_one(
        goods, vectors, asked, group, True)
    got = search_each(goods, vectors, requests, SHOP, 4, group=group, **sizes)
    assert {tuple(r[n] for n in names[:4]) for r in got.collect()} == one_by_one(
        goods, vectors, asked, group, False)


def test_many_requests_are_encoded_once(spark, shop, monkeypatch):
    monkeypatch.setattr("stockweave.operators.score.PROBE_ROWS", 3)
    seen = spark.sparkContext.accumulator(0)

    def counting():
        def encode(texts):
            seen.add(len(texts))
            return np.ones((len(texts), 3))
        return encode

    goods, vectors, _, _ = shop
    asked = spark.range(40).selectExpr("cast(id AS string) AS query_id", "'t' AS t").repartition(8)
    requests = embed_column(asked, "t", counting)
    assert search(goods, vectors, requests, SHOP, k=1).count() == 40
    assert seen.value <= 40 + 8 * 5  # the first look, and one pass


def test_vectors_stay_in_place(spark, shop, folder, monkeypatch):
    goods, vectors, requests, _ = shop
    vectors.write.parquet(f"{folder}/v")
    stored = spark.read.parquet(f"{folder}/v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = requests.select("query_id", "embedding")
        for df in (search(goods, stored, asked, SHOP), search_page(goods, stored, asked, SHOP),
                   search(goods, stored, asked, SHOP, filters={"category": "k1"})):
            assert not moved(df)
        # Long lists of ids with a short rest: the rest is what is sent.
        monkeypatch.setattr(search_module, "BROADCAST_ROWS", 50)
        df = search(goods, stored, asked, SHOP, k=3)
        assert not moved(df)
        few = {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}
        monkeypatch.setattr(search_module, "BROADCAST_ROWS", 1)  # neither is short
        many = search(goods, stored, asked, SHOP, k=3)
        assert {(r["query_id"], r["id"], r["rank"]) for r in many.collect()} == few
        assert not any(r[1] in {f"s{i}" for i in range(200, 220)} for r in few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("buckets", [0, 3])
def test_published_versions_settle_their_members(spark, shop, folder, buckets):
    goods, vectors, requests, _ = shop
    plain = vectors.drop("model_path")
    write_catalog_version(goods, plain, folder, "1", key="sku", buckets=buckets)
    if buckets:  # another session knows the folder only
        for t in spark.catalog.listTables():
            spark.sql(f"DROP TABLE {t.name}")
    version = open_version(spark, folder, "1")
    assert version.vectors.count() == 200
    asked = requests.select("query_id", "embedding")
    names = ("query_id", "rank", "id", "score")
    got = {tuple(r[n] for n in names) for r in version.search(asked, SHOP, k=5).collect()}
    want = search(goods, vectors, asked, SHOP, k=5)
    assert got == {tuple(r[n] for n in names) for r in want.collect()}
    ranks = {}
    for q, rank, *_ in got:
        ranks.setdefault(q, set()).add(rank)
    assert all(r == set(range(1, len(r) + 1)) for r in ranks.values())  # no gaps
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not moved(version.search(asked, SHOP))
        joined = search_module.join_vectors(
            version.products.withColumnRenamed("sku", "id"), version.vectors)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (not buckets)
        assert joined.count() == 200
        if buckets:  # many ranks: they go to the products, not the products to them
            ranked = spark.range(10).selectExpr("'q' AS query_id", "concat('s', id) AS id",
                                                "1.0D AS score", "id AS rank")
            records = search_module.attach_records(
                ranked, version.products, SHOP, None, row_key="sku")
            plan = records._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_store_of_several_models(spark, shop, folder):
    goods, vectors, requests, _ = shop
    for v in "01":
        own = vectors.where(F.col("model_path") == f"models/{v}").drop("model_path")
        write_catalog_version(goods, own, folder, v, key="sku")
    store = open_store(spark, folder, ["0", "1"])
    got = search_each(store.products, store.vectors, requests.drop("filters"), SHOP, 4,
                      row_key=store.row_key, group="model_path")
    want = search_each(goods, vectors, requests.drop("filters"), SHOP, 4, group="model_path")
    names = ("query_id", "rank", "score")
    assert {tuple(r[n] for n in names) for r in got.collect()} == {
        tuple(r[n] for n in names) for r in want.collect()}


def test_answers(spark, folder):
    goods = spark.createDataFrame(
        [("1", "red lamp", "a lamp", "A"), ("2", "blue lamp", None, "A"), ("3", "lamp", "x", "B"),
         ("4", "lamp oil", "y", "B")], "sku string, title string, text string, kind string")
    vectors = hash_embed(goods, "title").select(F.col("sku").alias("id"), "embedding")
    write_catalog_version(goods, vectors, folder, "1", key="sku")
    asked = spark.createDataFrame(
        [("hit", "lamp", None), ("page", "lamp", None), ("none", "sofa", None),
         ("bad", "blue bad", None), ("lost", "boom", None), ("wrong", "", "query is required")],
        "query_id string, query string, error string").withColumns(
        {"model_path": F.lit("m"), "page": F.when(F.col("query_id") == "page", 2),
         "max_items": F.lit(3)})

    def encoder():
        from stockweave.operators.embed import HashEncoder
        encode = HashEncoder()

        def run(texts):
            if "boom" in texts:
                raise ValueError("boom")
            return encode(texts)
        return run

    def generate(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("cannot")
        return [p + f"  {p.count('Category')} things " for p in prompts]

    results, answers = answer_requests(
        open_version(spark, folder, "1"), asked, SHOP,
        lambda df, c: embed_column(df, c, encoder, keep_going=True), generate)
    got = {r["query_id"]: (r["total"], r["natural_response"], r["error"]) for r in answers.collect()}
    assert got == {
        "hit": (3, "3 things", None),
        "page": (1, "1 things", None),
        "none": (0, "No matching products found.", None),
        "bad": (1, "I apologize, but I couldn't process your query.", "cannot"),
        "lost": (0, None, "query could not be encoded"),
        "wrong": (0, None, "query is required"),
    }
    assert results.where("query_id = 'page'").first()["rank"] == 4


def test_answers_of_nothing(spark):
    asked = spark.createDataFrame([], "query_id string, query string, model_path string")
    schema = ("query_id string, rank bigint, id string, name string, description string, "
              "category string, score double, metadata map<string, string>")
    results = spark.createDataFrame([], schema)
    assert search_answers(asked, results, lambda p: p).collect() == []

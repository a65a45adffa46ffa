"""Input that must not lose or mix up rows without a word."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockweave.mapping import SchemaMapping
from stockweave.operators.filters import apply_filters
from stockweave.operators.search import search, search_page
from stockweave.operators.versions import latest_by_id
from stockweave.sources.catalog_csv import read_catalog_csv


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "v1.2").mkdir()
    at = tmp_path / "v1.2"
    (at / "a.csv").write_text("id,name,price\n1,x,5\n2,y\n")
    (at / "b.csv").write_text('name,"i""d",id,price\nz,q,3,7\n')
    (at / "c.csv").write_text("")
    got = {tuple(r) for r in read_catalog_csv(spark, str(at)).select("id", "name", "price", '`i"d`')
           .collect()}
    assert got == {("1", "x", "5", None), ("2", "y", None, None), ("3", "z", "7", "q")}
    some = read_catalog_csv(spark, str(at), ["price", "other"])
    assert sorted(map(tuple, some.collect()), key=str) == [("5", None), ("7", None), (None, None)]


def test_csv_extra_cells_and_names_in_capitals(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x,5\n")
    with pytest.raises(Exception, match="more cells than columns"):
        read_catalog_csv(spark, str(tmp_path)).collect()
    (tmp_path / "D.CSV").write_text("id,name\n1,x\n")
    with pytest.raises(ValueError, match="only CSV"):
        read_catalog_csv(spark, str(tmp_path))


def test_latest_by_id_keeps_every_id(spark):
    rows = [("a", None, 1), ("a", None, 2), ("b", 5, 1), ("b", 5, 2), ("b", None, 9), ("c", 1, 0)]
    df = spark.createDataFrame(rows, "id string, at int, v int")
    want = {("a", None, 2), ("b", 5, 2), ("c", 1, 0)}
    assert {tuple(r) for r in latest_by_id(df, "id", "at").collect()} == want
    again = df.repartition(3, "v").orderBy(F.desc("v"))
    assert {tuple(r) for r in latest_by_id(again, "id", "at").collect()} == want


def test_vectors_without_a_row_take_no_rank(spark):
    catalog = spark.createDataFrame([(str(i), f"n{i}") for i in range(0, 30, 3)], "id string, name string")
    vectors = spark.createDataFrame(
        [(str(i), [1.0 - i / 100, 0.0]) for i in range(30)], "id string, embedding array<float>"
    )
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    mapping = SchemaMapping("id", "name")
    got = search(catalog, vectors, asked, mapping, k=5).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(k + 1, str(3 * k)) for k in range(5)]
    seen = []
    for page in (1, 2, 3):
        rows = search_page(catalog, vectors, asked, mapping, page=page, size=4).collect()
        assert {(r["total"], r["total_pages"]) for r in rows} == {(10, 3)}
        seen += sorted(r["rank"] for r in rows)
    assert seen == list(range(1, 11))


def test_equality_by_type_is_pushed_down(spark, tmp_path, capsys):
    spark.createDataFrame(
        [(1, 950.0, True), (2, 7.5, False)], "size int, price double, sold boolean"
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for given, n in ((({"price": 950}), 1), ({"price": "950.0"}, 1), ({"size": 1.0}, 1),
                     ({"size": 1.5}, 0), ({"size": "x"}, 0), ({"sold": True}, 1),
                     ({"size": 10**12}, 0)):
        assert apply_filters(df, given).count() == n, given
    apply_filters(df, {"price": 950}).explain()
    assert "EqualTo(price,950.0)" in capsys.readouterr().out

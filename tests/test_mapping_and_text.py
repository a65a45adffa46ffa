from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockweave.mapping import CustomColumn, SchemaMapping, missing_columns, require_columns
from stockweave.operators.filters import apply_filters
from stockweave.operators.project import (
    apply_schema_mapping,
    check_required_columns,
    metadata_map,
    preview,
)
from stockweave.operators.textprep import (
    embedding_text,
    extract_response,
    format_prompt,
    product_context,
    result_card,
    result_context,
    training_samples,
)
from stockweave.operators.validate import apply_defaults, rejection_counts, validate_rows

APPLIANCES = SchemaMapping.from_dict(
    {
        "id_column": "SKU",
        "name_column": "PRODUCT_NAME",
        "description_column": "BREADCRUMBS",
        "category_column": "CATEGORY",
        "custom_columns": [
            {"user_column": "BRAND", "standard_column": "brand", "role": "training",
             "required": True},
            {"user_column": "SUBCATEGORY", "standard_column": "subcategory", "role": "training"},
            {"user_column": "PRICE_CURRENT", "standard_column": "list_price", "role": "metadata"},
            {"user_column": "SELLER", "standard_column": "seller", "role": "metadata"},
        ],
        "required_columns": ["SKU", "PRODUCT_NAME", "CATEGORY"],
    }
)
COLS = ["SKU", "PRODUCT_NAME", "BREADCRUMBS", "CATEGORY", "BRAND", "PRICE_CURRENT", "SELLER"]
SCHEMA = ", ".join(f"{c} string" for c in COLS)


@pytest.fixture(scope="module")
def goods(spark):
    return spark.createDataFrame(
        [
            ("1", "Dishwasher", "Home > Kitchen", "Appliances", "Bosch", "999.5", "A"),
            ("2", "Washer", "", "Appliances", None, None, None),
            ("3", "", "", "", "", "abc", ""),
        ],
        SCHEMA,
    )


def by_id(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_mapping_round_trip():
    assert SchemaMapping.from_dict(APPLIANCES.to_dict()) == APPLIANCES


def test_embedding_text_skips_empty_parts_and_absent_columns(goods):
    assert by_id(embedding_text(goods, APPLIANCES), "text") == {
        "1": "Dishwasher Home > Kitchen Appliances Bosch",
        "2": "Washer Appliances",
        "3": "",
    }


def test_embedding_text_needs_a_column(goods):
    with pytest.raises(ValueError, match="No valid columns"):
        embedding_text(goods.select("SKU"), APPLIANCES)


def test_product_context_labels_and_missing_text(goods):
    assert by_id(product_context(goods, APPLIANCES), "context")["1"] == (
        "Product: Dishwasher\nDescription: Home > Kitchen\nCategory: Appliances\n"
        "Brand: Bosch\nList Price: 999.5\nSeller: A"
    )
    assert by_id(product_context(goods, APPLIANCES), "context")["2"] == (
        "Product: Washer\nCategory: Appliances"
    )
    assert by_id(product_context(goods, APPLIANCES, "nan"), "context")["2"] == (
        "Product: Washer\nCategory: Appliances\nBrand: nan\nList Price: nan\nSeller: nan"
    )


def test_samples_are_three_plus_filled_customs(goods):
    counts = {r["id"]: r["count"] for r in training_samples(goods, APPLIANCES).groupBy("id")
              .count().collect()}
    assert counts == {"1": 6, "2": 3, "3": 4}


def test_custom_column_overrides_and_last_duplicate_wins(goods):
    mapping = SchemaMapping(
        "SKU", "PRODUCT_NAME", "BREADCRUMBS", "CATEGORY",
        (CustomColumn("BRAND", "name"), CustomColumn("SELLER", "shop"),
         CustomColumn("PRICE_CURRENT", "shop")),
    )
    got = training_samples(goods.where("SKU = '1'"), mapping)
    questions = [r["query"] for r in got.orderBy("pair_no").collect()]
    assert questions == [
        "Do you have Bosch?", "Tell me about Bosch", "What products do you have in Appliances?",
        "What is the shop of Bosch?",
    ]
    assert "999.5" in got.where("pair_no = 4").first()["response"]


def test_samples_need_the_training_columns(goods):
    with pytest.raises(ValueError, match="BREADCRUMBS"):
        training_samples(goods.drop("BREADCRUMBS"), APPLIANCES)


def test_required_columns(goods):
    assert missing_columns(goods.drop("BRAND"), APPLIANCES, ["name", "category"]) == ["BRAND"]
    assert missing_columns(goods, SchemaMapping(id_column="SKU"), ["name"]) == ["name_column"]
    with pytest.raises(ValueError, match="CATEGORY"):
        require_columns(goods.drop("CATEGORY"), APPLIANCES, ["name"], declared=True)
    rows = {r["column_name"]: (r["is_present"], r["rows_filled"])
            for r in check_required_columns(goods.drop("CATEGORY"), APPLIANCES).collect()}
    assert rows == {"PRODUCT_NAME": (True, 3), "BREADCRUMBS": (True, 3), "BRAND": (True, 2),
                    "SKU": (True, 3), "CATEGORY": (False, 0)}


def test_metadata_keeps_or_drops_missing(goods):
    assert by_id(metadata_map(goods, APPLIANCES), "metadata")["2"] == {}
    assert by_id(metadata_map(goods, APPLIANCES, "nan"), "metadata")["2"] == {
        "list_price": "nan", "seller": "nan"}
    assert by_id(metadata_map(goods, SchemaMapping("SKU", "PRODUCT_NAME")), "metadata")["1"] == {}


def test_standard_record_of_unmapped_fields(goods):
    row = apply_schema_mapping(goods, SchemaMapping("SKU", "PRODUCT_NAME")).first()
    assert row.asDict() == {"id": "1", "name": "Dishwasher", "description": None, "category": None}


def test_user_columns_with_dots(spark):
    df = spark.createDataFrame([("1", "x")], "`item.id` string, `item name` string")
    row = apply_schema_mapping(df, SchemaMapping("item.id", "item name")).first()
    assert (row["id"], row["name"]) == ("1", "x")


def test_preview_marks_empty_cells(goods):
    assert preview(goods, APPLIANCES, 2).collect()[1].asDict() == {
        "SKU": "2", "PRODUCT_NAME": "Washer", "BREADCRUMBS": "-", "CATEGORY": "Appliances",
        "BRAND": "-", "PRICE_CURRENT": "-", "SELLER": "-"}


def test_row_validation(spark):
    df = spark.createDataFrame(
        [("1", "ok"), (" \t", "x"), (None, " "), ("4", None)], "SKU string, PRODUCT_NAME string"
    )
    ok, bad = validate_rows(df, SchemaMapping("SKU", "PRODUCT_NAME"))
    assert [r["SKU"] for r in ok.collect()] == ["1"]
    assert {r["reason"]: r["n_rows"] for r in rejection_counts(bad).collect()} == {
        "blank id": 2, "blank name": 2}


def test_defaults_replace_zero_and_null_only(spark):
    df = spark.createDataFrame([(0,), (None,), (-1,), (7,)], "max_items int")
    assert [r[0] for r in apply_defaults(df, {"max_items": 10}).collect()] == [10, 10, -1, 7]


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({"list_price": [0, 999.5]}, ["1"]),
        ({"list_price": [999.5, None]}, ["1"]),
        ({"list_price": [0, 999]}, []),
        ({"category": "Appliances"}, ["1", "2"]),
        ({"category": "", "brand": None}, ["1", "2", "3"]),
        ({"category": "Appliances", "brand": "Bosch", "list_price": ["", ""]}, ["1"]),
    ],
)
def test_filters(goods, wanted, ids):
    got = apply_filters(goods, wanted, APPLIANCES)
    assert sorted(r["SKU"] for r in got.collect()) == ids


def test_unknown_filter_is_an_error(goods):
    with pytest.raises(ValueError, match="unknown filter"):
        apply_filters(goods, {"colour": "red"}, APPLIANCES)


def test_filters_reach_the_scan(spark, folder, capsys):
    spark.range(10).selectExpr(
        "cast(id AS string) AS SKU", "'n' AS PRODUCT_NAME", "'c' AS CATEGORY",
        "id * 1.5D AS PRICE_CURRENT", "'unused' AS extra",
    ).write.parquet(f"{folder}/p")
    df = apply_filters(spark.read.parquet(f"{folder}/p"),
                       {"category": "c", "list_price": [1, 5]}, APPLIANCES)
    apply_schema_mapping(df, APPLIANCES, roles=[]).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(CATEGORY,c)" in plan
    assert "GreaterThanOrEqual(PRICE_CURRENT,1.0)" in plan
    assert "extra" not in plan


@pytest.mark.parametrize(
    ("text", "answer"),
    [
        ("Query: a\nResponse: one\nResponse: two \n", "two"),
        ("no mark", "no mark"),
        ("Response: ", "I couldn't generate a meaningful response."),
        ("Response: \t\n", "I couldn't generate a meaningful response."),
    ],
)
def test_extract_response(spark, text, answer):
    df = spark.createDataFrame([(text,)], "t string")
    assert extract_response(df, "t").first()["response"] == answer


def test_prompt_forms(spark):
    df = spark.createDataFrame([("q", "c", "r")], "query string, context string, response string")
    assert format_prompt(df).first()["prompt"] == "Query: q\nContext: c\nResponse: r"
    assert format_prompt(df, False).first()["prompt"] == "Query: q\nContext: c\nResponse: "


def test_context_and_card(spark):
    df = spark.createDataFrame(
        [("q", i, f"n{i}", "d", "c", 0.12345, {"brand": "B"} if i == 1 else {}) for i in (4, 2, 1, 3)],
        "query_id string, rank int, name string, description string, category string, "
        "score double, metadata map<string,string>",
    )
    assert result_context(df).first()["context"] == (
        "Available products:\n\n"
        "1. n1\n   Description: d\n   Category: c\n   brand: B\n\n"
        "2. n2\n   Description: d\n   Category: c\n\n"
        "3. n3\n   Description: d\n   Category: c\n\n"
    )
    cards = [r["card"] for r in result_card(df).orderBy("rank").collect()]
    assert cards[0] == "**n1**\nDescription: d\nCategory: c\nMatch Score: 12.3%\n- brand: B"
    half = result_card(df.limit(1).withColumn("score", F.lit(0.2345))).first()["card"]
    assert "Match Score: 23.5%" in half

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from stockweave.constants import MISSING_TOKENS
from stockweave.functions.ranking import positions
from stockweave.mapping import CustomColumn, SchemaMapping
from stockweave.operators import tables
from stockweave.operators.chat import canned_response, classify_utterance
from stockweave.operators.embed import hash_embed
from stockweave.operators.search import route_requests, search
from stockweave.operators.tables import (
    latest_completed,
    latest_status,
    list_page,
    lookup,
    queue_view,
    status_domain_check,
    status_with_fallback,
)
from stockweave.operators.tokens import fit_tokens, hash_split, token_stats, training_budget
from stockweave.operators.versions import (
    check_previous_version,
    latest_by_id,
    resolve_catalog,
    version_lineage,
)
from stockweave.plans.build import build_version, training_set
from stockweave.session import shared_folder
from stockweave.sources import csv_blocks
from stockweave.sources.catalog_csv import (
    export_catalog_csv,
    normalize_missing,
    read_catalog_csv,
    read_whole_csv,
)
from stockweave.sources.configs import (
    config_jobs,
    new_configs,
    parse_config_jobs,
    parse_configs,
)
from stockweave.sources.records import parse_jobs, parse_requests
from stockweave.sources.store import read_catalog_version, read_manifest, write_catalog_version

MAPPING = SchemaMapping("id", "name", "description", "category",
                        (CustomColumn("price", "price", "filter"),))
CSV = (
    'id,name,description,category,price\n'
    '1,"Say ""hi"", ok","two\nlines",A,10\n'
    "2,N/A,,B,\n"
    "3,nan,x,C,1.50\n"
    "1,dup,y,A,7\n"
)


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


@pytest.fixture()
def csv_file(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "goods.csv").write_text(CSV)
    (tmp_path / "in" / "notes.txt").write_text("not a catalogue")
    return str(tmp_path / "in")


def test_csv_quotes_newlines_and_missing_cells(spark, csv_file):
    rows = normalize_missing(read_catalog_csv(spark, csv_file)).collect()
    assert [tuple(r) for r in rows] == [
        ("1", 'Say "hi", ok', "two\nlines", "A", "10"),
        ("2", None, None, "B", None),
        ("3", None, "x", "C", "1.50"),
        ("1", "dup", "y", "A", "7"),
    ]


def test_only_csv_files(spark, csv_file):
    with pytest.raises(ValueError, match="only CSV"):
        read_catalog_csv(spark, f"{csv_file}/notes.txt")


def test_every_missing_token(spark):
    df = spark.createDataFrame([(t,) for t in (*MISSING_TOKENS, "x", "NAN", " ")], "c string")
    assert [r[0] for r in normalize_missing(df).where("c IS NOT NULL").collect()] == ["x", "NAN", " "]
    assert len(MISSING_TOKENS) == 19


def test_csv_export_round_trip(spark, folder):
    rows = [("1", ' padded "q" ', "a,b\nc"), ("2", None, "")]
    df = spark.createDataFrame(rows, "id string, name string, note string")
    export_catalog_csv(df, f"{folder}/out")
    back = {tuple(r) for r in read_catalog_csv(spark, f"{folder}/out").collect()}
    assert back == {("1", ' padded "q" ', "a,b\nc"), ("2", None, None)}


def test_build_append_and_search(spark, csv_file, folder):
    """End to end: two versions from CSV, an appended id that repeats, a search."""
    root = f"{folder}/store"
    bad = build_version(spark, csv_file, root, "1", MAPPING)
    assert [r["id"] for r in bad.collect()] == ["2", "3"]
    build_version(spark, csv_file, root, "2", MAPPING, mode="append", previous_version="1")
    products, vectors = read_catalog_version(spark, root, "2")
    assert products.count() == vectors.count() == 4
    manifest = {str(r["version"]): r for r in read_manifest(spark, root).collect()}
    assert manifest["2"]["num_samples"] == 4 and manifest["2"]["is_complete"]
    assert list(manifest["2"]["embedding_shape"]) == [4, 256]
    asked = hash_embed(spark.createDataFrame([("q", "dup y")], "query_id string, t string"), "t")
    found = search(products, vectors, asked, MAPPING, k=2, row_key="row_key",
                   filters={"category": "A", "price": [5, 9]})
    assert [(r["id"], r["name"]) for r in found.collect()] == [("1", "dup")] * 2
    with pytest.raises(Exception, match="(?i)already exists"):
        build_version(spark, csv_file, root, "2", MAPPING)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_catalog_version(spark, root, "3")


def test_incomplete_version_is_marked(spark, folder):
    products = spark.createDataFrame([("1",), ("2",)], "id string")
    vectors = spark.createDataFrame([("1", [1.0])], "id string, embedding array<float>")
    write_catalog_version(products, vectors, folder, "9")
    row = read_manifest(spark, folder).first()
    assert not row["is_complete"] and row["rows_without_vector"] == 1


def test_training_set_is_one_narrow_plan(spark, csv_file, capsys):
    catalog = normalize_missing(read_catalog_csv(spark, csv_file))
    rows = training_set(catalog, MAPPING)
    rows.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert rows.count() == 4 * 3 + 3
    assert rows.where("size(input_ids) <> 512 OR size(attention_mask) <> 512").count() == 0


def test_json_records_with_defaults_and_bad_rows(spark):
    messages = [
        '{"config_id":"1","timestamp":"t","config":{"name":"n","model_path":"m","mode":"append"}}',
        '{"config_id":"2","config":{}}', '{"co', '[1,2]', '{"timestamp":"t"}', None, "",
    ]
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    good, bad = parse_jobs(df)
    assert sorted(tuple(r) for r in good.collect()) == [
        ("1", "t", "n", "m", "append"), ("2", "unknown", "Unnamed", "unknown", "replace")]
    assert good.count() + bad.count() == len(messages)


def test_requests_keep_their_filters_as_text(spark):
    messages = ['{"query":"q"}', '{"query":"r","max_items":0,"filters":{"price":[0,1000]}}',
                '{"query":"s","max_items":3,"config_id":"1"}', '{"max_items":3}', "x"]
    good, bad = parse_requests(spark.createDataFrame([(m,) for m in messages], "message string"))
    assert {(r["query"], r["max_items"], r["filters"]) for r in good.collect()} == {
        ("q", 10, None), ("r", 10, '{"price":[0,1000]}'), ("s", 3, None)}
    assert bad.count() == 2


def test_append_by_name_keeps_every_row(spark):
    old = spark.createDataFrame([("1", 5)], "id string, size int")
    new = spark.createDataFrame([("1", "a", "7")], "id string, name string, size string")
    rows = {tuple(r) for r in resolve_catalog("append", old, new).select("id", "name", "size").collect()}
    assert rows == {("1", None, "5"), ("1", "a", "7")}
    assert resolve_catalog("replace", old, new).count() == 1
    with pytest.raises(ValueError, match="mode"):
        resolve_catalog("merge", old, new)
    assert latest_by_id(new, "id", "size").count() == 1


def test_lineage_of_chains_forks_and_unknown_bases(spark):
    n = 40
    rows = [(str(i), "append" if i else "replace", str(i - 1) if i else None, 1) for i in range(n)]
    rows += [("fork", "append", "3", 10), ("lost", "append", "gone", 5), ("r", "replace", "3", 2)]
    df = spark.createDataFrame(rows, "config_id string, mode string, previous_version string, n_rows int")
    got = {r["config_id"]: (r["root"], r["depth"], r["total_rows"]) for r in version_lineage(df).collect()}
    assert got[str(n - 1)] == ("0", n - 1, n)
    assert got["fork"] == ("0", 4, 14)
    assert got["lost"] == ("lost", 0, 5) and got["r"] == ("r", 0, 2)
    assert len(got) == len(rows)


def test_lineage_with_a_cycle_is_an_error(spark):
    df = spark.createDataFrame([("a", "append", "b", 1), ("b", "append", "a", 1)],
                               "config_id string, mode string, previous_version string, n_rows int")
    with pytest.raises(ValueError, match="cycle"):
        version_lineage(df, max_depth=8)


def test_lineage_reports_cycles_and_answers_the_rest(spark):
    """Circles of many lengths, long tails into them, a self-loop, and a long chain."""
    rows, want = [], {}
    for n in (1, 2, 7, 40):
        ring = [f"ring{n}-{i:03}" for i in range(n)]
        rows += [(c, "append", ring[i - 1], 1) for i, c in enumerate(ring)]
        want |= {c: (None, None, None, ring[0], True) for c in ring}
        tail = [f"tail{n}-{i:03}" for i in range(25)]
        rows += [(c, "append", tail[i - 1] if i else ring[n // 2], 1) for i, c in enumerate(tail)]
        want |= {c: (None, None, None, ring[0], False) for c in tail}
    chain = [f"chain{i:03}" for i in range(90)]
    rows += [(c, "append" if i else "replace", chain[i - 1] if i else None, 2)
             for i, c in enumerate(chain)]
    want |= {c: (chain[0], i, 2 * i + 2, None, False) for i, c in enumerate(chain)}
    df = spark.createDataFrame(rows, "config_id string, mode string, previous_version string, n_rows int")
    got = {r["config_id"]: tuple(r)[1:] for r in version_lineage(df, report_cycles=True).collect()}
    assert got == want
    straight = df.where("config_id LIKE 'chain%'")
    assert version_lineage(straight, report_cycles=True).where("cycle IS NOT NULL").count() == 0


TRICKY = (
    '\ufeffid,"the\nname",note\r\n'
    '1,"a, ""quoted"" one\r\nover lines",x\r\n'
    '\r\n'
    '2,"","last ""\n\n"""\r\n'
    '3,short\r\n'
    '"4","' + "long text\n" * 60 + '",é日本\r\n'
    '5,,"'
    '"\r\n'
    '6,"x"",""\n""y",z'
)


@pytest.mark.parametrize("block", [7, 16, 33, 100, 1 << 20])
def test_a_csv_file_cut_into_blocks_reads_like_a_whole_one(spark, tmp_path, block):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(TRICKY.encode())
    (tmp_path / "in" / "b.csv").write_text("note,id\n" + "".join(
        f'"n {i}\n",{i}\n' for i in range(100, 140)))
    (tmp_path / "in" / "empty.csv").write_text("")
    got = read_catalog_csv(spark, str(tmp_path / "in"), block_bytes=block)
    assert set(got.columns) == {"id", "the\nname", "note"}
    rows = {tuple(r[c] for c in ("id", "the\nname", "note")) for r in got.collect()}
    whole = csv.reader(io.StringIO(TRICKY.removeprefix("\ufeff"), newline=""))
    cells = [[c or None for c in row] + [None] for row in whole if row][1:]
    want = {tuple(row[:3]) for row in cells}
    assert ("3", "short", None) in want and len(want) == 6
    assert rows == want | {(str(i), None, f"n {i}\n") for i in range(100, 140)}
    assert got.count() == 46


@pytest.mark.parametrize("block", [9, 50, 1 << 20])
def test_blocks_and_sparks_own_reader_agree(spark, tmp_path, block):
    text = TRICKY.replace("\r\n", "\n").removeprefix("\ufeff")
    (tmp_path / "a.csv").write_text(text)
    got = read_catalog_csv(spark, str(tmp_path), block_bytes=block)
    whole = read_whole_csv(spark, str(tmp_path), got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_a_large_csv_file_is_read_by_many_tasks(spark, folder):
    rows = spark.range(3000).selectExpr(
        "cast(id AS string) AS id", "concat('line ', id, '\n\"', repeat('x, ', 20), '\n') AS note")
    export_catalog_csv(rows.coalesce(1), f"{folder}/in")
    lines = csv_blocks._lines(spark, f"{folder}/in", 1 << 14)
    assert lines.rdd.getNumPartitions() >= 10
    got = read_catalog_csv(spark, f"{folder}/in", block_bytes=1 << 14)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_unbalanced_quotes_and_long_rows_are_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.csv").write_text('id,size\n1,5" pipe\n2,x\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        read_catalog_csv(spark, str(tmp_path / "a"))
    rows = read_whole_csv(spark, str(tmp_path / "a"), ["id", "size"]).collect()
    assert [tuple(r) for r in rows] == [("1", '5" pipe'), ("2", "x")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text("id,size\n1,2,3\n")
    with pytest.raises(Exception, match="more cells than columns"):
        read_catalog_csv(spark, str(tmp_path / "b")).collect()
    with pytest.raises(ValueError, match="no CSV file"):
        (tmp_path / "c").mkdir()
        read_catalog_csv(spark, str(tmp_path / "c"))


def test_nested_config_rules_and_creation(spark):
    def record(**changes):
        base = {
            "name": "n", "mode": "replace", "data_source": {
                "type": "csv", "columns": [{"name": c, "type": "string"} for c in ("id", "title", "x")]},
            "schema_mapping": {"id_column": "id", "name_column": "title", "custom_columns": [
                {"user_column": "x", "standard_column": "size", "role": "filter"}]},
            "training_config": {"batch_size": 0, "training_params": {"lr": "0.1"}},
        }
        for path, value in changes.items():
            *heads, last = path.split("__")
            at = base
            for h in heads:
                at = at[h]
            at[last] = value
        return json.dumps(base)

    customs = "schema_mapping__custom_columns"
    given = {
        "fine": record(),
        "no type": record(data_source__type=""),
        "no id": record(schema_mapping__id_column=None),
        "role": record(**{customs: [{"user_column": "x", "standard_column": "s", "role": "no"}]}),
        "half": record(**{customs: [{"user_column": "x", "role": "filter"}]}),
        "twice": record(**{customs: [
            {"user_column": c, "standard_column": "s", "role": "filter"} for c in ("x", "id")]}),
        "unknown": record(schema_mapping__category_column="kind"),
        "needs": record(schema_mapping__required_columns=["price"]),
        "append": record(mode="append", previous_version="9"),
        "append ok": record(mode="append", previous_version="1"),
        "broken": "{", "not a record": '{"schema_mapping": 3}',
    }
    df = spark.createDataFrame(list(given.items()), "case string, record string")
    good, bad = parse_configs(df, keep=["case"])
    assert {r["case"] for r in bad.collect()} == {"broken", "not a record"}
    configs = spark.createDataFrame([("1", "completed")], "config_id string, status string")
    made, refused = new_configs(good, configs, F.lit(at(5)), F.col("case"), F.lit("f.csv"), strict=True)
    row = {r["_id"]: r for r in made.collect()}
    assert set(row) == {"fine", "append ok"}
    fine = row["fine"]
    assert (fine.version, fine.created_at) == ("20240101050000", "2024-01-01T05:00:00Z")
    assert (fine.training_config.batch_size, fine.training_config.max_tokens) == (128, 512)
    assert fine.training_config.training_params == {"lr": "0.1"}
    assert fine.data_source.location == "data/fine/f.csv" and len(fine.data_source.columns) == 3
    errors = {r["_id"]: r["error"] for r in refused.collect()}
    assert set(errors) == set(given) - {"fine", "append ok", "broken", "not a record"}
    assert errors["no type"] == "data_source.type is required"
    assert errors["append"] == "previous version not found or not completed"
    assert "name a standard column twice" in errors["twice"]
    loose, _ = new_configs(good, configs, F.lit(at(5)), F.col("case"), F.lit("f.csv"))
    assert {"role", "half", "twice", "unknown", "needs"} <= {r["_id"] for r in loose.collect()}
    jobs = config_jobs(made, F.lit("t"), keep=["_id"])
    back, lost = parse_config_jobs(jobs)
    assert lost.count() == 0
    assert {r["config_id"]: r["config"] for r in back.collect()} == {
        i: r for i, r in row.items()}


def test_append_needs_a_completed_base(spark):
    configs = spark.createDataFrame([("1", "completed"), ("2", "failed")], "config_id string, status string")
    asked = spark.createDataFrame(
        [("a", "append", "1"), ("b", "append", "2"), ("c", "append", "9"), ("d", "replace", None)],
        "config_id string, mode string, previous_version string")
    got = {r["config_id"]: r["accepted"] for r in check_previous_version(asked, configs).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}


STATUS = "event_id long, config_id string, status string, error string, progress double, ts timestamp"


def test_failure_resets_progress_and_ties_go_to_the_later_event(spark):
    events = spark.createDataFrame(
        [(1, "a", "processing", None, 50.0, at(0)), (2, "a", "failed", "boom", None, at(1)),
         (3, "b", "processing", None, 10.0, at(2)), (4, "b", "completed", None, 100.0, at(2))], STATUS)
    got = {r["config_id"]: (r["status"], r["error"], r["progress"]) for r in latest_status(events).collect()}
    assert got == {"a": ("failed", "boom", 0.0), "b": ("completed", "", 100.0)}


def test_status_fallback_order(spark):
    fresh = spark.createDataFrame(
        [("a", "processing", "", 5.0, at(30)), ("b", "failed", "old", 0.0, at(5))],
        "config_id string, status string, error string, progress double, updated_at timestamp")
    stored = spark.createDataFrame([("a", "pending", "", 0.0), ("b", "pending", "", 0.0)],
                                   "config_id string, status string, error string, progress double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "config_id string")
    got = {r["config_id"]: (r["status"], r["source"])
           for r in status_with_fallback(asked, fresh, stored, F.lit(at(40))).collect()}
    assert got == {"a": ("processing", "fresh"), "b": ("pending", "stored"), "c": ("not_found", "none")}


def test_listing_and_lookup(spark):
    df = spark.createDataFrame([(str(i), "completed" if i % 2 else "failed", at(i)) for i in range(9)],
                               "config_id string, status string, created_at timestamp")
    page = list_page(df, {"status": "completed", "mode": ""}, page=2, size=3).collect()
    assert [(r["config_id"], r["total"], r["page"]) for r in page] == [("1", 4, 2)]
    found = {r["config_id"]: r["found"] for r in lookup(df, ["3", "x", "3"]).collect()}
    assert found == {"3": True, "x": False}
    assert latest_completed(df).first()["config_id"] == "7"
    assert latest_completed(df.where("status = 'failed'")).count() == 0


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), "completed" if i % 3 else "failed", at(i // 4)) for i in range(90)],
                               "config_id string, status string, created_at timestamp")

    def page(n):
        got = list_page(df, {"status": "completed"}, page=n, size=25)
        return [(r["config_id"], r["total"], r["page"]) for r in got.collect()]

    want = [page(n) for n in (1, 2, 3)]
    assert [len(w) for w in want] == [25, 25, 10]
    monkeypatch.setattr(tables, "DEEP_ROWS", 0)
    assert [page(n) for n in (1, 2, 3)] == want


def test_queue_places_with_one_hot_queue(spark):
    rows = [(f"j{i:03}", "main" if i % 4 else "side", f"t{i // 10:03}") for i in range(200)]
    jobs = spark.createDataFrame(rows, "config_id string, queue string, timestamp string").repartition(7)
    done = spark.createDataFrame([("j001",)], "config_id string")
    got = queue_view(jobs, done).where("queue = 'main'").orderBy("position").collect()
    want = sorted((t, c) for c, q, t in rows if q == "main" and c != "j001")
    assert [(r["timestamp"], r["config_id"]) for r in got] == want
    assert [r["position"] for r in got] == list(range(1, len(want) + 1))
    assert {r["queue_length"] for r in got} == {len(want)} and got[-1]["newest"] == 1


def test_positions_without_a_key(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    got = positions(df, [F.desc("x")]).collect()
    assert all(r["position"] == 500 - r["x"] for r in got) and len(got) == 500


def test_statuses(spark):
    df = spark.createDataFrame([("queued",), ("canceled",), ("done",), (None,)], "status string")
    assert [(r["in_domain"], r["is_terminal"]) for r in status_domain_check(df).collect()] == [
        (True, False), (True, True), (False, True), (False, True)]


def test_routing(spark):
    configs = spark.createDataFrame(
        [("1", "m/1", "completed", at(1)), ("2", "m/2", "completed", at(2)), ("3", "m/3", "failed", at(3))],
        "config_id string, model_path string, status string, created_at timestamp")
    asked = spark.createDataFrame(
        [("own", "q", "1", "x/9"), ("cfg", "q", "3", None), ("new", "q", None, ""),
         ("lost", "q", "77", None), ("empty", " ", None, "x/9")],
        "query_id string, query string, config_id string, model_path string")
    got = {r["query_id"]: (r["model_path"], r["error"]) for r in route_requests(asked, configs).collect()}
    assert got == {"own": ("x/9", None), "cfg": ("m/3", None), "new": ("m/2", None),
                   "lost": ("m/2", None), "empty": (None, "query is required")}


@pytest.mark.parametrize(
    ("text", "kind", "by_word"),
    [
        ("  ", None, None),
        ("washing machine", "greeting", "search"),
        ("thanks, hello", "greeting", "greeting"),
        ("help me", "help", "help"),
        ("HELLO", "greeting", "greeting"),
        ("dishwasher for flat", "search", "search"),
        (" goodbye ", "farewell", "farewell"),
    ],
)
def test_utterances(spark, text, kind, by_word):
    df = spark.createDataFrame([(text,)], "text string")
    for boundary, want in ((False, kind), (True, by_word)):
        rows = classify_utterance(df, word_boundary=boundary).collect()
        assert [r["utterance_class"] for r in rows] == ([want] if want else [])


def test_canned_reply_is_fixed_by_the_key(spark):
    df = classify_utterance(spark.createDataFrame([("help", 1), ("bye", 2), ("lamp", 3)], "text string, k int"))
    one = {r["k"]: r["reply"] for r in canned_response(df, ["k"]).collect()}
    assert one[1].startswith("I can help you find products") and one[3] is None
    assert one == {r["k"]: r["reply"] for r in canned_response(df.repartition(3), ["k"]).collect()}


def test_token_blocks(spark):
    df = spark.createDataFrame([("a b a c",), ("",), (None,), ("a",)], "t string")
    rows = fit_tokens(df, "t", 3).collect()
    assert [r["n_tokens"] for r in rows] == [4, 0, 0, 1]
    assert [list(r["attention_mask"]) for r in rows] == [[1, 1, 1], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    assert rows[0]["input_ids"][0] == rows[0]["input_ids"][2] == rows[3]["input_ids"][0] > 0
    assert list(rows[1]["input_ids"]) == [0, 0, 0]
    stats = token_stats(df, "t", 3).first()
    assert (stats["n_over"], stats["tokens_cut"], stats["padding"]) == (1, 1, 8)


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(5000).withColumn("v", F.lit(1))
    one = hash_split(df, ["id"])
    counts = {r["split"]: r["count"] for r in one.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000 and 850 < counts["valid"] < 1150
    again = hash_split(df.repartition(9), ["id"])
    assert one.exceptAll(again).count() == 0
    assert hash_split(df, ["id"], seed=1).exceptAll(one).count() > 0


@pytest.mark.parametrize("steps", [1, 13, 10_000])
def test_budget_takes_the_first_rows_by_hash(spark, steps):
    df = spark.range(3000)
    got = training_budget(df, ["id"], batch_size=8, max_steps=steps).collect()
    n = min(3000, steps * 8)
    assert sorted(r["position"] for r in got) == list(range(1, n + 1))
    assert all(r["batch_id"] == (r["position"] - 1) // 8 for r in got)
    order = df.selectExpr("id", "md5(concat('0|', id)) AS h").orderBy("h", "id").limit(n).collect()
    assert {r["id"] for r in got} == {r["id"] for r in order}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_split_csv_is_not_written_by_one_task(spark, tmp_path, monkeypatch):
    """one task read and wrote all documents, however many there are."""
    from stockweave.queries import catalog

    text = 'a "b",\n' * 20
    rows = [(i, f"{text}{i}", "en", "s", 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    tasks, export = [], catalog.export_catalog_csv

    def watched(df, path):
        tasks.append(df.rdd.getNumPartitions())
        export(df, path)

    monkeypatch.setattr(catalog, "export_catalog_csv", watched)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    got = catalog.s1_read_split_csv(small, str(tmp_path)).select("doc_id", "text").collect()
    assert tasks[0] >= 6
    assert {r["doc_id"]: r["text"] for r in got} == {
        str(r[0]): hashlib.md5(r[1].encode()).hexdigest() for r in rows}

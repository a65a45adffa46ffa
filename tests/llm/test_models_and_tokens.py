"""Classifiers, tokens, token files, benchmark overlaps, vectors and the pipeline."""

from __future__ import annotations

import itertools
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from stockweave.llm import queries, vector_dedup
from stockweave.llm.bpe import PairIndexBpe, encode
from stockweave.llm.common import tokenizer_file
from stockweave.llm.decontaminate import MASKS, contaminated, decontaminate, find_overlaps
from stockweave.llm.labelled import held_out
from stockweave.llm.quality import N_FEATURES, estimate_prior, fit, score_quality
from stockweave.llm.token_files import (
    TokenFileReader,
    TokenFileWriter,
    fresh_token_folder,
    read_token_files,
    write_token_files,
)
from stockweave.llm.toxicity import Grammar, score_toxicity
from stockweave.llm.vector_dedup import near_vectors
from stockweave.session import fresh_folder
from tests.conftest import SF
from tests.llm import brute
from tokenizers import Tokenizer

ODD = [
    None, "", "  lead and  double ", "tab\t x\n y\n\nz ", "Héllo wörld's <|endoftext|>x Σας ΣΑΣ 3rd",
    "İstanbul ŐÓo ﬁ Å ½ ²", "a\x1cb \x1c c", "don't WE'LL it's'd 123", "a b 　 c",
    "<|startoftext|><|endoftext|> <|ENDOFTEXT|>", "é ́x", "日本語 テスト", "'s 'S 'll",
    "ſtuff Ǆ ǅ", " x  y  z", "ＡＢＣ", "\r\n\r\n  \x0b", "😀😀 👍🏽x", "a" * 3000, "x " * 300,
    "ab\u0085cd \u0085 e", "one two one two", "one two one two",
]


def texts(spark, values=ODD):
    rows = [(i if i % 7 else None, t, 5, "m") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, marks string")


def test_bpe_equals_the_library(spark):
    model = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_str(model)
    out = encode(texts(spark), model)
    assert out.columns == ["doc_id", "text", "marks", "n_tokens", "ids", "decoded"]
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode(texts(spark, []), model).collect() == []


def test_bpe_takes_overlapping_pairs_from_the_left():
    bpe = PairIndexBpe(tokenizer_file("word_bpe_49k.json"))
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    words = ["a" * n for n in range(1, 40)] + ["ha" * n for n in range(1, 20)] + ["lollollol"]
    for w, ids in zip(words, bpe.merge_words([w.encode() for w in words]), strict=True):
        assert ids.tolist() == library.encode(w, add_special_tokens=False).ids


def test_op7_over_documents(spark):
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op7_bpe(spark, SF).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == brute.sha(struct.pack(f"<{len(ids)}I", *ids))
        assert r.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_token_files(spark):
    model = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_str(model)
    files = write_token_files(texts(spark), fresh_token_folder(spark), model, frame_bytes=500)
    got = read_token_files(files).orderBy("start").collect()
    rows = [(i if i % 7 else None, t or "") for i, t in enumerate(ODD)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    start = 0
    by_id = sorted(got, key=lambda r: r.start)
    for r, (_, t) in zip(by_id, rows, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        if r.doc_id is not None:  # several rows have no id
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.start == start and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        start += r.n_tokens
    assert files.agg(F.sum("n_tokens")).first()[0] == start
    none = write_token_files(texts(spark, []), fresh_token_folder(spark), model)
    assert read_token_files(none).collect() == []


def test_op10_over_documents(spark):
    library = Tokenizer.from_str(tokenizer_file("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op10_token_files(spark, SF).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_reader_takes_only_the_frames_asked_for(tmp_path):
    path = tmp_path / "x.zst"
    writer = TokenFileWriter(path.open("wb"), frame_bytes=64)
    docs = {k: struct.pack("<20I", *range(k, k + 20)) for k in range(9)}
    for k, ids in docs.items():
        writer.add(k, ids)
    writer.close()
    import pyarrow as pa

    reader = TokenFileReader(pa.OSFile(str(path)))
    read = []
    frame = reader.frame
    reader.frame = lambda k: read.append(k) or frame(k)
    assert reader.ids(reader.docs[5]) == docs[5] and len(set(read)) == 1
    # Plain tools see the ids of all documents and skip the rest.
    plain = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True)
    assert plain.read() == b"".join(docs.values())
    data = bytearray(path.read_bytes())
    data[30] ^= 1
    path.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged = TokenFileReader(pa.OSFile(str(path)))
        [damaged.ids(d) for d in damaged.docs]


def test_masks_hit_all_windows():
    for size, wrong in ((10, 1), (11, 1), (12, 1), (13, 2)):
        for bad in itertools.combinations(range(size), wrong):
            assert any(
                not {s + o for o in m} & set(bad) for m in MASKS for s in range(size - m[-1])
            )


def test_overlaps(spark):
    item = [f"tok{k}" for k in range(30)]
    short = [f"few{k}" for k in range(11)]

    def with_(positions, words=item):
        return " ".join("other" if k in positions else w for k, w in enumerate(words))

    docs = [
        (1, "before " + " ".join(item).upper() + ", after!"), (2, with_({4, 9})),
        (3, with_(set(range(0, 30, 3)))), (4, with_({3}, short)), (5, with_({3, 7}, short)),
        (6, None), (7, ""), (8, " ".join(item[5:18])), (9, " ".join(item[5:17])),
        (8, " ".join(item[5:18])), (None, " ".join(item)), (10, "x " * 5000 + " ".join(short)),
        (11, "a b c d e f g h i"),
    ]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "a b c d e f g h i"),
             (None, "x " * 20), (1, " ".join(item))]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in docs if i is not None]
    got = find_overlaps(df, bench).collect()
    want = brute.overlaps(known, [x for x in items if x[0] is not None])
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    bad = {i for i, _ in want}
    assert bad == {1, 2, 4, 8, 9, 10, 11}
    assert {r.doc_id for r in contaminated(df, bench).collect()} == bad
    left = decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(
        str(i) for i, _ in docs if i not in bad
    )
    empty = bench.limit(0)
    assert contaminated(df, empty).collect() == [] == contaminated(df.limit(0), bench).collect()


def test_short_items_are_sought_whole(spark):
    items = [(1, "One two three four five six seven"), (2, "日本語のベンチマーク"), (3, "x"), (4, " . "),
             (5, "a b"), (6, "a b")]
    docs = [
        (1, "so: one, two THREE four five six seven!"), (2, "one two three four nine six seven"),
        (3, "これは 日本語のベンチマーク です"), (4, "x"), (5, "xx y b a"), (6, "b a b c"), (7, "..."),
        (8, "one two three four five six"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "key long, text string")
    found = find_overlaps(df, bench, item_id="key").collect()
    want = brute.overlaps(docs, items)
    assert sorted((r.doc_id, r.key) for r in found) == sorted(want)
    assert {i for i, _ in want} == {1, 3, 4, 6}
    rows = contaminated(df, bench, item_id="key").collect()
    assert {r.doc_id: list(r.item_ids) for r in rows}[6] == [5, 6]


def test_a_document_is_cut_into_tokens_once(spark):
    """No text is split inside a lambda, where it would be split for every element."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = find_overlaps(df, bench)._jdf.queryExecution().optimizedPlan().toString()
    bodies = re.findall(r"lambdafunction\((.*)", plan)
    assert bodies and not any("split(" in b for b in bodies)


def test_token_files_are_read_by_many_tasks(spark):
    model = tokenizer_file("byte_bpe_50k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_token_files(
            spark.read.parquet(f"{SF}/documents.parquet"), fresh_token_folder(spark), model)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = files.count()
    assert n > 1
    got = read_token_files(files, digests_only=True)
    per_task = got.groupBy(F.spark_partition_id()).count().count()
    assert per_task == n and got.rdd.getNumPartitions() == n


@pytest.mark.parametrize(
    "name, label, least", [("op4_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.94)]
)
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    scores = queries.all_queries()[name](spark, folder)
    assert scores.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    rows = scores.where("held_out").join(known, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


@pytest.mark.parametrize("operator, label", [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_scores_of_odd_rows(spark, operator, label):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (99, 1)], f"doc_id long, {label} int"
    )
    df = texts(spark).withColumnRenamed("ids", "score")
    out = operator(df, labels)
    assert out.columns == ["doc_id", "text", "marks", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert operator(df.limit(0), labels).collect() == []
    assert operator(df, labels.limit(0)).count() == len(ODD)


def test_fold(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(3)
    shift = np.zeros(N_FEATURES)
    shift[:4] = 3
    positive = rng.normal(0, 1, (1500, N_FEATURES)) + shift
    mixed = rng.normal(0, 1, (2000, N_FEATURES))
    good = rng.random(2000) < 0.7
    mixed[good] += shift
    assert abs(estimate_prior(positive, mixed) - 0.7) < 0.05
    net, prior = fit(positive, mixed)
    assert abs(prior - 0.7) < 0.05
    assert ((net.probability(mixed) >= 0.5) == good).mean() > 0.97


def test_grammar_reads_clauses():
    grammar = Grammar({"blork": "J"})
    read = lambda t: [w for c in grammar.clauses(t) for w in c]
    assert read("You are an idiot.") == ["clause", "aimed"]
    assert read("It was the idiot") == ["clause"]
    assert read("You are not an idiot") == ["negated"]
    assert read("She said he is an idiot") == ["reported"]
    assert read("I will kill you") == ["threat"]
    assert read("I will kill the lights") == []
    assert read("An idiot. A moron, a clown!") == ["clause", "clause", "more"]
    assert read("such blorkish things") == ["likely"]
    assert read("idiotic scumbags are unrelated words") == []


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows, k = [], 0
    for b in base:
        for _ in range(6):
            rows.append((k, (b + rng.normal(0, 0.12, 16)).tolist(), int(k % 3), "x"))
            k += 1
    rows += [(k + i, base[0].tolist(), 0, "x") for i in range(5)]
    rows += [(500, None, 0, "x"), (501, [0.0] * 16, 0, "x"), (502, [float("nan")] * 16, 0, "x"),
             (503, [None] * 16, 0, "x"), (504, base[0].tolist(), None, "x"),
             (505, [1.0, 0.0], 0, "x"), (506, [float("inf")] * 16, 0, "x"),
             (507, (base[0] * 1e200).tolist(), 0, "x"), (508, [], 0, "x")]
    df = spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int, component_id string"
    )
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    links = {i: set() for i, *_ in rows}
    fine = {}
    for i, x, label, _ in rows:
        if x and label is not None and None not in x and np.isfinite(x).all() and any(x):
            x = np.array(x) / max(map(abs, x))
            fine[i] = (label, x / np.linalg.norm(x))
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(fine.items(), 2):
        if a == b and len(x) == len(y) and x @ y >= 0.93:
            links[i].add(j)
            links[j].add(i)
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        r = got[i]
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), min(reach), i == min(reach))
    assert near_vectors(df.limit(0)).collect() == []


def test_vectors_over_many_shards(spark, monkeypatch):
    # Small shards: several levels of cells, overlapping, one group of near copies.
    monkeypatch.setattr(vector_dedup, "SHARD", 40)
    monkeypatch.setattr(vector_dedup, "FAN", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[:200] = x[0] + rng.normal(0, 0.03, (200, 16))
    df = spark.createDataFrame(
        [(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"
    )
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    found = sum(min(got[i], int(near[i].sum())) for i in got)
    assert found >= 0.9 * near.sum()
    assert all(got[i] <= near[i].sum() for i in got)


def test_vectors_of_a_large_ball(spark, monkeypatch):
    # One ball of ten shards, at the usual fan: cells cut most of its links.
    monkeypatch.setattr(vector_dedup, "SHARD", 40)
    monkeypatch.setattr(vector_dedup, "EXACT", 90)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(440, 16))
    x[:400] = x[0] + rng.normal(0, 0.12, (400, 16))
    df = spark.createDataFrame(
        [(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"
    )
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.where(near, root[None], root[:, None]).min(axis=1)
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}


def linked(x, least=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def vectors_of(spark, x):
    return spark.createDataFrame(
        [(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_a_small_ball_that_cells_would_cut(spark, monkeypatch):
    """A ball of 300 among 2,100 others, far from the final audit, which is turned off."""
    monkeypatch.setattr(vector_dedup, "SHARD", 40)
    monkeypatch.setattr(vector_dedup, "audit", lambda *a: 1.0)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 16))
    x[1000:1300] = x[0] + rng.normal(0, 0.12, (300, 16))
    near = linked(x)
    rows = near_vectors(vectors_of(spark, x)).collect()
    got = {r.vec_id: r.n_links for r in rows}
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.97 * near.sum()
    assert len({r.component_id for r in rows if 1000 <= r.vec_id < 1300}) == 1


def test_a_ball_of_ten_shards_with_the_usual_constants(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "audit", lambda *a: 1.0)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12_000, 8))
    x[:10_000] = x[0] + rng.normal(0, 0.2, (10_000, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = sum(int((u[k : k + 1000] @ u.T >= 0.93).sum()) for k in range(0, len(u), 1000)) - len(u)
    rows = near_vectors(vectors_of(spark, x)).collect()
    assert 0.97 * true <= sum(r.n_links for r in rows) <= true


def test_parallel_vectors_are_counted_exactly(spark, monkeypatch):
    """Scaled copies of a few vectors: no cut parts them, other cells are cut all the same."""
    monkeypatch.setattr(vector_dedup, "SHARD", 20)
    monkeypatch.setattr(vector_dedup, "EXACT", 50)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(500, 16))
    x[:300] = x[0] * 2.0 ** (np.arange(300)[:, None] % 150 - 75)
    near = linked(x)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors_of(spark, x)).collect()}
    assert all(got[i] == (299, 0) for i in range(300))
    assert all(got[i][0] == near[i].sum() for i in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    state = docs
    plain = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_folder(spark, "test-stage")
        stage(spark, state, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scored = score_toxicity(docs, labels).where("predicted = 1").collect()
            plain = [(i, t) for i, t in plain if i not in {r.doc_id for r in scored}]
        elif name == "line_dedup":
            plain = [(i, t) for i, _, _, t in brute.lines(plain)]
        elif name == "near_dedup":
            kept = set(brute.classes(plain).values())
            plain = [(i, t) for i, t in plain if i in kept]
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
                     .select("item_id", "text").collect()]
            bad = {i for i, _ in brute.overlaps(plain, items)}
            plain = [(i, t) for i, t in plain if i not in bad]
        if name != "bpe":
            assert out.columns == docs.columns
            assert sorted((r.doc_id, r.text) for r in out.collect()) == plain
        state = out
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in plain}
    assert {r.doc_id: r.n_tokens for r in state.collect()} == {i: len(x) for i, x in want.items()}
    run = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {tuple(r) for r in state.collect()}

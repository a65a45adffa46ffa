"""Line, word-run and byte-string dedup and near-duplicates against plain versions."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from stockweave.llm import line_dedup, minhash, queries, suffix_dedup
from stockweave.llm.hashing import mix
from stockweave.llm.line_dedup import dedup_lines
from stockweave.llm.minhash import (
    drop_near_duplicates,
    near_duplicates,
    overlap,
    overlaps,
    signatures,
)
from stockweave.llm.substring_dedup import COVER, PERIOD, dedup_runs, difference_cover
from stockweave.llm.suffix_array import suffix_array
from stockweave.llm.suffix_dedup import remove_repeats
from tests.conftest import SF
from tests.llm import brute

LINE = "this line is found in many documents"
SCHEMA = "doc_id long, text string, key string, n_lines long, p int, `odd.name` int"


def table(spark, docs, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "k", 7, 1, 2) for i, t in docs], schema)


def words(seed, n, alphabet=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(alphabet)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    passage = " ".join(words(1, 60))
    near = words(2, 120)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefg \n") for _ in range(400))
    out = [
        (1, None), (2, ""), (3, "   \t\n\n"), (4, f"a\n{LINE}\nb"), (5, f"  {LINE.upper()}\t\nc"),
        (6, f"{LINE}\n{LINE}\nx\n"), (7, f"y\n{LINE}"), (7, f"y\n{LINE}"), (8, "short\nshort"),
        (9, "short"), (10, "short"), (11, passage + " tail"), (12, "head " + passage),
        (13, " ".join(words(3, 34))), (14, " ".join(words(3, 34))), (15, "same " * 90),
        (16, " ".join(near)), (17, " ".join([*near[:60], "changed", *near[61:]])),
        (18, " ".join(near).upper()), (19, " ".join(words(9, 150))),
        (20, text), (21, "x" + text[50:260] + "yy" + text[100:350]), (22, "é" * 200),
        (23, "z" + "é" * 120), (24, "a" * 700), (25, "b" + "a" * 350 + "c"), (26, text[:99]),
        (27, text[:100]), (28, text[:101]), (29, "日本語のテキスト。" * 40), (30, "ab" * 300),
        (None, text[10:200]), (None, f"{LINE}"), (None, "a" * 150), (31, f"{LINE}\n" * 3),
        (32, "long " * 4000 + passage),
    ]
    rng = random.Random(5)
    for k in range(40):  # one common passage with other bytes around it
        a, b = ("".join(rng.choice("xyz") for _ in range(30)) for _ in range(2))
        out.append((100 + k, a + text[120:240] + b))
    return out


def clean(row, names):
    return tuple(bytes(row[n]) if isinstance(row[n], bytearray) else row[n] for n in names)


def same(got, names, want):
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    assert sorted([clean(r, names) for r in got], key=key) == sorted(want, key=key)


def test_lines(spark, docs):
    out = dedup_lines(table(spark, docs))
    assert {"key", "p", "odd.name"} <= set(out.columns)
    same(out.collect(), ["doc_id", "n_lines", "n_dropped", "text"], brute.lines(docs))


def test_runs(spark, docs):
    out = dedup_runs(table(spark, docs))
    assert {"key", "p", "odd.name", "n_lines"} <= set(out.columns)
    same(out.collect(), ["doc_id", "n_words", "n_removed", "text"], brute.runs(docs))


@pytest.mark.parametrize("hot", [16, 0])
def test_strings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
    out = remove_repeats(table(spark, docs))
    assert {"key", "p", "odd.name", "n_lines"} <= set(out.columns)
    same(
        out.collect(), ["doc_id", "n_bytes", "n_removed", "n_spans", "text"], brute.strings(docs)
    )


def test_op2_over_documents(spark):
    got = queries.op2_suffix_dedup(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text").collect()]
    want = [(*r[:4], brute.sha(r[4])) for r in brute.strings(docs)]
    same(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], want)


def test_near_duplicates(spark, docs):
    # Rows of one id are one document, so the plain version takes distinct ids.
    known = list({i: (i, t) for i, t in docs if i is not None}.values())
    got = near_duplicates(table(spark, docs)).collect()
    want = brute.classes(known)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert len(got) == len(known) + 3
    kept = drop_near_duplicates(table(spark, docs))
    assert kept.columns == table(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {*want.values(), None}


def test_op6_over_documents(spark):
    got = {r.doc_id: r.class_id for r in queries.op6_minhash(spark, SF).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text").collect()]
    assert got == brute.classes(docs)


def test_large_bucket(spark):
    # More copies of one base than a bucket compares pair by pair; they are close to
    # the base and not to each other, and the base is not the first of them.
    base = words(6, 300)
    docs = [(500, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in random.Random(k).sample(range(300), 5):
            w[j] = f"new{k}"
        docs.append((k if k < 30 else 1000 + k, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute.classes(docs)


def test_overlaps():
    rng = np.random.default_rng(3)
    bags = []
    for k in range(60):
        u, n = np.unique(rng.integers(0, 30, 5 + k).astype(np.uint64), return_counts=True)
        bags.append((u, n if k % 2 else np.ones_like(n)))
    bags.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = overlaps(bags[:20], bags[20:])
    for i, j in itertools.product(range(20), range(41)):
        a, b = (dict(zip(*map(np.ndarray.tolist, x), strict=True)) for x in (bags[i], bags[20 + j]))
        assert got[i, j] == sum(min(n, b.get(e, 0)) for e, n in a.items())


def hot_family(n=300):
    """Texts around one base in a ring, each near (0.8) to the two beside it only."""
    base = words(11, 200, 10**6)
    places = [random.Random(k).sample(range(2, 198), 2) for k in range(n)]
    docs = []
    for k in range(n):
        w = list(base)
        for mark in (k, (k + 1) % n):
            for j in places[mark]:
                w[j] = f"mark{mark}"
        docs.append((k * 7 % n, " ".join(w)))
    return docs


def test_hot_family(spark, monkeypatch):
    # Links around a similarity of 0.8 in large buckets, most of them not to a centre.
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 5)
    docs = hot_family()
    bags = [brute.bag(t) for _, t in docs]
    assert all(brute.similarity(a, b) >= 0.8 for a, b in zip(bags, bags[1:]))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    found, true = [], []
    for k in range(40):
        a = rng.integers(0, 40, 60) + 1000 * k
        b = np.concatenate([a[:40], rng.integers(0, 60, 20) + 1000 * k])
        bags = []
        for x in (a, b):
            u, n = np.unique(x, return_counts=True)
            h = mix(u.astype(np.uint64))
            order = np.argsort(h)
            bags.append((h[order], 3 * n[order]))
        s = signatures(bags, 512)
        found.append((s[0] == s[1]).mean())
        true.append(overlap(*bags))
    assert abs(np.mean(found) - np.mean(true)) < 0.01


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 24))]
        assert suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_cover():
    assert len({(a - b) % PERIOD for a in COVER for b in COVER}) == PERIOD
    assert len(difference_cover(13)) == 4
    for a, b in itertools.product(range(13), repeat=2):
        assert any({(a + d) % 13, (b + d) % 13} <= set(difference_cover(13)) for d in range(13))


@pytest.mark.parametrize("operator", [dedup_lines, dedup_runs, remove_repeats, near_duplicates])
def test_empty_table(spark, operator):
    assert operator(table(spark, [])).collect() == []
    assert len(operator(table(spark, [(1, None)])).collect()) == 1


@pytest.mark.parametrize("module", ["line_dedup", "decontaminate"])
def test_native_modules_have_no_python_code_in_tasks(module):
    source = Path(queries.__file__).with_name(f"{module}.py").read_text()
    for word in ("pandas", "pyarrow", "InArrow", "InPandas", ".rdd", "udf"):
        assert word not in source


def test_a_hot_line_is_split(spark, monkeypatch):
    """Where the keys are too many to send, the join splits the places of a hot line."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 20_000, 1, 8).selectExpr(
            "id AS doc_id", f"concat('{LINE}', '\\n', 'the line of document ', id) AS text")
        kept = dedup_lines(docs)
        frame = kept.agg({"n_dropped": "sum"})
        assert frame.collect()[0][0] == 19_999
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_every_text_of_a_repeated_id_is_linked(spark):
    rng = random.Random(11)
    base = [words(100 + k, 80) for k in range(6)]
    changed = lambda w: " ".join([*w[:40], "other", *w[41:]])
    docs = [(1, " ".join(base[0])), (1, " ".join(base[1])), (1, " ".join(base[1])), (2, changed(base[1])),
            (3, changed(base[0])), (4, " ".join(base[2])), (4, " ".join(base[3])), (5, " ".join(base[4])),
            (5, None), (6, ""), (7, changed(base[3])), (8, changed(base[5])), (None, "x")]
    rng.shuffle(docs)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 4, 8: 8}
    for kind, name in (("long", int), ("string", str)):
        df = spark.createDataFrame(
            [(None if i is None else name(i), t) for i, t in docs], f"doc_id {kind}, text string")
        rows = [r for r in near_duplicates(df).collect() if r.doc_id is not None]
        assert {r.doc_id: r.class_id for r in rows} == {name(i): name(c) for i, c in want.items()}
        assert len(rows) == 8
        assert {r.doc_id: r.n_class for r in rows}[name(1)] == 3

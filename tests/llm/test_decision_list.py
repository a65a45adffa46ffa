"""Quality rules against plain counts, planted classes and held-out labels."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from stockweave.llm import decision_list, queries
from stockweave.llm.decision_list import (
    BASE,
    STATISTICS,
    keep_by_rules,
    learn_rules,
    quality_rules,
    with_statistics,
)
from tests.conftest import SF

BLANK = "[\x20\x09-\x0d]"
SCHEMA = "doc_id long, text string, n_words long, rule string, quality int, kept string"


def table(spark, docs, schema=SCHEMA):
    return spark.createDataFrame([(i, t, 7, "r", 1, "k") for i, t in docs], schema)


def plain(text):
    """The counts of the contract, and whether the base rule fails."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, again = {}, set()
    for i, w in enumerate(windows):
        if w in seen:
            again |= {*range(i, i + 5), *range(seen[w], seen[w] + 5)}
        seen.setdefault(w, i)
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n,
    )


def texts():
    rng = random.Random(1)
    out = [None, "", "   ", "\n\t\n", "a", "a b c d", "a b c d e", " a a a a a a a ", "x\n\nx\nx \n"]
    out += ["#*$%&|<> é日本 \U0001f600 ß", "    a\u0085b", "a b c d e\na b c d e f"]
    out += ["p q r s t u p q r s t v p q r s t", "same " * 400, "line one\r\nline one\r\n" * 3]
    for n in (30, 200, 3000):
        out.append(" ".join(rng.choice(["aa", "b", "ccc", "d."]) for _ in range(n)))
        out.append("".join(rng.choice("ab \n\t|#É7!") for _ in range(n)))
    out.append(" ".join(f"w{rng.randrange(300)}" for _ in range(20_000)))
    return out


def test_counts(spark):
    docs = list(enumerate(texts()))
    counted = with_statistics(table(spark, docs), [F.col("doc_id")]).withColumn(
        "base_failed", decision_list.base_failed()
    )
    got = {r.doc_id: tuple(r[c] for c in (*BASE, "base_failed")) for r in counted.collect()}
    assert got == {i: plain(t) for i, t in docs}


def test_counts_of_whole_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = queries.op12_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: tuple(r[c] for c in (*BASE, "base_failed")) for r in got}
    assert by_id == {i: plain(t) for i, t in docs}
    assert all(not r.kept for r in got if r.base_failed)
    assert all(r.kept == (not r.base_failed and r.rule == 0) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def planted(n=900):
    """Clean texts, shouted ones, and ones with many marks but few capitals."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 6) + str(k) for k in range(30)]
        rng.shuffle(words)
        kind = i % 6
        if kind == 4:
            words = [w.upper() for w in words]
        elif kind == 5:
            words = [w + "!" for w in words]
        elif kind == 3:  # some of both, and fine
            words = [w.upper() if k % 5 == 0 else w + "!" if k % 7 == 0 else w
                     for k, w in enumerate(words)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind < 4)))
    return docs, labels


def test_rules_find_planted_classes(spark):
    docs, labels = planted()
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    df = table(spark, docs)
    counts = with_statistics(df, [F.col("doc_id")])
    learnt = learn_rules(counts, labels)
    about = {c.ratio for r in learnt.rules for c in r.conditions}
    assert len(learnt.rules) == 2
    assert about == {"upper case of characters", "marks per word"}
    assert all(r.misses == 0 and r.hits > 20 for r in learnt.rules)
    want = {i for i, _ in docs if i % 6 < 4}
    out = quality_rules(df, labels).collect()
    assert {r.doc_id for r in out if r.kept} == want
    kept = keep_by_rules(df, learnt)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == sorted(
        (i, t, 7, "r", 1, "k") for i, t in docs if i in want)


def test_conjunctions_are_grown_and_pruned(spark):
    """Shouting is fine in short texts only: one condition does not do."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1200):
        long, loud = rng.random() < 0.5, rng.random() < 0.5
        words = [f"{rng.choice('abcde')}{k}word" for k in range(60 if long else 20)]
        docs.append((i, " ".join(w.upper() if loud else w for w in words)))
        labels.append((i, int(not (long and loud))))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    counts = with_statistics(table(spark, docs), [F.col("doc_id")])
    learnt = learn_rules(counts, labels)
    assert len(learnt.rules) == 1
    assert len(learnt.rules[0].conditions) == 2
    bad = {r.doc_id for r in counts.where(learnt.first() > 0).collect()}
    assert bad == {r.doc_id for r in labels.where("quality = 0").collect()}


def test_labels_that_say_nothing_give_no_rule(spark):
    docs, _ = planted(300)
    rng = random.Random(6)
    labels = spark.createDataFrame(
        [(i, rng.randrange(2)) for i, _ in docs], "doc_id long, quality int")
    out = quality_rules(table(spark, docs), labels).collect()
    assert all(r.rule == 0 for r in out)


@pytest.mark.parametrize("labels", [[], [(None, 0)], [(1, None)], [(0, 0), (0, 1), (99, 0)]])
def test_no_labels(spark, labels):
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = [(0, "a b c"), (0, "a b c"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (2, None)]
    out = quality_rules(table(spark, docs), labels).orderBy("n_words").collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept, r.rule) for r in out] == [
        (2, 0, True, False, 0), (0, 3, True, False, 0), (0, 3, True, False, 0),
        (None, 10, False, True, 0)]
    assert quality_rules(table(spark, []), labels).collect() == []


def test_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op12_quality_rules(spark, sf).join(labels, "doc_id").where("held_out").collect()
    judged = [r for r in rows if not r.base_failed]
    clean = [r for r in judged if r.quality == 1]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    low = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in low) >= 0.9 * len(low)


def test_plan_is_native(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = with_statistics(df, [F.col("doc_id")])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert STATISTICS == tuple(with_statistics(df, []).columns)

"""MinHash near-dedup of weighted shingles by BagMinHash.

Every shingle carries a Poisson process of points over its weights: bands of
weights (0,1], (1,2], (2,4], (4,8] ... each have a process of their own, and a
point falls on one unit of its band, so a document whose weight covers the unit
sees it and one of a smaller weight does not. A component of the signature is the
earliest point seen; two documents agree there with the probability of their
weighted Jaccard similarity. Bands of components give candidates, and the
multisets themselves decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.functions.ranking import positions
from stockweave.llm.components import components
from stockweave.llm.hashing import U, mix, runs, word_hashes
from stockweave.session import BROADCAST_ROWS, written, written_and_counted

WORDS = 5
SIMILARITY = 0.8

# 32 bands of 4: a pair of similarity 0.8 shares none with probability 5e-8.
BANDS, ROWS = 32, 4

# Up to this many texts in a bucket, all pairs are candidates; in larger ones,
# each text is compared with so many of the bucket's best connected texts first,
# and then with all texts of the bucket that this has not put into its class.
SMALL, CENTRES = 32, 3

# Texts of a large bucket, and their shingles, that a task compares with as many
# others; places in the dense rows that are multiplied at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, WIDTH = 500, 200_000, 2048

# Texts read, and shingles whose processes are followed, at a time.
SLICE, CHUNK = 250, 200_000


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words (all words, if there are fewer) and their counts."""
    hashes = word_hashes(text.lower())
    if not len(hashes):
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.unique(runs(hashes, min(words, len(hashes))), return_counts=True)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / max(1, a[1].sum() + b[1].sum() - shared))


def overlaps(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """The sum of the lesser weights of each multiset of ``left`` and each of ``right``."""
    out = np.zeros((len(left), len(right)))
    elements = [np.concatenate([b[0] for b in bags]) for bags in (left, right)]
    both = np.intersect1d(*elements)
    if not len(both):
        return out
    sides, most = [], []
    for bags, element in zip((left, right), elements, strict=True):
        row = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        weight = np.concatenate([b[1] for b in bags])
        at = np.minimum(np.searchsorted(both, element), len(both) - 1)
        there = both[at] == element
        row, at, weight = row[there], at[there], weight[there]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order], weight[order]))
        most.append(np.maximum.reduceat(weight[order], np.flatnonzero(np.diff(at[order], prepend=-1))))
    # Where one side has weights of 1 only, the lesser weight is 1: a product counts them.
    heavy = (most[0] > 1) & (most[1] > 1)
    place = np.cumsum(~heavy) - 1
    light = []
    for row, at, _ in sides:
        light.append((row[~heavy[at]], place[at[~heavy[at]]]))
    for k in range(0, int((~heavy).sum()), WIDTH):
        dense = []
        for bags, (row, at) in zip((left, right), light, strict=True):
            i, j = np.searchsorted(at, [k, k + WIDTH])
            block = np.zeros((len(bags), WIDTH), np.float32)
            block[row[i:j], at[i:j] - k] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    for t in np.flatnonzero(heavy).tolist():
        (i, v), (j, w) = (
            (row[a:b], weight[a:b])
            for row, at, weight in sides
            for a, b in [np.searchsorted(at, [t, t + 1])]
        )
        out[np.ix_(i, j)] += np.minimum.outer(v, w)
    return out


def _draw(seed: np.ndarray, step: int, kind: int) -> np.ndarray:
    return mix(seed + U((4 * step + kind) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The earliest point of each component, one row per bag (inf for empty bags)."""
    out = np.full((len(bags), size), np.inf)
    if not any(len(b[0]) for b in bags):
        return out
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    element = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags])
    seeds, docs, lengths, reach = [], [], [], []
    low, length, level = 0, 1, 0
    while len(doc):
        inside = weight > low
        doc, element, weight = doc[inside], element[inside], weight[inside]
        seeds.append(mix(element + U(level * 0xA0761D6478BD642F & (1 << 64) - 1)))
        docs.append(doc)
        lengths.append(np.full(len(doc), length))
        reach.append(np.minimum(weight - low, length))
        low, length, level = low + length, max(1, low + length), level + 1
    seed, doc = np.concatenate(seeds), np.concatenate(docs)
    length, reach = np.concatenate(lengths), np.concatenate(reach)
    time, step = np.zeros(len(seed)), 0
    flat = out.reshape(-1)
    while len(seed):
        step += 1
        wait = -np.log(((_draw(seed, step, 0) >> U(11)).astype(float) + 0.5) * 2.0**-53)
        time = time + wait / (length * size)
        unit = _draw(seed, step, 1) % length.astype(U)
        seen = unit < reach.astype(U)
        place = doc * size + (_draw(seed, step, 2) % U(size)).astype(np.int64)
        np.minimum.at(flat, place[seen], time[seen])
        # A process that has passed the latest component can change nothing more.
        on = time < out.max(axis=1)[doc]
        seed, doc, length, reach, time = seed[on], doc[on], length[on], reach[on], time[on]
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band; the band's number is hashed along."""
    bits = np.ascontiguousarray(signature).view(U).reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=U), bits.shape[:2])
    for k in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def _sign(texts: list[bytes], words: int, bands: int, rows: int):
    bags = [shingles(t, words) for t in texts]
    out, at = [], 0
    while at < len(bags):
        n, to = 0, at
        while to < len(bags) and (n == 0 or n + len(bags[to][0]) <= CHUNK):
            n += len(bags[to][0]) + 1
            to += 1
        out.append(band_hashes(signatures(bags[at:to], bands * rows), bands, rows))
        at = to
    return [len(b[0]) for b in bags], np.concatenate(out) if out else np.zeros((0, bands))


def signed(
    df: DataFrame, text: str, doc_id: str, words: int, bands: int, rows: int
) -> DataFrame:
    """doc, key (of the words in lower case) and band hashes of each text."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for part in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            found = part.column(1).cast(pa.string()).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in found]
            keys = [hashlib.md5(b" ".join(t.lower().split())).digest() for t in texts]
            n, hashes = _sign(texts, words, bands, rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(hashes.reshape(-1)), bands)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(n, pa.int64()),
                    lists.cast(pa.list_(pa.int64())),
                ],
                names=["doc", "key", "n", "bands"],
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, key binary, n long, bands array<long>")


def _candidates(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of texts to compare, and the members of the large buckets."""
    members = heads.where("n > 0").select("doc", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(members.join(sizes, "bucket"), "buckets")
    small = members.where(F.col("size") <= SMALL)
    pairs = small.select("bucket", F.col("doc").alias("a")).join(
        small.select("bucket", F.col("doc").alias("b")), "bucket"
    ).where("a < b").select("a", "b")
    # The texts that meet most others are compared with all of a large bucket. The
    # ranking cuts each task's rows before the shuffle.
    large = members.where(F.col("size") > SMALL)
    return pairs.union(_starred(large, members, "bucket", CENTRES)).distinct(), large


def _starred(rows: DataFrame, members: DataFrame, bucket: str, n: int) -> DataFrame:
    """Pairs of each text with the ``n`` texts of its bucket that meet most others."""
    met = members.groupBy("doc").agg(F.sum("size").alias("met"))
    rank = Window.partitionBy(bucket).orderBy(F.desc("met"), "doc")
    centres = (
        rows.join(met, "doc")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= n)
        .select(bucket, F.col("doc").alias("centre"))
    )
    return rows.join(centres, bucket).where("doc != centre").select(
        F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")
    )


def _blocks(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Texts of large buckets, dealt into blocks that meet: bucket, q, d, asks, doc, class.

    A bucket's largest class so far is not compared with itself. The texts of the
    others ask all texts of the bucket: (q, d) is a block of those that ask and one
    of all.
    """
    rows = large.join(roots, F.col("doc") == F.col("node"), "left").select(
        "bucket", "doc", "n", F.coalesce("root", "doc").alias("class")
    )
    rows = written(rows, "large-buckets")
    classes = rows.groupBy("bucket", "class").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles")
    )
    whole = classes.groupBy("bucket").agg(
        F.max(F.struct("texts", "class", "shingles")).alias("main"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("texts").alias("texts"),
        F.sum("shingles").alias("shingles"),
    )

    def parts(texts, shingles):
        return F.ceil(F.greatest(texts / BLOCK_TEXTS, shingles / BLOCK_SHINGLES)).cast("int")

    cut = whole.where("classes > 1").select(
        "bucket",
        F.col("main.class").alias("main"),
        parts(F.col("texts") - F.col("main.texts"), F.col("shingles") - F.col("main.shingles"))
        .alias("n_q"),
        parts(F.col("texts"), F.col("shingles")).alias("n_d"),
    )
    cut, n = written_and_counted(cut, "cut-buckets")
    rows = rows.join(F.broadcast(cut) if n <= BROADCAST_ROWS else cut, "bucket")
    own = lambda n: F.pmod(F.xxhash64("doc", "bucket"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    offered = rows.select(
        "bucket", each(F.col("n_q")).alias("q"), own(F.col("n_d")).alias("d"),
        F.lit(False).alias("asks"), "doc", "class",
    )
    asking = rows.where(F.col("class") != F.col("main")).select(
        "bucket", own(F.col("n_q")).alias("q"), each(F.col("n_d")).alias("d"),
        F.lit(True).alias("asks"), "doc", "class",
    )
    return offered.union(asking)


def _rest(
    df: DataFrame, large: DataFrame, roots: DataFrame, text: str, doc_id: str, words: int,
    least: float,
) -> DataFrame:
    """Links (a, b) between texts of a large bucket whose classes differ so far.

    Blocks are compared inside tasks, and of the links of two blocks only as many
    are returned as join the same texts.
    """
    rows, _ = written_and_counted(_blocks(large, roots), "blocks")
    texts = _texts(df, rows.select("doc").distinct(), text, doc_id)
    rows = rows.join(texts, "doc").select("bucket", "q", "d", "asks", "doc", "class", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("asks")
        doc, asks = table.column("doc").combine_chunks(), table.column("asks").to_pylist()
        kind = table.column("class").combine_chunks().dictionary_encode().indices.to_numpy()
        bags = [shingles(t or b"", words) for t in table.column("text").cast(pa.binary()).to_pylist()]
        n = asks.count(False)
        if not 0 < n < len(bags):
            return pa.table([doc[:0], doc[:0]], names=["a", "b"])
        shared = overlaps(bags[n:], bags[:n])
        total = np.array([b[1].sum() for b in bags])
        every = np.maximum(1, total[n:, None] + total[None, :n] - shared)
        i, j = np.nonzero((shared / every >= least - 1e-12) & (kind[n:, None] != kind[None, :n]))
        i += n
        # The least place that links reach inside the blocks.
        root = np.arange(len(bags))
        changed = True
        while changed:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            changed = (root != before).any()
        linked = np.flatnonzero(root != np.arange(len(bags)))
        return pa.table(
            [doc.take(pa.array(linked)), doc.take(pa.array(root[linked]))], names=["a", "b"]
        )

    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.groupBy("bucket", "q", "d").applyInArrow(run, f"a {kind}, b {kind}")
    return written(found.where("a != b"), "more-links")


def _texts(df: DataFrame, ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc and text of the documents of ``ids``."""
    ids, n = written_and_counted(ids, "ids")
    texts = df.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "doc", "left_semi"
    )
    # Rows that share an id have the same text here.
    return texts.groupBy("doc").agg(F.min("text").alias("text"))


def _verified(
    df: DataFrame, pairs: DataFrame, text: str, doc_id: str, words: int, least: float
) -> DataFrame:
    """The pairs whose multisets overlap enough, with their similarity."""
    pairs, _ = written_and_counted(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b"))).distinct()
    texts = _texts(df, ids, text, doc_id)
    rows = (
        pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("right")), "b")
        .join(texts.select(F.col("doc").alias("a"), F.col("text").alias("left")), "a")
        .select("a", "b", "left", "right")
    )

    def run(batches):
        last, bag = None, None
        for part in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            left, right = (part.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            found = []
            for x, y in zip(left, right, strict=True):
                if x != last:
                    last, bag = x, shingles(x or b"", words)
                found.append(overlap(bag, shingles(y or b"", words)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.float64())],
                names=["a", "b", "similarity"],
            )

    kind = pairs.schema["a"].dataType.simpleString()
    checked = rows.mapInArrow(run, f"a {kind}, b {kind}, similarity double")
    return written(checked.where(F.col("similarity") >= least - 1e-12), "links")


def _told_apart(df: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with an id for each text, and which ids stand for further texts of a document.

    An id with several texts keeps its own for one of them; the others get ids above all
    there are, so that none of those is ever the smallest of a class. The second value
    has them as links (``a``, ``b``), or is None if no id has two texts.
    """
    doc, own = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    seen = df.select(doc.alias("doc"), F.xxhash64(own).alias("h")).distinct()
    several = seen.groupBy("doc").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("n"))
    several, n = written_and_counted(several.where("n > 1"), "several-texts")
    if not n:
        return df, None
    further = several.join(seen, "doc").where("h != first").select("doc", "h")
    further, n = written_and_counted(further, "further-texts")
    kind = df.schema[doc_id].dataType
    if isinstance(kind, T.IntegralType):
        top = df.agg(F.max(doc)).first()[0]
        node = (F.lit(top) + F.col("_place")).cast(kind)
    else:  # after every text that begins with an assigned character
        node = F.concat(F.lit("\U0010ffff"), F.col("doc"), F.lit(" "), F.col("_place"))
    placed = written(
        positions(further, [F.col("doc"), F.col("h")], name="_place").select(
            F.col("doc").alias("_doc"), F.col("h").alias("_h"), node.alias("_node")
        ),
        "text-ids",
    )
    same = (doc == F.col("_doc")) & (F.xxhash64(own) == F.col("_h"))
    apart = df.join(F.broadcast(placed) if n <= BROADCAST_ROWS else placed, same, "left")
    apart = apart.select(
        F.coalesce("_node", doc).alias(doc_id), F.col(f"`{text}`").alias(text)
    )
    return apart, placed.select(F.col("_node").alias("a"), F.col("_doc").alias("b"))


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, class_id, kept, n_class.

    Documents are linked if the weighted Jaccard similarity of their shingles
    (runs of ``words`` words in lower case, with their counts) is at least
    ``similarity``. ``class_id`` is the smallest doc_id that links reach, ``kept``
    marks that document, ``n_class`` counts the documents of the class.

    Texts with the same words in lower case are copies: one stands for all of
    them, so copies are never paired. A text of fewer words than a shingle is one
    shingle; texts without words (null, empty, blank) are copies of each other.
    Rows that share a doc_id are one document, linked by whatever any of its texts is
    linked to, and come out once. Rows with a null
    doc_id come out once for each row, with a null class, kept. An empty table gives no rows.
    Other columns are not read.

    In a bucket of more than SMALL texts, each text is compared with the best
    connected ones first. What these links leave in different classes is compared
    text by text, block against block inside tasks, so no link that could join two
    classes of a bucket is missed.
    """
    known, further = _told_apart(df.where(F.col(f"`{doc_id}`").isNotNull()), text, doc_id)
    docs = written(signed(known, text, doc_id, words, bands, rows), "signatures")
    # Written, so that joins can split the documents of a key that very many share.
    copies = written(docs.groupBy("key").agg(F.min("doc").alias("head")), "copies")
    heads = docs.join(copies, ["key"]).where(F.col("doc") == F.col("head"))
    heads = written(heads.dropDuplicates(["doc", "key"]).select("doc", "n", "bands"), "heads")
    pairs, large = _candidates(heads)
    links = _verified(known, pairs, text, doc_id, words, similarity)
    links = links.select("a", "b")
    if not large.isEmpty():
        roots = written(components(links), "classes-so-far")
        more = _rest(known, large, roots, text, doc_id, words, similarity)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    # Rows of one document with other words, and copies, hang together too.
    own = docs.join(copies, "key").where("doc != head").select(
        F.col("doc").alias("a"), F.col("head").alias("b")
    )
    links = links.union(own)
    ids = docs.select("doc").distinct()
    if further is not None:
        links = links.union(further)
        ids = ids.join(further, ids["doc"] == further["a"], "left_anti")
    roots = components(links)
    classed = ids.join(roots, ids["doc"] == roots["node"], "left").select(
        "doc", F.coalesce("root", "doc").alias("class_id")
    )
    sizes = classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class"))
    out = classed.join(sizes, "class_id").select(
        F.col("doc").alias("doc_id"),
        "class_id",
        (F.col("doc") == F.col("class_id")).alias("kept"),
        "n_class",
    )
    unknown = df.where(F.col(f"`{doc_id}`").isNull()).select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{doc_id}`").alias("class_id"),
        F.lit(True).alias("kept"),
        F.lit(1).cast("long").alias("n_class"),
    )
    return out.union(unknown)


def drop_near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", **how
) -> DataFrame:
    """The rows of ``df`` whose document is kept; all columns stay."""
    classes = near_duplicates(df, text, doc_id, **how)
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return df.join(gone, F.col(f"`{doc_id}`") == F.col("_gone"), "left_anti")

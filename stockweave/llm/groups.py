"""Documents dealt into groups, and questions that groups ask of each other.

Texts are shuffled once, into groups of bounded size by a hash of the id. A group
computes keys (numbers) and asks which of them another place has too. It sends
each distinct key once, packed with others that go to the same bucket, so a key
that is everywhere costs one entry per group. The answer is a bit for each key
sent, in the order of the keys; groups compute their keys anew when they read it,
which is cheaper than to keep them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.hashing import U

# Bytes of text in a group, and keys in a bucket, on average. The numbers of
# groups and buckets follow the data.
GROUP_BYTES = 2_000_000
BUCKET_KEYS = 1_000_000
LEAST_BUCKETS = 8

KINDS = {
    "int": (T.IntegerType(), pa.int32()),
    "bigint": (T.LongType(), pa.int64()),
    "binary": (T.BinaryType(), pa.binary()),
    "string": (T.StringType(), pa.string()),
}

ANSWERS = "p int, kind int, bucket int, bits binary"


class Groups:
    """``df`` dealt into groups ``p``: doc id, text as bytes, and the other columns."""

    def __init__(self, df: DataFrame, text: str, doc_id: str, new: tuple[str, ...]):
        spark = df.sparkSession
        self.rest = [c for c in df.columns if c not in (text, doc_id, *new)]
        slim = df.select(
            F.col(f"`{doc_id}`").cast("long").alias("doc"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
            F.struct(*[F.col(f"`{c}`") for c in self.rest]).alias("rest")
            if self.rest
            else F.lit(None).cast("int").alias("rest"),
        )
        size = slim.agg(F.sum(F.length("text"))).first()[0] or 0
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.count = int(max(self.tasks, size // GROUP_BYTES + 1))
        self.size = size
        self.docs = slim.withColumn(
            "p", F.pmod(F.xxhash64("doc"), F.lit(self.count)).cast("int")
        ).repartition(self.tasks, "p")

    def buckets(self, keys: float) -> int:
        return int(max(LEAST_BUCKETS, keys // BUCKET_KEYS + 1))

    def ask(
        self,
        keys_of: Callable,
        answers: DataFrame | None,
        kind: int,
        n: int,
        wide: tuple[int, int] | None = None,
    ) -> DataFrame:
        """Answers of ``kind`` to the keys that each group has: does a key occur again.

        With ``wide`` (a kind, a number) a second answer tells which keys more than
        so many groups have.

        ``keys_of(texts, bits)`` gives an array of keys, a row of 64-bit numbers
        each, from the texts of a group and the answers so far (by kind).
        """

        def send(docs, texts: list[bytes], bits):
            buckets, unique, counts = packed_keys(keys_of(texts, bits), n)
            if not len(buckets):
                return []
            cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
            rows = []
            for i, j in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
                twice = np.packbits(counts[i:j] > 1).tobytes()
                rows.append((int(buckets[i]), unique[i:j].tobytes(), twice))
            return rows

        sent = self.run(send, answers, "p int, bucket int, keys binary, twice binary")
        return sent.groupBy("bucket").applyInArrow(_answer(kind, wide), ANSWERS)

    def run(self, function: Callable, answers: DataFrame | None, schema: str) -> DataFrame:
        """Rows (after ``p``) from ``function(docs, texts, bits)``, texts in order of ids."""
        kinds = parsed(schema)

        def rows_of(docs: pa.Table, bits: dict[int, bytes]) -> pa.Table:
            docs = in_order(docs)
            p = docs.column("p")[0].as_py()
            rows = function(docs.column("doc"), docs.column("text").to_pylist(), bits)
            return to_table([(p, *r) for r in rows], kinds)

        return self._grouped(rows_of, answers, kinds)

    def _grouped(self, rows_of, answers: DataFrame | None, schema: T.StructType) -> DataFrame:
        # Every answer goes to a group that asked, so no group is without documents.
        docs = self.docs.groupBy("p")
        if answers is None:
            return docs.applyInArrow(lambda t: rows_of(t, {}), schema)

        def both(docs: pa.Table, answers: pa.Table) -> pa.Table:
            return rows_of(docs, bits_of(answers))

        return docs.cogroup(answers.groupBy("p")).applyInArrow(both, schema)

    def rewrite(self, function: Callable, answers: DataFrame, columns: list[tuple[str, str]],
                text: str, doc_id: str) -> DataFrame:
        """All rows with new columns from ``function(docs, texts, bits)``, a list each."""
        kinds = parsed(", ".join(f"{n} {k}" for n, k in columns))
        schema = T.StructType(
            [
                T.StructField("doc", T.LongType()),
                T.StructField("rest", self.docs.schema["rest"].dataType),
                *kinds.fields,
            ]
        )

        def rows_of(docs: pa.Table, bits: dict[int, bytes]) -> pa.Table:
            docs = in_order(docs)
            new = function(docs.column("doc"), docs.column("text").to_pylist(), bits)
            return pa.table(
                [docs.column("doc"), docs.column("rest"),
                 *[pa.array(v, _arrow(f.dataType)) for v, f in zip(new, kinds.fields, strict=True)]],
                names=["doc", "rest", *[f.name for f in kinds.fields]],
            )

        out = self._grouped(rows_of, answers, schema)
        return out.select(
            F.col("doc").alias(doc_id),
            *[F.col("rest").getField(c).alias(c) for c in self.rest],
            *[F.col(n).alias(text if n == "kept" else n) for n, _ in columns],
        )


def in_order(docs: pa.Table) -> pa.Table:
    """By id, null first, then by text."""
    keys = [("doc", "ascending"), ("text", "ascending")]
    return docs.take(pc.sort_indices(docs, sort_keys=keys, null_placement="at_start"))


def parsed(schema: str) -> T.StructType:
    """The schema of "name kind, ..." for simple kinds, without a session."""
    pairs = [column.split() for column in schema.split(",")]
    return T.StructType([T.StructField(n, KINDS[k][0]) for n, k in pairs])


def _arrow(kind: T.DataType) -> pa.DataType:
    return KINDS[kind.simpleString()][1]


def to_table(rows: list[tuple], names: T.StructType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names.fields)
    return pa.table(
        [pa.array(list(c), _arrow(f.dataType)) for c, f in zip(columns, names.fields, strict=True)],
        names=names.fieldNames(),
    )


def bits_of(answers: pa.Table) -> dict[int, dict[int, bytes]]:
    """By kind and bucket, the bits of a group's answers."""
    out: dict[int, dict[int, bytes]] = {}
    for kind, bucket, bits in zip(
        *[answers.column(c).to_pylist() for c in ("kind", "bucket", "bits")], strict=True
    ):
        out.setdefault(kind, {})[bucket] = bits
    return out


def packed_keys(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, distinct keys (ordered by bucket) and how often each occurs."""
    if not len(keys):
        return np.zeros(0, np.int64), keys.reshape(0, keys.shape[-1]), np.zeros(0, np.int64)
    buckets = (keys[:, 0] % U(n)).astype(np.int64)
    order = np.lexsort([*keys.T[::-1], buckets])
    keys, buckets = keys[order], buckets[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return buckets[first], keys[first], np.diff(np.append(first, len(keys)))


def shared(keys: np.ndarray, n: int, bits: dict[int, bytes]) -> np.ndarray:
    """For each key of a group, whether the answer says that it occurs again."""
    if not len(keys):
        return np.zeros(0, bool)
    buckets, unique, _ = packed_keys(keys, n)
    flags = np.zeros(len(unique), bool)
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
        raw = np.frombuffer(bits[int(buckets[i])], np.uint8)
        flags[i:j] = np.unpackbits(raw, count=j - i).astype(bool)
    # Back to the keys: the same order once more.
    order = np.lexsort([*keys.T[::-1], (keys[:, 0] % U(n)).astype(np.int64)])
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    out = np.empty(len(keys), bool)
    out[order] = flags[np.cumsum(new) - 1]
    return out


def _answer(kind: int, wide: tuple[int, int] | None) -> Callable:
    """For a bucket: which keys of each group occur twice, there or elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        raw = table.column("keys").to_pylist()
        twice = table.column("twice").to_pylist()
        width = 1 if kind % 2 else 2
        parts = [np.frombuffer(k, U).reshape(-1, width) for k in raw]
        sizes = [len(k) for k in parts]
        keys = np.concatenate(parts)
        weight = np.concatenate(
            [1 + np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(np.int64)
             for t, n in zip(twice, sizes, strict=True)]
        )
        order = np.lexsort(keys.T[::-1])
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        flags = {kind: np.add.reduceat(weight[order], heads) > 1}
        if wide:
            flags[wide[0]] = np.diff(np.append(heads, len(keys))) > wide[1]
        p = table.column("p").to_pylist()
        rows = []
        for k, by_key in flags.items():
            flag = np.empty(len(keys), bool)
            flag[order] = by_key[np.cumsum(new) - 1]
            cut = np.split(flag, np.cumsum(sizes)[:-1])
            rows += [(g, k, bucket, np.packbits(x).tobytes()) for g, x in zip(p, cut, strict=True)]
        return to_table(rows, ANSWER_KINDS)

    return run


ANSWER_KINDS = parsed(ANSWERS)

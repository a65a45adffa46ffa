"""Near-duplicate vectors by a flat graph built on overlapping shards.

Vectors with equal labels are cut into shards around centres drawn from them; each
vector goes to its nearest centres, so shards overlap. A pruned graph is built on
each shard, the lists of a vector from all its shards are united, and on each
shard every vector searches from the medoid and on through all that is in range.
Pairs are verified by their cosine in double precision.

Recall is measured where it can be lost. Each cut of a cell is tried on a sample of
every piece: its links by brute force inside the cell, against those whose ends still
share a piece. A cut that loses links is drawn again with more overlap, and a cell that
no cut leaves whole (a ball of copies much larger than a shard, say) is not cut: its
links are counted exactly, slice against slice. In the end a sample of all vectors is
audited, and all links are counted exactly should the graphs have missed too many.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.components import components
from stockweave.llm.vector_graph import build, range_links
from stockweave.session import written, written_and_counted

COSINE = 0.93

# A shard is cut further above twice this number of vectors, into at most FAN.
SHARD, FAN, OVERLAP, LEVELS = 1000, 64, 2, 12

# A vector goes to a further centre only if that is nearly as near (in cosine) as the
# nearest: copies of a vector that lies clearly in one cell lie there too.
MARGIN = 0.08

# Rows of a cell that one task places at a time.
SLICE = 4000

# Vectors whose links are counted by brute force in the end, the recall that a cut must
# keep, and how often a cell is cut anew, each time with more overlap.
AUDIT, LEAST_RECALL, TRIES = 200, 0.97, 3

# Vectors of each piece of a cut that are tried, on average; a piece that loses at
# least LOST of their links must keep PIECE_RECALL of them.
TRIED, LOST, PIECE_RECALL = 8, 10, 0.9

# A cut whose largest piece is this share of the cell does not shrink it.
SHRINK = 0.9

# Vectors of a label that one task multiplies with as many others in the exact count.
EXACT = 2000


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles, scaled to length 1."""
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else flat
    x = np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    # Scaled first, so that squares of very large or small parts stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding) -> F.Column:
    """Not null, not zero, no null or non-finite part."""
    parts = embedding.cast("array<double>")
    fine = F.forall(
        parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return F.coalesce(fine & F.exists(parts, lambda v: v != 0), F.lit(False))


def _cut(large: DataFrame, overlap: int) -> DataFrame:
    """The rows of large cells, with the ``size`` of theirs, at their nearest centres."""
    margin = MARGIN * (overlap - 1)
    rows = large.withColumn(
        "fan", F.least(F.lit(FAN), F.ceil(F.col("size") * overlap / SHARD).cast("int"))
    )
    # About twice as many rows as centres are drawn by hash, and the first kept.
    drawn = rows.where(
        F.pmod(F.xxhash64("head", "cell", F.lit(overlap)), F.lit(1 << 30)) * F.col("size")
        < F.col("fan") * F.lit(2.0 * (1 << 30))
    )
    centres = drawn.groupBy("cell", "size", "fan").agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64("head"), "head", "x"))).alias("drawn")
    ).select("cell", "size", F.slice("drawn", F.lit(1), F.col("fan")).alias("drawn"))
    n_slices = F.ceil(F.col("size") / SLICE).cast("int")
    centres = centres.select(
        F.col("cell").alias("of_cell"),
        F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("of_slice"),
        F.col("drawn.x").alias("centres"),
    )
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("head"), n_slices).cast("int")).select(
        "cell", "slice", "head", "n", "x"
    )

    def nearest(key, rows: pa.Table, centres: pa.Table) -> pa.Table:
        cell = rows.column("cell").to_pylist()
        if not centres.num_rows:  # none was drawn: the cell is its only piece
            only = pa.array([f"{c}/0" for c in cell], pa.string())
            return rows.select(["head", "n", "x"]).add_column(0, "cell", only)
        x = _rows(rows.column("x"))
        c = np.array(centres.column("centres")[0].as_py(), float)
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        k = min(overlap, len(c))
        near = x @ c.T
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(near, best, 1)
        row, col = np.nonzero(near >= near[:, :1] - margin)
        take = pa.array(row)
        names = [
            f"{cell[a]}/{b}" for a, b in zip(row.tolist(), best[row, col].tolist(), strict=True)
        ]
        out = rows.select(["head", "n", "x"]).take(take)
        return out.add_column(0, "cell", pa.array(names, pa.string()))

    asked, offered = rows.groupBy("cell", "slice"), centres.groupBy("of_cell", "of_slice")
    return asked.cogroup(offered).applyInArrow(
        nearest, "cell string, head long, n long, x array<double>"
    )


def _shared(lists: list[list[str]]) -> np.ndarray:
    """Names as numbers in their order, a row per list, filled up with -1."""
    number = {c: i for i, c in enumerate(sorted({c for row in lists for c in row}))}
    out = np.full((len(lists), max([1, *map(len, lists)])), -1)
    for i, row in enumerate(lists):
        out[i, : len(row)] = [number[c] for c in row]
    return out


def _least_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least number that rows of two arrays of `_shared` have in common, or a large one."""
    none = np.iinfo(np.int64).max
    best = np.full(len(left), none)
    for a in range(left.shape[1]):
        for b in range(right.shape[1]):
            same = (left[:, a] == right[:, b]) & (left[:, a] >= 0)
            best = np.where(same, np.minimum(best, left[:, a]), best)
    return best


def _lossy(large: DataFrame, cut: DataFrame, least: float) -> DataFrame:
    """``cell`` of the cells whose cut loses links of a sample, or does not shrink them."""
    parent = F.regexp_replace("cell", "/[^/]*$", "")
    placed = cut.select(parent.alias("of"), F.col("cell").alias("piece"), "head")
    pieces = written(placed.groupBy("of", "piece").agg(F.count(F.lit(1)).alias("m")), "pieces")
    drawn = placed.join(pieces, ["of", "piece"]).where(
        F.pmod(F.xxhash64("head", "piece"), F.lit(1 << 30)) * F.col("m")
        < F.lit(float(TRIED << 30))
    )
    tried = drawn.select(F.col("of").alias("cell"), "head").distinct()
    kids = placed.groupBy(F.col("of").alias("cell"), "head").agg(
        F.sort_array(F.collect_set("piece")).alias("kids")
    )
    rows = written(large.join(kids, ["cell", "head"]), "tried-cells")
    n_slices = F.ceil(F.col("size") / SLICE).cast("int")
    asks = (
        rows.join(tried, ["cell", "head"], "left_semi")
        .groupBy("cell", "size")
        .agg(F.collect_list(F.struct("head", "x", "kids")).alias("asks"))
        .select(
            F.col("cell").alias("of_cell"), "asks",
            F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("of_slice"),
        )
    )
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("head"), n_slices).cast("int"))

    def count(key, rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = {"cell": [], "home": [], "true": [], "kept": []}
        if rows.num_rows and asks.num_rows:
            asked = asks.column("asks")[0].as_py()
            lists = rows.column("kids").to_pylist()
            names = _shared(lists + [q["kids"] for q in asked])
            mine, theirs = names[: len(lists)], names[len(lists) :]
            q = np.array([a["x"] for a in asked], float)
            q /= np.abs(q).max(axis=1, keepdims=True)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            heads = rows.column("head").to_numpy()
            i, j = np.nonzero(_rows(rows.column("x")) @ q.T >= least)
            other = heads[i] != np.array([a["head"] for a in asked])[j]
            i, j = i[other], j[other]
            n = rows.column("n").to_numpy()[i]
            stay = _least_shared(mine[i], theirs[j]) < np.iinfo(np.int64).max
            for k in np.unique(j).tolist():
                at = j == k
                out["cell"].append(key[0].as_py())
                out["home"].append(asked[k]["kids"][0])
                out["true"].append(int(n[at].sum()))
                out["kept"].append(int(n[at & stay].sum()))
        return pa.table(
            [pa.array(out["cell"], pa.string()), pa.array(out["home"], pa.string()),
             pa.array(out["true"], pa.int64()), pa.array(out["kept"], pa.int64())],
            names=list(out),
        )

    counted = rows.select("cell", "slice", "head", "n", "x", "kids").groupBy("cell", "slice")
    by_piece = (
        counted.cogroup(asks.groupBy("of_cell", "of_slice"))
        .applyInArrow(count, "cell string, home string, true long, kept long")
        .groupBy("cell", "home")
        .agg(F.sum("true").alias("true"), F.sum("kept").alias("kept"))
    )
    torn = (F.col("true") - F.col("kept") >= LOST) & (F.col("kept") < PIECE_RECALL * F.col("true"))
    losing = (
        by_piece.groupBy("cell")
        .agg(F.sum("true").alias("t"), F.sum("kept").alias("k"), F.max(torn).alias("torn"))
        .where(F.col("torn") | (F.col("k") < LEAST_RECALL * F.col("t")))
        .select("cell")
    )
    sizes = large.select(F.col("cell").alias("of"), "size").distinct()
    stuck = (
        pieces.groupBy("of").agg(F.max("m").alias("m")).join(sizes, "of")
        .where(F.col("m") >= SHRINK * F.col("size"))
        .select(F.col("of").alias("cell"))
    )
    return losing.union(stuck).distinct()


def shards(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(cell, head, n, x) of the cells that were cut small, and of those that cannot be."""
    columns = ["cell", "head", "n", "x"]
    cells = classes.select(F.col("label").cast("string").alias("cell"), "head", "n", "x")
    small, whole = [], []
    for level in range(LEVELS + 1):
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        sized = written(cells.join(written(sizes, "cell-sizes"), "cell"), "shards")
        small.append(sized.where(F.col("size") <= 2 * SHARD).select(*columns))
        large, n = written_and_counted(sized.where(F.col("size") > 2 * SHARD), "large-cells")
        if not n:
            break
        pieces = []
        for more in range(TRIES if level < LEVELS else 0):
            cut = written(_cut(large, OVERLAP + more), "cuts")
            lossy, n = written_and_counted(_lossy(large, cut, least), "lossy-cells")
            parent = F.regexp_replace("cell", "/[^/]*$", "")
            fine = cut.withColumn("of", parent).join(
                lossy.withColumnRenamed("cell", "of"), "of", "left_anti"
            )
            pieces.append(fine.select(*columns))
            if not n:
                break
            large = written(large.join(lossy, "cell", "left_semi"), "large-cells")
        if n:
            whole.append(large.select(*columns))
        if not pieces:
            break
        cells = reduce(DataFrame.union, pieces)
    return reduce(DataFrame.union, small), reduce(DataFrame.union, whole) if whole else None


def _built(table: pa.Table) -> pa.Table:
    table = table.sort_by("head")
    head = table.column("head").to_numpy()
    graph = build(_rows(table.column("x")))
    lists = [head[row[row >= 0]] for row in graph]
    return pa.table(
        [table.column("head"), pa.array(lists, pa.list_(pa.int64()))], names=["head", "near"]
    )


def _first_here(cells: list[list[str]], cell: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs count in this cell: it is the first of those that both are in."""
    names = _shared([*cells, [cell]])
    return _least_shared(names[i], names[j]) == names[-1, 0]


def _searched(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("head")
        head = table.column("head").to_numpy()
        cell = table.column("cell")[0].as_py()
        number = {h: i for i, h in enumerate(head.tolist())}
        near = [
            np.array([number[h] for h in row if h in number], int)
            for row in table.column("near").to_pylist()
        ]
        x = _rows(table.column("x"))
        i, j = range_links(x, near, least)
        # Rounding decides nothing here: pairs are verified as the contract has it.
        real = np.einsum("ij,ij->i", x[i], x[j]) >= least
        i, j = i[real], j[real]
        own = _first_here(table.column("cells").to_pylist(), cell, i, j)
        n = table.column("n").to_numpy()
        links = np.zeros(len(head), np.int64)
        np.add.at(links, i[own], n[j[own]])
        np.add.at(links, j[own], n[i[own]])
        # The least head that links reach inside the shard.
        root = np.arange(len(head))
        changed = True
        while changed:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            changed = (root != before).any()
        return pa.table(
            [table.column("head"), pa.array(links), pa.array(head[root])],
            names=["head", "links", "root"],
        )

    return run


def _linked(classes: DataFrame, least: float) -> DataFrame:
    """head, links (vectors of other classes linked to it) and roots, one row per cell."""
    cells, whole = shards(classes, least)
    cells = written(cells, "cells")
    lists = cells.groupBy("cell").applyInArrow(_built, "head long, near array<long>")
    united = lists.groupBy("head").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")
    )
    every = cells if whole is None else cells.union(whole)
    member_of = written(
        every.groupBy("head").agg(F.sort_array(F.collect_set("cell")).alias("cells")), "members"
    )
    found = (
        cells.join(united, "head").join(member_of, "head").groupBy("cell")
        .applyInArrow(_searched(least), "head long, links long, root long")
    )
    if whole is not None:
        found = found.union(exact_links(whole.join(member_of, "head"), least, "cell"))
    return written(found, "vector-links")


def _multiplied(least: float):
    def run(table: pa.Table) -> pa.Table:
        head, n = table.column("head").to_numpy(), table.column("n").to_numpy()
        x = _rows(table.column("x"))
        own, first, second = (table.column(c).to_numpy() for c in ("slice", "q", "d"))
        left = np.flatnonzero(own == first)
        right = np.flatnonzero(own == second)
        near = x[left] @ x[right].T
        i, j = np.nonzero(near >= least - 1e-9)
        edge = near[i, j] < least + 1e-9
        i, j = left[i], right[j]
        # Where the product's rounding could decide, the pair is verified by itself.
        real = ~edge
        real[edge] = np.einsum("ij,ij->i", x[i[edge]], x[j[edge]]) >= least
        # Inside one slice a pair stands on both sides of the diagonal.
        real &= (i < j) if first[0] == second[0] else (i != j)
        i, j = i[real], j[real]
        here = slice(None)
        if "cells" in table.column_names:
            here = _first_here(
                table.column("cells").to_pylist(), table.column("cell")[0].as_py(), i, j
            )
        links = np.zeros(len(head), np.int64)
        np.add.at(links, i[here], n[j[here]])
        np.add.at(links, j[here], n[i[here]])
        order = np.argsort(head, kind="stable")
        place = np.empty(len(head), np.int64)
        place[order] = np.arange(len(head))
        i, j = place[i], place[j]
        root = np.arange(len(head))
        changed = True
        while changed:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            changed = (root != before).any()
        return pa.table(
            [pa.array(head), pa.array(links), pa.array(head[order][root[place]])],
            names=["head", "links", "root"],
        )

    return run


def exact_links(rows: DataFrame, least: float, group: str = "label") -> DataFrame:
    """head, links and roots as the search gives them, from all pairs of each group.

    The vectors of a group are dealt into slices; each pair of slices is multiplied
    once, in a task of its own, and no pairs leave it. Rows with ``cells`` count a pair
    in the first cell that both are in.
    """
    sizes = written(rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    k = F.ceil(F.col("size") / EXACT).cast("int")
    carried = [group, "head", "n", "x", *(["cells"] if "cells" in rows.columns else [])]
    rows = rows.join(sizes, group).select(
        *carried, F.pmod(F.xxhash64("head"), k).cast("int").alias("slice"), k.alias("k")
    )
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    rows = rows.select(
        *carried, F.least("slice", "other").alias("q"), F.greatest("slice", "other").alias("d"),
        "slice",
    )
    found = rows.groupBy(group, "q", "d").applyInArrow(
        _multiplied(least), "head long, links long, root long"
    )
    return written(found, "exact-links")


def audit(classes: DataFrame, links: DataFrame, least: float, sample: int = AUDIT) -> float:
    """Share of the links of a sample that the search has found.

    At most ``sample`` vectors, drawn by hash, are compared with all by brute force;
    only they are sent to the tasks.
    """
    asked = classes.orderBy(F.xxhash64("head"), "head").limit(sample).select("label", "head", "x")
    asked = asked.toArrow()
    if not asked.num_rows:
        return 1.0
    heads = asked.column("head").to_numpy()
    by_label = {}
    for value in set(asked.column("label").to_pylist()):
        at = np.flatnonzero([v == value for v in asked.column("label").to_pylist()])
        by_label[value] = (at, _rows(asked.column("x").take(pa.array(at))))

    def count(batches):
        total = np.zeros(len(heads), np.int64)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            labels = table.column("label").to_pylist()
            for value in by_label.keys() & set(labels):
                at, q = by_label[value]
                own = table.filter(pa.array([v == value for v in labels]))
                hit = _rows(own.column("x")) @ q.T >= least
                hit &= own.column("head").to_numpy()[:, None] != heads[at]
                total[at] += (hit * own.column("n").to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(heads, pa.int64()), pa.array(total)], names=["head", "links"]
        )

    kept = classes.select("label", "head", "n", "x")
    true = kept.mapInArrow(count, "head long, links long").groupBy("head").agg(
        F.sum("links").alias("true")
    )
    both = true.join(
        links.groupBy("head").agg(F.sum("links").alias("found")), "head", "left"
    ).agg(F.sum("true"), F.sum(F.least("true", F.coalesce("found", F.lit(0))))).first()
    return (both[1] or 0) / both[0] if both[0] else 1.0


def near_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = COSINE,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double
    precision, is at least ``least``. Equal vectors of a label are one class: they
    link, and are not paired one by one.

    Vectors that are null, zero or hold null or non-finite parts, and rows with a
    null label or a length unlike the others of their label, link with nothing.
    Rows with a null id keep a null component and count for nobody; repeated rows
    of an id count as vectors each and share their component. An empty table gives
    no rows. Other columns are not read.
    """
    rows = df.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{embedding}`").cast("array<double>").alias("x"),
    )
    # Vectors of other lengths are of other kinds: the length goes with the label.
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("x")))
    good = good.withColumn("label", F.concat_ws(":", F.col("label").cast("string"), F.size("x")))
    classes, _ = written_and_counted(
        good.groupBy("label", "x").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("n")),
        "classes",
    )
    links = _linked(classes, least)
    if audit(classes, links, least) < LEAST_RECALL:
        links = exact_links(classes, least)
    roots = components(
        links.where("head != root").select(F.col("head").alias("a"), F.col("root").alias("b"))
    )
    heads = (
        classes.join(links.groupBy("head").agg(F.sum("links").alias("links")), "head", "left")
        .join(roots, F.col("head") == F.col("node"), "left")
        .select(
            "label", "x",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "head").alias("component_id"),
        )
    )
    out = good.join(heads, ["label", "x"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(
        ~F.coalesce(
            F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("x")),
            F.lit(False),
        )
    ).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(bad).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )

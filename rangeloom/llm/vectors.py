"""Near-duplicate embeddings by an inverted multi-index.

Each half of the vectors has a codebook of its own, fitted on a bounded sample; a cell is a pair of codewords, so two
small codebooks make a fine grid.  Every vector is put in its nearest cell, and looks for partners in the cells nearest
to it, in the order in which a multi-sequence traversal meets them.  How many cells it visits is found by trial: partners
made at exactly the threshold, the hardest case, must be in the visited cells with the target recall.  Pairs found are
verified by cosine in double precision.

Equal vectors of a label are one node.  Cells and visits are worked out on ids alone: visits to cells without another
vector are dropped, and only then do vectors go to the cells where they meet others.  A cell's vectors and its visitors
meet in one task; cells with many are cut into blocks and each pair of blocks is a task.  Tasks return, per vector, its
number of links and its group, not pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing; vectors of different lengths aren't compared; repeated rows are copies and count as links of each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, c, cut, hinted, stored, tidied
from .components import components

# ---- the index -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Two codebooks and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * x @ book.T


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, book).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(book))
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


@functools.lru_cache(maxsize=4)
def _reach(visits: int, first: int, second: int) -> np.ndarray:
    return np.array([(i, j) for i in range(min(visits, first)) for j in range(min(visits // (i + 1), second))]).T


def _ranked(distances: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest codewords of each row, nearest first (ties by number)."""
    if most < distances.shape[1]:
        some = np.sort(np.argpartition(distances, most - 1, 1)[:, :most], 1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(distances, some, 1), 1, kind="stable"), 1)
    return np.argsort(distances, 1, kind="stable")


def nearest_cells(x: np.ndarray, first: np.ndarray, second: np.ndarray, visits: int) -> np.ndarray:
    """The ``visits`` nearest cells of each unit vector, nearest first.

    In a multi-sequence traversal the cell of the i-th and j-th nearest codewords comes after the i * j - 1 cells that
    are no farther in both halves, so only cells with i * j <= visits can be among the first.
    """
    half = x.shape[1] // 2
    a, b = _distances(x[:, :half], first), _distances(x[:, half:], second)
    by_a, by_b = _ranked(a, min(visits, len(first))), _ranked(b, min(visits, len(second)))
    i, j = _reach(visits, len(first), len(second))
    rows = np.arange(len(x))[:, None]
    cost = a[rows, by_a[:, i]] + b[rows, by_b[:, j]]
    order = np.argsort(cost, 1, kind="stable")[:, : min(visits, len(i))]
    return (by_a[:, i] * len(second) + by_b[:, j])[rows, order]


def build(sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 5) -> Index:
    """Codebooks of ``k`` words from unit vectors, and the visits with which partners at the threshold are found."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    first, second = _codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng)
    cells = len(first) * len(second)
    x = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
    away = rng.standard_normal(x.shape)
    used = (np.abs(sample).max(0) > 0)[None, :]
    away = away * used
    away -= (away * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(1 - threshold**2) * away / np.maximum(norm, 1e-12)
    home_x, home_y = nearest_cells(x, first, second, 1)[:, 0], nearest_cells(unit(y), first, second, 1)[:, 0]
    visits = 1
    while visits < cells:
        found = (nearest_cells(x, first, second, visits) == home_y[:, None]).any(1) | (nearest_cells(unit(y), first, second, visits) == home_x[:, None]).any(1)
        if found.mean() >= recall:
            break
        visits = min(cells, max(visits + 1, visits * 5 // 4))
    return Index(first, second, visits)


# ---- tasks -----------------------------------------------------------------------------------------------------------


def _read(width: int):
    """Rows (embedding, label, id) -> group, node, vec (float64 bytes, padded to ``width``); invalid ones have no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, node, vec = [], [], []
            for value, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = None if not value.is_valid or label is None or value.values.null_count else value.values.to_numpy(zero_copy_only=False).astype("f8")
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    group.append(None), node.append(None), vec.append(None)
                    continue
                x = x + 0.0  # one zero
                name = f"{len(x)}:{label}"
                raw = np.concatenate([x, np.zeros(width - len(x))]).tobytes()
                group.append(name), vec.append(raw), node.append(hashlib.md5(name.encode() + raw, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(group, pa.string()), pa.array(node, pa.binary()), pa.array(vec, pa.binary())], ["id", "group", "node", "vec"])

    return tidied(run)


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    x = np.frombuffer(b"".join(raw), "f8").reshape(len(raw), -1)
    scale = np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return unit(x / scale)


def _place(held):
    """Adds to each vector's row the cells that it visits, its own first, and leaves the vector out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                cells = nearest_cells(_vectors(batch.column("vec")), index.first, index.second, index.visits).astype("i4")
                n, v = cells.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * v + 1, v), pa.int32()), pa.array(cells.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), batch.column("copies"), lists], ["group", "node", "copies", "visits"])

    return tidied(run)


def _group_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each component of the links a - b among n things."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _meet(threshold: float):
    """Input sorted by (group, cell, i, j): a block of a cell's vectors and a block of its visitors.

    A visitor's own count grows by each vector found.  The vector's count grows only if it doesn't visit the visitor's
    cell in turn; else it counts the link there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []

        def close() -> None:
            rows = pa.Table.from_batches(held)
            held.clear()
            visitor = rows.column("visitor").to_numpy()
            own, seen = np.flatnonzero(~visitor), np.flatnonzero(visitor)
            if not len(own) or not len(seen):
                return
            x = _vectors(rows.column("vec").combine_chunks())
            p, m = np.nonzero(x[seen] @ x[own].T >= threshold)
            nodes = rows.column("node").to_pylist()
            names, index = np.unique(np.array(nodes, dtype=object), return_inverse=True)
            who_p, who_m = index[seen[p]], index[own[m]]
            apart = who_p != who_m
            p, m, who_p, who_m = p[apart], m[apart], who_p[apart], who_m[apart]
            if not len(p):
                return
            copies = rows.column("copies").to_numpy()
            count = np.zeros(len(names), "i8")
            np.add.at(count, who_p, copies[own[m]])
            home = rows.column("home").to_numpy()
            visits = np.array([rows.column("visits")[int(k)].as_py() for k in own[np.unique(m)]])
            back = (visits[np.searchsorted(np.unique(m), m)] == home[seen[p]][:, None]).any(1)
            np.add.at(count, who_m[~back], copies[seen[p[~back]]])
            root = _group_roots(len(names), who_p, who_m)
            for k in np.unique(np.concatenate([who_p, who_m])).tolist():
                out.append((names[k], int(count[k]), names[root[k]]))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["node", "n_links", "root"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("group", "cell", "i", "j")), strict=True))
            a = 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a]:
                    if keys[a] != key and held:
                        close()
                    key = keys[a]
                    held.append(batch.slice(a, b - a))
                    a = b
            if len(out) > 10_000:
                yield emit()
        if held:
            close()
        yield emit()

    return tidied(run)


def _dealt(placed: DataFrame, block_rows: int) -> DataFrame:
    """Where vectors meet: group, cell, i, j (the blocks), visitor, home, visits (of a cell's own vectors), node, copies."""
    home = F.get("visits", F.lit(0))
    own = placed.select("group", home.alias("cell"), F.lit(False).alias("visitor"), home.alias("home"), "visits", "node", "copies")
    seen = placed.select("group", F.explode("visits").alias("cell"), F.lit(True).alias("visitor"), home.alias("home"), F.lit(None).cast("array<int>").alias("visits"), "node", "copies")
    filled = own.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("own_n"))
    # a visit finds something only where another vector is at home
    met = cut(seen.join(filled, ["group", "cell"]).filter("own_n > 1 or cell <> home"))
    load = met.groupBy("group", "cell").agg(F.max("own_n").alias("own_n"), F.count(F.lit(1)).alias("seen_n"))
    blocks = cut(load.select("group", "cell", F.ceil(F.col("own_n") / block_rows).cast("int").alias("own_blocks"), F.ceil(F.col("seen_n") / block_rows).cast("int").alias("seen_blocks")))
    spread = own.unionByName(met.drop("own_n")).join(hinted(blocks, 100_000), ["group", "cell"])
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("visitor"), F.col("seen_blocks")).otherwise(F.col("own_blocks"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("visitor"), F.col("own_blocks")).otherwise(F.col("seen_blocks")) - 1))
    spread = spread.withColumn("mine", mine).withColumn("other", others)
    i, j = F.when(F.col("visitor"), F.col("other")).otherwise(F.col("mine")), F.when(F.col("visitor"), F.col("mine")).otherwise(F.col("other"))
    return spread.select("group", "cell", i.alias("i"), j.alias("j"), "visitor", "home", "visits", "node", "copies")


def near_duplicates(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.999, sample: int = 20_000, cell_rows: int = 32, block_rows: int = 1024
) -> DataFrame:
    """Per vector: id, n_links (other vectors linked directly), component_id (least id reachable by links, itself included).

    The codebooks are fitted on ``sample`` vectors and grow with the table, so that a vector's cell has about
    ``cell_rows`` vectors (labels count by the vectors in them: one that holds nearly all decides), up to an eighth as many
    words as the sample has vectors (6 million cells a label by default).
    """
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    width = df.agg(F.max(F.size(c(vector_col)))).first()[0] or 1
    width = max(width, 1) + max(width, 1) % 2
    base = df.select(c(vector_col).alias("vec"), c(label_col).cast("string").alias("label"), c(id_col).alias("id"))
    rows = stored(base.mapInArrow(_read(width), f"id {kind}, `group` string, node binary, vec binary"), "vectors")
    valid = rows.filter("node is not null")
    counts = valid.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # of equal vectors one row stays; copies are told apart by nothing but their ids
    nodes = stored(valid.select("node", "group", "vec").dropDuplicates(["node"]).join(counts, "node"), "vector-nodes")
    each = nodes.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # how many vectors the label of a vector has, over all vectors
    peers = each.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    got = [r[0] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vec").collect()]
    if not got:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    words = int(min(max(2, sample // 8), max(2, np.ceil(np.sqrt(peers / cell_rows)))))
    index = build(_vectors(pa.array(got, pa.binary())), words, threshold, recall)
    held = spark.sparkContext.broadcast(index)
    placed = stored(nodes.select("group", "node", "copies", "vec").mapInArrow(_place(held), "`group` string, node binary, copies long, visits array<int>"), "cells")
    dealt = _dealt(placed, block_rows).join(nodes.select("node", "vec"), "node")
    dealt = dealt.select("group", "cell", "i", "j", "visitor", "home", "visits", "node", "copies", "vec").repartition("group", "cell", "i", "j").sortWithinPartitions("group", "cell", "i", "j")
    found = cut(dealt.mapInArrow(_meet(threshold), "node binary, n_links long, root binary"))
    sums = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    result = grouped.join(least, "root").join(sums, "node", "left").select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "node").join(result, "node", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

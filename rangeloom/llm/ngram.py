"""N-gram Jaccard join by MinHash banding.

Texts are sets of runs of five words.  Equal texts are one node.  A node's MinHash values are grouped in bands, and nodes
that agree in a band are candidates: those pairs, and no others, are verified on the full sets.

Texts meet in tasks.  Candidates that hang together form a cluster, and the texts of a cluster that fits a task go there
once.  A larger cluster goes one of two ways, by the number of texts to be moved: either band by band, where the nodes of
one full band meet and a pair counts in the first band that it shares; or, where nearly all share their bands anyway, in
blocks, each two of which are a task.  A band too full for one task is cut into blocks too.  No task holds more than two
blocks, and no rows are made for pairs: a task returns, for each text, the number of its links and its group.

``bands`` bands of ``rows`` values find a pair of similarity s with probability 1 - (1 - s^rows)^bands; the counts are
chosen for the target recall at the threshold.

Defined results: words are runs of anything but ASCII white space, case counts; a text of fewer words than the length of
a run is the one run of its words; null, empty and blank texts link with nothing; repeated rows are copies of each
other, and links to all copies of a text count; a null id never names a class while another id is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_task_end, bounded_batches, c, cut, fresh, hinted, slices, stored, text_or_empty, tidied
from .components import components

ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective banding that reaches ``recall`` at ``threshold`` with at most 64 values a
    signature where that is possible, and ``most`` otherwise."""
    for limit in (64, 128, most):
        for rows in range(12, 0, -1):
            for bands in range(1, limit // rows + 1):
                if 1 - (1 - threshold**rows) ** bands >= recall:
                    return bands, rows
    raise ValueError("no banding of this size reaches the recall")


# ---- sets of runs ----------------------------------------------------------------------------------------------------

_words: dict[str, int] = {}
at_task_end.append(_words.clear)


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_words) > 200_000:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((_words[w] for w in words), "u8", len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of ``n`` words of each text, all in a row, and how many each text has."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    owner = words.value_parent_indices().to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    h = _word_hashes(coded.dictionary.to_pylist())
    h = h[coded.indices.to_numpy(zero_copy_only=False)][filled] if len(h) else np.zeros(0, "u8")
    count = np.bincount(owner[filled], minlength=len(texts)).astype("i8")
    first = np.cumsum(count) - count
    # position i of a text of w words starts a run if i + n <= w; shorter texts have one run of all their words
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = np.repeat(first, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    length = np.repeat(np.minimum(count, n), many)
    out = np.zeros(len(start), "u8")
    padded = np.concatenate([h, np.zeros(n, "u8")])
    for j in range(n):
        out = (out + np.where(j < length, padded[start + j], np.uint64(0)) + np.uint64(j)) * ODD
        out ^= out >> np.uint64(32)
    return _mix(out), many


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240607)
        a = rng.integers(1, 1 << 63, bands * rows, dtype="u8") * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, dtype="u8")
        for whole in batches:
            for batch in slices(whole, 0, 4 << 20):
                x, many = runs(batch.column(0), n)
                some = np.flatnonzero(many)
                at = (np.cumsum(many) - many)[some]
                out = np.zeros((len(batch), bands), "i8")
                for band in range(bands if len(some) else 0):
                    got = np.zeros(len(some), "u8")
                    for k in range(band * rows, (band + 1) * rows):
                        got = (got ^ np.minimum.reduceat(x * a[k] + b[k], at)) * ODD
                        got ^= got >> np.uint64(32)
                    out[some, band] = got.view("i8")
                offsets = pa.array(np.arange(0, len(batch) * bands + 1, bands), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)), mask=pa.array(many == 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), lists], [*batch.schema.names[1:], "bands"])

    return tidied(run)


# ---- verification ----------------------------------------------------------------------------------------------------


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many runs each pair of sets shares."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    code = np.cumsum(new) - 1
    shared = np.bincount(code) > 1
    keep = shared[code]
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    out = np.zeros((m, m), "f4")
    width = max(256, (1 << 23) // max(m, 1))
    for a in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(code, [a, a + width])
        x = np.zeros((m, int(code[j - 1]) - a + 1 if j > i else 0), "f4")
        x[owner[i:j], code[i:j] - a] = 1
        out += x @ x.T
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric boolean matrix."""
    m = len(links)
    label = np.arange(m)
    while True:
        near = np.where(links, label[None, :], m).min(1, initial=m)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidates(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of rows meet: all that share a band (``band`` -1), or those that share none before ``band``."""
    m = len(bands)
    out = np.zeros((m, m), bool)
    for column in bands.T if band < 0 else bands.T[:band]:
        out |= column[:, None] == column[None, :]
    if band >= 0:
        out = ~out
    np.fill_diagonal(out, False)
    return out


def verify(sets: list[np.ndarray], threshold: float, pairs: np.ndarray) -> np.ndarray:
    """Which of the given pairs (a symmetric matrix) are at least ``threshold`` similar."""
    size = np.array([len(s) for s in sets], "f8")
    a, b = np.nonzero(np.triu(pairs))
    both = np.zeros(len(a))
    if len(a) > 4 * len(sets):
        both = _overlaps(sets).astype("f8")[a, b]
    else:
        # sets of too different sizes can't be similar
        near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        for k in np.flatnonzero(near).tolist():
            x, y = sets[a[k]], sets[b[k]]
            at = np.searchsorted(y, x)
            both[k] = (y[np.minimum(at, len(y) - 1)] == x).sum()
    good = both >= threshold * (size[a] + size[b] - both) - 1e-9
    links = np.zeros_like(pairs)
    links[a[good], b[good]] = links[b[good], a[good]] = True
    return links


GROUP = ["cluster", "band", "value", "i", "j"]


def _verified(n: int, threshold: float):
    """Input sorted by ``GROUP``; a group has one block (i = j) or two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, weights, sets, marks = None, [], [], [], [], []
        out: list[tuple] = []

        def close() -> None:
            if len(nodes) > 1:
                pairs = candidates(np.array(marks, "i8"), key[1])
                if key[3] != key[4]:
                    side = np.array(sides)
                    pairs &= side[:, None] != side[None, :]
                links = verify(sets, threshold, pairs)
                if links.any():
                    counts, label = links @ np.array(weights, "i8"), _roots(links)
                    out.extend((x, k, nodes[r]) for x, k, r in zip(nodes, counts.tolist(), label.tolist(), strict=True) if k)
            nodes.clear(), sides.clear(), weights.clear(), sets.clear(), marks.clear()

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["node", "n_links", "root"])
            out.clear()
            return batch

        for whole in batches:
            for batch in slices(whole, 0, 4 << 20):
                x, many = runs(batch.column(0), n)
                stop = np.cumsum(many)
                rows = zip(*(batch.column(k).to_pylist() for k in range(1, 10)), (stop - many).tolist(), stop.tolist(), strict=True)
                for *group, own, node, weight, bands, a, b in rows:
                    if group != key:
                        if key:
                            close()
                        key = group
                    nodes.append(node), sides.append(own), weights.append(weight), sets.append(np.unique(x[a:b])), marks.append(bands)
                if len(out) > 10_000:
                    yield emit()
        if key:
            close()
        yield emit()

    return tidied(run)


def _groups(members: DataFrame, banded: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Where nodes meet: node, cluster, band (-1: the whole cluster), value, blocks, own.  ``members`` has node, cluster,
    bytes; a node of a large cluster may stand in several bands."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("bytes") / block_bytes)).cast("int")
    sizes = cut(members.groupBy("cluster").agg(blocks.alias("blocks"), F.sum("bytes").alias("all")))
    together = members.join(sizes.select("cluster", "blocks"), "cluster").select("node", "cluster", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("value"), "blocks")
    large = sizes.filter("blocks > 1")
    if not large.isEmpty():
        theirs = cut(banded.join(members.join(large.select("cluster"), "cluster", "left_semi"), "node"))
        buckets = theirs.groupBy("cluster", "band", "value").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks"), F.sum("bytes").alias("bytes")).filter("n > 1")
        moved = buckets.groupBy("cluster").agg(F.sum(F.col("bytes") * F.col("blocks")).alias("moved"))
        apart = cut(large.join(moved, "cluster").filter("moved < all * blocks").select("cluster"))
        own = theirs.join(apart, "cluster", "left_semi").join(buckets.select("cluster", "band", "value", "blocks"), ["cluster", "band", "value"])
        together = together.join(apart, "cluster", "left_anti").unionByName(own.select("node", "cluster", "band", "value", "blocks"))
    return together.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _repeats(members: DataFrame, signed: DataFrame) -> bool:
    """Whether a text that meets others stands on several rows of one id."""
    ids = signed.join(members.select("node"), "node", "left_semi").groupBy("node", "id").agg(F.count(F.lit(1)).alias("n"))
    return not ids.filter("n > 1").isEmpty()


def node_of(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col)))


def join(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9995, block_rows: int = 512, block_bytes: int = 16 << 20, broadcast_rows: int = 200_000
) -> DataFrame:
    """Per document: id, node (its text's digest), class_id (least id of its group), n_links (documents linked directly, copies included)."""
    bounded_batches(df.sparkSession)
    bands, rows = banding(threshold, recall)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(text_or_empty(text_col).alias("text"), node_of(text_col).alias("node"), c(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("bytes"))
    signed = stored(docs.mapInArrow(_signatures(words, bands, rows), f"node binary, id {kind}, bytes long, bands array<long>"), "signatures")
    worded = signed.filter("bands is not null")
    nodes = cut(worded.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes")))
    # copies carry equal bands: those of the least id are enough
    one = worded.join(nodes.filter("copies > 1").select("node", F.col("least").alias("of")), "node", "left").filter("of is null or id = of").select("node", "bands")
    banded = one.select("node", F.posexplode("bands").alias("band", "value"))
    heads = banded.groupBy("band", "value").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head <> tail").select("band", "value", "head")
    stars = banded.join(heads, ["band", "value"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = components(stars)
    members = cut(clusters.join(nodes, "node").select("node", F.col("root").alias("cluster"), "bytes"))
    marks = cut(one.join(members.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    groups = _groups(members, marks.select("node", F.posexplode("bands").alias("band", "value")), block_rows, block_bytes)
    placed = cut(groups.join(nodes.select("node", "least", "copies"), "node").join(marks, "node").withColumnsRenamed({"node": "of", "least": "whose"}))
    # a copy's text is as good as another's: that of the least id, which deals out copies by their ids
    same = (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("whose"))
    texts = docs.select("text", "node", "id").join(hinted(placed, broadcast_rows), same).drop("of", "whose")
    if _repeats(members, signed):
        texts = texts.dropDuplicates(["node", "band", "value"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = texts.withColumn("other", other).select("text", "cluster", "band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "bands")
    sorted_ = paired.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = cut(sorted_.mapInArrow(_verified(words, threshold), "node binary, n_links long, root binary"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    result = grouped.join(least, "root").join(counts, "node", "left").select("node", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id", "node", F.col("bands").isNotNull().alias("worded")).join(result, "node", "left")
    return out.select("id", "node", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "worded")


def keep_first(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """``df`` with all its columns, one document of each group: the one with the least id.

    Only the documents that go, a row each, are matched with the texts.  Rows without words all stay.
    """
    joined = cut(join(df, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **options))
    node, ident = fresh(df, "node", "ident")
    goes = joined.filter("worded and not (id <=> class_id)").select(F.col("node").alias(node), F.col("id").alias(ident)).distinct()
    goes = cut(goes)
    stay = df.withColumn(node, node_of(text_col))
    same = (stay[node] == goes[node]) & c(id_col).eqNullSafe(goes[ident])
    stay = stay.join(hinted(goes, broadcast_rows), same, "left_anti")
    kept = joined.filter("worded and id <=> class_id")
    if kept.groupBy("class_id").count().filter("count > 1").limit(1).count():
        # ids that repeat: of the rows that are equal in id and group, one stays
        first = cut(kept.groupBy("class_id").agg(F.min("node").alias("first")))
        (mark,) = fresh(stay, "first")
        again = stay.join(first.select(F.col("class_id").alias(ident), F.col("first").alias(mark)), c(id_col).eqNullSafe(F.col(ident)), "left")
        worded = F.size(F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")) > 0
        blank = again.filter(~worded)
        stay = again.filter(worded & F.col(mark).eqNullSafe(F.col(node))).dropDuplicates([node, id_col]).unionByName(blank)
    return stay.select(*[c(x) for x in df.columns])

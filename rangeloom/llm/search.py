"""Ranked lexical search: WAND per shard of documents.

A first scan cuts the documents into shards of a few thousand and writes for each the postings of the terms that the items
use (which documents, how often), and how many terms each document has.  Corpus figures (documents, terms, documents per
term) are sums over the shards.  A second scan over these postings, not the texts, ranks: in each shard every term's
largest impact is known, and a document's bound is the sum of the largest impacts of the terms that it holds.  The pivot
is the first term, from the weakest up, at which that sum reaches the score needed to enter the heap: documents with none
of the terms from the pivot on are never looked at, and of the others only those whose bound reaches that score are
scored, most promising first.  Heaps go on from shard to shard within a task and are merged by rank at the end.

WAND moves one document at a time; here its test is made for a shard's documents at once, in arrays.  It skips what WAND
would skip with the heap as it stands at that moment.

Items go out in passes of at most ``pass_chars`` characters; a larger query set takes more passes over the documents.

Defined results: a null or empty text has no terms and is never found; rows are documents, so repeated rows count and rank
each; an item without terms, or whose terms are in no document or weigh nothing, finds none; equal scores rank by id, null
first; repeated items each have their own result; an empty table or query set gives an empty result.  Further columns
play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, c, cut, slices, stored, text_or_empty, tidied
from .terms import LETTERS_AND_DIGITS, cut_terms


def terms_of(text: str | None) -> list[bytes]:
    return [t for some in cut_terms((text or "").encode(), LETTERS_AND_DIGITS) for t in some]


def _indexed(held, shard_docs: int, shard_postings: int, id_type: pa.DataType):
    """Shards from a task's documents, a row each: their ids and lengths, and the postings of known terms, term by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = held.value
        ids: list[pa.Array] = []
        lengths: list[int] = []
        posted: tuple[list[int], list[int], list[int]] = ([], [], [])  # term, document, how often

        def row() -> pa.RecordBatch:
            term, doc, tf = (np.asarray(x, "i4") for x in posted)
            order = np.lexsort((doc, term))
            found, sizes = np.unique(term, return_counts=True)
            wrap = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([sum(1 for n in lengths if n)], pa.int64()),
                    pa.array([sum(lengths)], pa.int64()),
                    wrap(found, pa.int32()),
                    wrap(sizes, pa.int32()),
                    wrap(doc[order], pa.int32()),
                    wrap(tf[order], pa.int32()),
                    wrap(pa.concat_arrays(ids) if ids else pa.array([], id_type), id_type),
                    wrap(lengths, pa.int64()),
                ],
                ["n_docs", "n_terms", "terms", "sizes", "docs", "tfs", "ids", "lengths"],
            )
            ids.clear(), lengths.clear()
            for x in posted:
                x.clear()
            return made

        for whole in batches:
            for batch in slices(whole, 0):
                for i, text in enumerate(batch.column(0)):
                    counts: Counter = Counter()
                    n = 0
                    for terms in cut_terms(text.as_buffer().to_pybytes(), LETTERS_AND_DIGITS):
                        counts.update(terms)
                        n += len(terms)
                    if not n:
                        continue
                    for term, tf in counts.items():
                        k = number.get(term)
                        if k is not None:
                            posted[0].append(k), posted[1].append(len(lengths)), posted[2].append(tf)
                    ids.append(batch.column(1).slice(i, 1))
                    lengths.append(n)
                    if len(lengths) >= shard_docs or len(posted[0]) >= shard_postings:
                        yield row()
        if lengths:
            yield row()

    return tidied(run)


def lengthiness(lengths: np.ndarray, docs: int, terms: int, base: int, slope: int) -> np.ndarray:
    """base + (slope * length * docs) div terms; in numbers of any size where 64 bits don't hold the product."""
    if len(lengths) and slope * int(lengths.max()) * docs >= 1 << 63:
        return np.array([base + slope * int(n) * docs // terms for n in lengths], "i8")
    return base + slope * lengths * docs // terms


class Shard:
    """A shard's postings with what each adds to a score."""

    def __init__(self, terms, sizes, docs, tfs, norm, weights):
        ends = np.cumsum(sizes)
        w = np.repeat(weights[terms], sizes)
        impact = w * ((1_000_000_000 * tfs.astype("i8")) // (1000 * tfs.astype("i8") + 20 * norm[docs]))
        self.lists = {int(t): (docs[e - n : e], impact[e - n : e]) for t, n, e in zip(terms, sizes, ends, strict=True)}
        self.most = {t: int(x.max()) for t, (_, x) in self.lists.items()}
        self.size = len(norm)

    def best(self, terms: list[int], enough: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all that may be among the ``k`` best and reach ``enough``, ties included."""
        held = sorted((t for t in terms if self.most.get(t, 0) > 0), key=lambda t: (self.most[t], t))
        none = np.empty(0, "i8"), np.empty(0, "i8")
        enough, reach, pivot = max(enough, 1), 0, len(held)
        for i, t in enumerate(held):
            reach += self.most[t]
            if reach >= enough:
                pivot = i
                break
        if pivot == len(held):
            return none
        docs = np.concatenate([self.lists[t][0] for t in held])
        at = np.cumsum([0, *(len(self.lists[t][0]) for t in held)])
        seen = np.zeros(self.size, bool)
        seen[docs[at[pivot] :]] = True
        bound = np.bincount(docs, weights=np.repeat([float(self.most[t]) for t in held], np.diff(at)), minlength=self.size)
        pivots = np.flatnonzero(seen & (bound >= enough))
        if not len(pivots):
            return none
        pivots = pivots[np.argsort(-bound[pivots], kind="stable")]
        slot = np.full(self.size, -1, "i4")
        found, scores = [], []
        kept = np.empty(0, "i8")
        a, step = 0, 4 * k
        while a < len(pivots) and bound[pivots[a]] >= enough:
            some = pivots[a : a + step]
            slot[some] = np.arange(len(some))
            total = np.zeros(len(some), "i8")
            for t in held:
                own, impact = self.lists[t]
                where = slot[own]
                hit = where >= 0
                total[where[hit]] += impact[hit]
            slot[some] = -1
            good = total >= enough
            found.append(some[good]), scores.append(total[good])
            kept = np.sort(np.concatenate([kept, total[good]]))[::-1][:k]
            if len(kept) == k:
                enough = max(enough, int(kept[-1]))
            a, step = a + step, 4 * step
        docs, total = np.concatenate(found), np.concatenate(scores)
        good = total >= enough
        return docs[good], total[good]


class Heap:
    """The best so far of one item: scores falling, ids rising."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def enough(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], ids: list) -> None:
        rows = self.rows + [(-s, x is not None, x) for s, x in zip(scores, ids, strict=True)]
        rows.sort(key=lambda r: r if r[1] else r[:2])
        self.rows = rows[: self.k]


def _ranked(held, docs: int, terms: int, k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = held.value
        heaps = [Heap(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                t, sizes, d, tfs, ids, lengths = (batch.column(j)[i].values for j in range(6))
                shard = Shard(t.to_numpy(), sizes.to_numpy(), d.to_numpy(), tfs.to_numpy(), lengthiness(lengths.to_numpy(), docs, terms, 50, 50), weights)
                for (_, wanted), heap in zip(items, heaps, strict=True):
                    found, scores = shard.best(wanted, heap.enough, k)
                    if len(found):
                        heap.add(scores.tolist(), ids.take(pa.array(found)).to_pylist())
        for (place, _), heap in zip(items, heaps, strict=True):
            if heap.rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place] * len(heap.rows), pa.int64()), pa.array([r[2] for r in heap.rows], id_type), pa.array([-r[0] for r in heap.rows], pa.int64())], ["place", "id", "score"]
                )

    return tidied(run)


def search(
    df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 50, shard_docs: int = 4096, shard_postings: int = 1 << 18, pass_chars: int = 4 << 20
) -> DataFrame:
    """Per item its ``top`` documents: item, rank, id, score.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))); a document of n terms, where the average is L / N, scores
    the sum over the item's terms of weight * ((10**9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L.  Only scores
    above 0 count.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    kind, item_kind = df.schema[id_col].dataType, items.schema[item_col].dataType.simpleString()
    arrow_kind = to_arrow_type(kind)
    asked = cut(items.select(c(item_col).alias("item"), text_or_empty(item_text_col).alias("text")).withColumn("place", F.monotonically_increasing_id()))
    passes = max(1, -(-int(asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // pass_chars))
    docs = df.select(F.encode(text_or_empty(text_col), "UTF-8").alias("text"), c(id_col).alias("id"))
    found = None
    for p in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("place"), F.lit(passes)) == p).select("place", "text").orderBy("place").collect()
        wanted = [(r[0], sorted(set(terms_of(r[1])))) for r in mine]
        number = {t: i for i, t in enumerate(sorted({t for _, ts in wanted for t in ts}))}
        shape = f"n_docs long, n_terms long, terms array<int>, sizes array<int>, docs array<int>, tfs array<int>, ids array<{kind.simpleString()}>, lengths array<long>"
        index = stored(docs.mapInArrow(_indexed(spark.sparkContext.broadcast(number), shard_docs, shard_postings, arrow_kind), shape), "postings")
        n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        per_term = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("_t")).groupBy("_t.terms").agg(F.sum("_t.sizes").cast("long")).collect()
        weights = np.zeros(len(number) + 1, "i8")
        for t, df_ in per_term:  # a row for each term of the items in this pass
            weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df_ + 1)))
        held = spark.sparkContext.broadcast(([(place, [number[t] for t in ts]) for place, ts in wanted], weights))
        best = index.select("terms", "sizes", "docs", "tfs", "ids", "lengths").mapInArrow(_ranked(held, n, total, top, arrow_kind), f"place long, id {kind.simpleString()}, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("place", "item"), "place").select(F.col("item").cast(item_kind).alias("item"), F.col("rank").cast("int").alias("rank"), "id", "score")

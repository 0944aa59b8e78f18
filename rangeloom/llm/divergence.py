"""Source divergence audit: how far the sources of a language are apart in their use of words, and by which words.

Terms are counted once, by language, source and term.  Only counts of the terms that enough documents of a language hold
are stored.  These terms are sorted and cut into arrays of neighbours: the dictionary.  A term's place in it is its
number, so numbers have the order of the terms' UTF-8, which settles ties.  Counts are encoded against these arrays (a
binary search each) and binned into one dense vector per group and array.  Shares are whole numbers, so sums over arrays
are exact in any order.

At scale: a term's counts, one a source, meet in one task where its documents are summed (in a window, which spills; pairs of
sources bound them).  A group's counts meet an array's terms in the task of that array; arrays have at most about ``width`` terms,
and an array with many sources or counts is dealt by source to several tasks.  Pairs of sources meet in blocks of about 64 x 64 an array.
Nothing but the first term of each array (at most about 100,000) is broadcast.

Defined results: a null text, language or source is empty; rows are documents, so repeated rows count each; a group whose
texts have no kept term still has its pairs; a language with one source has no pairs; a language without kept terms
has pairs of value 0; an empty table gives an empty result.  Further columns play no part.  Counts must stay below 2**53
and ``scale`` must be a power of 1000.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, slices, stored, text_or_empty, tidied
from .terms import LETTERS, cut_terms

#: Bytes of the digest of a language that stands before a term in its key.
HEAD = 16


def lang_key(lang: str) -> bytes:
    return hashlib.md5(lang.encode(), usedforsecurity=False).digest()


def _counts(hold: int):
    """Rows (key, source, tf, docs) for what a task has counted, handed on whenever it holds ``hold`` terms."""

    def emitted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (tf, docs) in held.items():
            head, terms, times = lang_key(lang), list(tf), list(tf.values())
            for a in range(0, len(terms), 50_000):
                some = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head + t for t in some], pa.binary()), pa.repeat(pa.scalar(source, pa.string()), len(some)), pa.array(times[a : a + 50_000], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    ["key", "source", "tf", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for whole in batches:
            for batch in slices(whole, 0):
                for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    tf, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    seen: set[bytes] = set()
                    for terms in cut_terms(text.as_buffer().to_pybytes(), LETTERS):
                        tf.update(terms)
                        seen.update(terms)
                    docs.update(seen)
                if sum(len(tf) for tf, _ in held.values()) > hold:
                    yield from emitted(held)
                    held.clear()
        yield from emitted(held)

    return tidied(run)


def _packed(width: int):
    """Sorted terms as arrays of at most ``width``, with their counts in the whole language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[bytes] = []
        totals: list[int] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([terms[0]], pa.binary()), pa.array([terms], pa.list_(pa.binary())), pa.array([totals], pa.list_(pa.int64()))], ["first", "terms", "totals"])

        for batch in batches:
            for key, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms.append(key), totals.append(total)
                if len(terms) == width:
                    yield row()
                    terms, totals = [], []
        if terms:
            yield row()

    return tidied(run)


def _placed(held):
    """Adds to each row the number of the array in which its first column belongs; rows before all arrays go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = held.value
        for batch in batches:
            at = np.fromiter((bisect.bisect_right(firsts, k) for k in batch.column(0).to_pylist()), dtype="i4", count=batch.num_rows) - 1
            rows = pa.array(np.flatnonzero(at >= 0))
            yield pa.RecordBatch.from_arrays([*(x.take(rows) for x in batch.columns), pa.array(at[at >= 0], pa.int32())], [*batch.schema.names, "part"])

    return tidied(run)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by array, the array itself first, then the counts source by source: one cell per language, source and
    array, with the places of the terms that occur, their counts and their counts in the whole language."""
    terms, totals, spans = np.empty(0, object), np.empty(0, "i8"), []
    part, source = -1, None
    keys: list[bytes] = []
    counts: list[int] = []
    out: list[list] = [[] for _ in range(7)]

    def close() -> None:
        if keys and len(terms):
            sought = np.empty(len(keys), object)
            sought[:] = keys
            ids = np.searchsorted(terms, sought)
            inside = ids < len(terms)
            inside[inside] = terms[ids[inside]] == sought[inside]
            dense = np.bincount(ids[inside], weights=np.asarray(counts, "f8")[inside], minlength=len(terms)).astype("i8")
            for head, low, high in spans:
                at = np.flatnonzero(dense[low:high]) + low
                if len(at):
                    for column, value in zip(out, (head, source, part, at.astype("i4"), dense[at], totals[at], int(dense[at].sum())), strict=True):
                        column.append(value)
        keys.clear(), counts.clear()

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["head", "source", "part", "ids", "counts", "totals", "n"])
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for row, (kind, p, s, key, tf) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
            if kind == 0:
                close()
                part, source = p, None
                own = batch.column(5)[row].values.to_pylist()
                terms = np.empty(len(own), object)
                terms[:] = own
                totals = batch.column(6)[row].values.to_numpy()
                heads = [t[:HEAD] for t in terms]
                edges = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
                spans = [(heads[a], a, b) for a, b in zip(edges, edges[1:], strict=False)]
                continue
            if s != source:
                close()
                source = s
            keys.append(key), counts.append(tf)
        if len(out[0]) >= 64:
            yield batch_of()
    close()
    if out[0]:
        yield batch_of()


def shares(counts: np.ndarray, n: int, v: int, scale: int, smooth: int) -> np.ndarray:
    """1 + floor(scale * (count + smooth) / (n + smooth * v)), digit group by digit group so that nothing overflows."""
    rest, whole, left = counts + smooth, n + smooth * v, scale
    out = np.zeros_like(rest)
    while left > 1:
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest, left = rest % whole, left // 1000
    return out + 1


def _leading(top: int, scale: int, smooth: int):
    """Of each cell the ``top`` terms whose share in the group is most above that in the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, value = [], [], []
            for i, (ids, counts, totals, n, v, whole) in enumerate(zip(*(batch.column(j) for j in range(3, 9)), strict=True)):
                at = ids.values.to_numpy()
                gain = shares(counts.values.to_numpy(), n.as_py(), v.as_py(), scale, smooth) - shares(totals.values.to_numpy(), whole.as_py(), v.as_py(), scale, smooth)
                best = np.lexsort((at, -gain))[:top]
                best = best[gain[best] > 0]
                row += [i] * len(best)
                pos += at[best].tolist()
                value += gain[best].tolist()
            at_rows = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at_rows) for j in range(3)), pa.array(pos, pa.int32()), pa.array(value, pa.int64())], ["head", "source", "part", "pos", "value"])

    return tidied(run)


def _apart(scale: int, smooth: int):
    """Of two blocks of sources in an array: the sums of differences of each pair, one source from each block."""

    def run(cells: pa.Table) -> pa.Table:
        low, width = cells["low"][0].as_py(), cells["width"][0].as_py()
        rows = cells.num_rows
        share = np.empty((rows, width), "i8")
        for i in range(rows):
            dense = np.zeros(width, "i8")
            if cells["ids"][i].is_valid:
                dense[cells["ids"][i].values.to_numpy() - low] = cells["counts"][i].values.to_numpy()
            share[i] = shares(dense, cells["n_group"][i].as_py(), cells["v"][i].as_py(), scale, smooth)
        blocks, names = cells["block"].to_numpy(), cells["source"].to_pylist()
        first, second = cells["i"][0].as_py(), cells["j"][0].as_py()
        left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
        a, b, value = [], [], []
        for k, x in enumerate(left):
            others = right if first != second else left[k + 1 :]
            for y in others:
                low_name, high_name = sorted((names[x], names[y]))  # the same way round in each array, however its rows come
                a.append(low_name), b.append(high_name), value.append(int(np.abs(share[x] - share[y]).sum()))
        return pa.table({"head": pa.array([cells["head"][0].as_py()] * len(a), pa.binary()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def audit(
    df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50, smooth: int = 5, scale: int = 1_000_000_000, width: int = 8192, hold: int = 400_000, block: int = 64
) -> DataFrame:
    """lang, source, part, item, value, rank.

    A term's share in a group is 1 + floor(scale * (count + smooth) / (N + smooth * V)), where V terms of the language are
    in at least ``min_docs`` of its documents and N is the sum of the group's counts over them.  Part ``pair``: for each
    other source of the language the sum of differences of the shares, largest first.  Part ``term``: the ``top``
    terms of the group whose share is most above that in the whole language.
    """
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    named = df.select(text_or_empty(text_col).alias("text"), text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"))
    head_of = lambda lang: F.unhex(F.md5(lang))
    counted = named.select(F.encode("text", "UTF-8").alias("text"), "lang", "source").mapInArrow(_counts(hold), "key binary, source string, tf long, docs long")
    counted = counted.groupBy("key", "source").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("hash", "key")  # the hash first: keys of a language begin alike, numbers sort faster
    counted = counted.withColumn("hash", F.xxhash64("key")).withColumn("all_docs", F.sum("docs").over(same)).filter(F.col("all_docs") >= min_docs)
    counted = stored(counted.select("key", "source", "tf"), "term-counts")
    kept = cut(counted.groupBy("key").agg(F.sum("tf").alias("total")))
    n_kept = kept.count()
    width = max(width, -(-n_kept // 50_000))
    ranges = max(1, min(-(-n_kept // (8 * width)), 10_000))
    arrays = stored(kept.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(_packed(width), "first binary, terms array<binary>, totals array<long>"), "term-arrays")
    held = spark.sparkContext.broadcast(sorted(bytes(r[0]) for r in arrays.select("first").collect()))
    arrays = arrays.mapInArrow(_placed(held), "first binary, terms array<binary>, totals array<long>, part int").drop("first")

    groups = cut(named.select("lang", "source").distinct().withColumn("head", head_of(F.col("lang"))))
    firsts = len(held.value)
    salts = max(1, -(-groups.count() // 2000), -(-counted.count() // (500_000 * max(firsts, 1))))
    salt = F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    theirs = counted.mapInArrow(_placed(held), "key binary, source string, tf long, part int")
    # lists of counts are empty, not null: Arrow's writer goes over all nulls of a batch again with each row
    theirs = theirs.select(F.lit(1).alias("kind"), "part", "source", "key", "tf", F.array().cast("array<binary>").alias("terms"), F.array().cast("array<long>").alias("totals"), salt.alias("salt"))
    own = arrays.select(F.lit(0).alias("kind"), "part", none("string").alias("source"), none("binary").alias("key"), none("long").alias("tf"), "terms", "totals", F.explode(F.array(*[F.lit(i) for i in range(salts)]) if salts < 100 else F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = own.unionByName(theirs).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind", "source").drop("salt")
    cells = stored(met.mapInArrow(tidied(_encoded), "head binary, source string, part int, ids array<int>, counts array<long>, totals array<long>, n long"), "term-cells")

    entries = arrays.select("part", F.posexplode("terms").alias("pos", "key"), "totals").select("part", "pos", F.substring("key", 1, HEAD).alias("head"), "key", F.element_at("totals", F.col("pos") + 1).alias("total"))
    spans = cut(entries.groupBy("head", "part").agg(F.min("pos").alias("low"), F.count(F.lit(1)).cast("int").alias("width"), F.sum("total").alias("total")))
    langs = spans.groupBy("head").agg(F.sum("width").alias("v"), F.sum("total").alias("n_lang"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    sums = cells.groupBy("head", "source").agg(F.sum("n").alias("n_group"))
    sizes = groups.groupBy("head").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = cut(groups.join(sums, ["head", "source"], "left").join(langs, "head", "left").join(sizes, "head").select("head", "lang", "source", "n_sources", zero("n_group"), zero("v"), zero("n_lang")))

    # terms: the leading ones of each array, then of the group
    measured = cells.join(groups.select("head", "source", "n_group", "v", "n_lang"), ["head", "source"])
    leading = measured.select("head", "source", "part", "ids", "counts", "totals", "n_group", "v", "n_lang").mapInArrow(_leading(top, scale, smooth), "head binary, source string, part int, pos int, value long")
    ranked = Window.partitionBy("head", "source").orderBy(F.desc("value"), "part", "pos")
    terms = leading.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).join(entries.select("part", "pos", "key"), ["part", "pos"])
    terms = terms.select("head", "source", F.lit("term").alias("kind"), F.decode(F.expr(f"substring(key, {HEAD + 1})"), "UTF-8").alias("item"), "value", "rank")

    # pairs: blocks of sources meet in each array
    blocks = F.ceil(F.col("n_sources") / block).cast("int")
    mine = groups.filter("v > 0 and n_sources > 1").withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("_blocks")).cast("int"))
    spread = mine.join(spans.drop("total"), "head").join(cells.select("head", "source", "part", "ids", "counts"), ["head", "source", "part"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = spread.withColumn("_other", other).withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")})
    spread = spread.select("head", "part", "i", "j", "source", "block", "n_group", "v", "low", "width", "ids", "counts")
    sums = spread.groupBy("head", "part", "i", "j").applyInArrow(_apart(scale, smooth), "head binary, a string, b string, value long").groupBy("head", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("head", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_p"), "value").select("head", "_p.*", "value")
    bare = groups.filter("v = 0").select("head", "source")
    equal = bare.join(bare.withColumnRenamed("source", "item"), "head").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("head", "source").orderBy(F.desc("value"), "item")
    pairs = both.unionByName(equal).withColumn("rank", F.row_number().over(order)).select("head", "source", F.lit("pair").alias("kind"), "item", "value", "rank")

    names = groups.select("head", "lang").distinct()
    return pairs.unionByName(terms).join(names, "head").select("lang", "source", F.col("kind").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))

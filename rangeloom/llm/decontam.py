"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with up to ``rate`` of its characters edited.  With a budget of k edits the item is cut
into k + 1 pieces; wherever it occurs, at least one piece occurs exactly.  All pieces are searched at once (an
Aho-Corasick automaton), and each piece found is extended: the pieces form a binary tree, and a node of s pieces must
occur with at most s - 1 edits around the place, up to the whole item with k.  Distances come from Myers' bit-parallel
algorithm.  Chance hits end at the first node, two pieces long.

Items go to the executors in passes of at most ``pass_chars`` characters; a larger benchmark takes more passes over the
documents, not more memory.

Texts are compared in lower case with runs of white space as one blank.  Defined results: null, empty or blank texts and
items match nothing; every item has the budget int(rate * its characters), and those of fewer than ``least_chars``
characters must besides occur from a word's beginning to a word's end (short names stand inside longer words by chance);
items of fewer than ``least_words`` words match nothing; repeated items and rows each give their own result; of several occurrences in a document the nearest counts; null ids are ids like others; an empty table or
benchmark gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, c, cut, fresh, slices, text_or_empty, tidied


def normal(text: str) -> str:
    return " ".join(text.lower().split())


#: Letters of scripts that put no blanks between words: each side of one may be a word's end.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def bounded(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] begins and ends at word boundaries."""
    spaced = lambda ch: ch.isalnum() and not UNSPACED.match(ch)
    inside = lambda i: 0 < i < len(text) and spaced(text[i - 1]) and spaced(text[i])
    return not inside(a) and not inside(b)


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def least_distance(mask: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between a pattern of m characters and any part of the text (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    get = mask.get
    for ch in text:
        eq = get(ch, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(x | up)) & full
        minus = up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus <<= 1
        minus <<= 1
        eq |= down
        up = (minus | ~(eq | plus)) & full
        down = plus & eq & full
    return best


def edits(a: str, b: str) -> int:
    """The edit distance of two short texts."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


class Item:
    """An item, its pieces, and for each piece the nodes of the tree above it."""

    def __init__(self, key: int, text: str, rate: float, short: bool = False):
        self.key, self.text, self.short = key, text, short
        k = int(len(text) * rate)
        self.budget = k
        cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
        self.pieces = [(cuts[i], text[cuts[i] : cuts[i + 1]]) for i in range(k + 1)]
        self.above: list[list[tuple[int, int, int]]] = [[] for _ in self.pieces]
        self._split(0, k + 1, cuts)
        self.masks: dict[tuple[int, int], dict[str, int]] = {}

    def _split(self, a: int, b: int, cuts: list[int]) -> None:
        if b - a > 1:
            mid = (a + b) // 2
            self._split(a, mid, cuts)
            self._split(mid, b, cuts)
            for i in range(a, b):
                self.above[i].append((cuts[a], cuts[b], b - a - 1))

    def at(self, text: str, place: int, piece: int) -> int | None:
        """The distance of the item's occurrence around a piece found at ``place``, if within the budget."""
        first = place - self.pieces[piece][0]
        distance = 0
        for a, b, most in self.above[piece]:
            mask = self.masks.get((a, b))
            if mask is None:
                mask = self.masks[a, b] = masks(self.text[a:b])
            distance = least_distance(mask, b - a, text[max(0, first + a - most) : first + b + most])
            if distance > most:
                return None
        return self.between_words(text, first) if self.short else distance

    def between_words(self, text: str, first: int) -> int | None:
        """The least distance, within the budget, of a stretch from a word's beginning to a word's end that starts and ends
        where an occurrence at ``first`` may."""
        k, last = self.budget, first + len(self.text)
        near = [edits(self.text, text[a:b]) for a in range(max(0, first - k), first + k + 1) for b in range(max(a, last - k), min(len(text), last + k) + 1) if bounded(text, a, b)]
        return min((d for d in near if d <= k), default=None)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int = 0):
        import ahocorasick

        self.items = [Item(key, text, rate, len(text) < least_chars) for key, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for j, (_, piece) in enumerate(item.pieces):
                found.setdefault(piece, []).append((i, j))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def find(self, text: str) -> dict[int, int]:
        """Item's place in the list -> least distance found in the text (which is normal)."""
        best: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()
        if not self.any or not text:
            return best
        for end, (length, owners) in self.automaton.iter(text):
            place = end - length + 1
            for i, j in owners:
                if best.get(i) == 0:
                    continue
                item = self.items[i]
                first = place - item.pieces[j][0]
                if i in best and (i, first, -1) in tried:
                    continue  # the same alignment has been measured
                distance = item.at(text, place, j)
                if distance is not None:
                    tried.add((i, first, -1))
                    best[i] = min(distance, best.get(i, distance))
        return best


_matcher: dict[int, tuple[object, Matcher]] = {}


def _hits(held, rate: float, n: int, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        cached = _matcher.get(0)
        if cached is None or cached[0] is not items:
            cached = _matcher[0] = (items, Matcher(items, rate, least_chars))
        matcher = cached[1]
        for whole in batches:
            for batch in slices(whole, 0):
                row, item, distance, chars = [], [], [], []
                for r, text in enumerate(batch.column(0).to_pylist()):
                    for i, d in matcher.find(normal(text)).items():
                        row.append(r), item.append(matcher.items[i].key), distance.append(d), chars.append(len(matcher.items[i].text))
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(1, n + 1)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(chars, pa.int32())], [*batch.schema.names[1:], "place", "distance", "item_chars"])

    return tidied(run)


def find_leaks(
    df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.1, least_chars: int = 20, least_words: int = 1, pass_chars: int = 4 << 20
) -> DataFrame:
    """Per document and item that occurs in it: id, item, distance, item_chars (of the item as it is compared).

    Items of fewer than ``least_chars`` characters must occur between word boundaries; those of fewer than
    ``least_words`` words are left out.
    """
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(c(item_col).alias("item"), text_or_empty(item_text_col).alias("text")).filter(F.length("text") > 0)
    items = cut(items.withColumn("place", F.monotonically_increasing_id()))
    passes = max(1, -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // pass_chars))
    docs = df.select(text_or_empty(text_col).alias("text"), c(id_col).alias("id"))
    found = None
    for p in range(passes):
        some = items.filter(F.pmod(F.xxhash64("place"), F.lit(passes)) == p).select("place", "text").orderBy("place").collect()
        normed = [(r[0], normal(r[1])) for r in some]
        held = spark.sparkContext.broadcast([(k, t) for k, t in normed if t and t.count(" ") + 1 >= least_words])
        hits = docs.mapInArrow(_hits(held, rate, 1, least_chars), f"id {kind}, place long, distance int, item_chars int")
        found = hits if found is None else found.unionByName(hits)
    named = items.select("place", "item")
    return found.join(named, "place").select("id", F.col("item").cast(item_kind).alias("item"), "distance", "item_chars")


def without_leaks(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The rows of ``df``, with all their columns, in which no item occurs.

    The texts that go are known by their digests; up to ``broadcast_rows`` of them are sent to the executors, more are
    joined by shuffling.
    """
    (digest,) = fresh(df, "digest")
    keyed = df.withColumn(digest, F.unhex(F.md5(text_or_empty(text_col))))
    leaks = cut(find_leaks(keyed, benchmark, id_col=digest, text_col=text_col, **options).select(F.col("id").alias(digest)).distinct())
    if leaks.limit(broadcast_rows + 1).count() <= broadcast_rows:
        leaks = F.broadcast(leaks)
    return keyed.join(leaks, digest, "left_anti").drop(digest)

"""The least and largest item between two places, for very many asks at once: sparse tables over blocks.

Items stand at places in a group and are cut into blocks of neighbours.  An ask that lies in one block is answered there;
any other gets a ragged part in its first and its last block and a whole stretch of blocks between them.  That stretch is
answered the same way from a row per block.  In a block a sparse table (the least rank of each power-of-two stretch)
gives each answer from two entries, so the work grows with items and asks, not with what lies between.

Blocks hold bounded numbers of items; a block with very many asks is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..sources.scratch import kept
from .sweep import ROWS, gridded

#: The parts of an answer: value and place of the extreme, and where its item ends.
PARTS = ("value", "start", "end")


class Table:
    """Sparse tables over a block's items: the least by (value, place), the largest by (value, earliest place)."""

    def __init__(self, items: pa.Table):
        self.items = items
        self.at = items["at"].to_numpy()
        n = len(self.at)
        self.least = self._levels([("lo_value", "ascending"), ("lo_start", "ascending")], n)
        self.largest = self._levels([("hi_value", "descending"), ("hi_start", "ascending")], n)

    def _levels(self, keys: list[tuple[str, str]], n: int) -> tuple[list[np.ndarray], np.ndarray]:
        order = pc.sort_indices(self.items, sort_keys=keys, null_placement="at_end").to_numpy()
        if keys[0][1] == "descending" and pa.types.is_floating(self.items["hi_value"].type):
            # NaN is the largest number here; sorting leaves it behind all others in either direction
            nan = pc.is_nan(self.items["hi_value"]).to_numpy(zero_copy_only=False)[order]
            order = np.concatenate([order[nan], order[~nan]])
        rank = np.empty(n, "i8")
        rank[order] = np.arange(n)
        levels = [rank]
        while 2 << (len(levels) - 1) <= n:
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        return levels, order

    def answer(self, low: np.ndarray, high: np.ndarray) -> dict[str, pa.Array]:
        first = np.searchsorted(self.at, low, "left")
        last = np.searchsorted(self.at, high, "right") - 1
        some = np.flatnonzero(first <= last)
        a, b = first[some], last[some]
        level = np.frexp((b - a + 1).astype("f8"))[1] - 1
        out = {}
        for side, (levels, order) in (("lo", self.least), ("hi", self.largest)):
            rank = np.empty(len(some), "i8")
            for k in np.unique(level):
                here = level == k
                rank[here] = np.minimum(levels[k][a[here]], levels[k][b[here] - (1 << k) + 1])
            index = np.full(len(low), -1, "i8")
            index[some] = order[rank]
            taken = pa.array(index, mask=index < 0)
            for part in PARTS:
                out[f"{side}_{part}"] = self.items[f"{side}_{part}"].take(taken).combine_chunks()
        return out


def _edges(batch: pa.RecordBatch, columns: Sequence[str]) -> list[int]:
    """Where a batch's rows change in any of the columns."""
    found = {0, batch.num_rows}
    for name in columns:
        ends = pc.run_end_encode(batch.column(batch.schema.get_field_index(name))).run_ends.to_pylist()
        found.update(ends)
    return sorted(found)


def _answered(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, table = None, [], None
        for batch in batches:
            marks = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            kinds = batch.column(batch.schema.get_field_index("_kind"))
            edges = _edges(batch, [*keys, "_kind"])
            for a, b in zip(edges, edges[1:], strict=False):
                key = tuple(m[a].as_py() for m in marks)
                if key != group:
                    group, held, table = key, [], None
                part = batch.slice(a, b - a)
                if kinds[a].as_py() == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if table is None:
                    table = Table(pa.Table.from_batches(held).combine_chunks())
                column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
                found = table.answer(column("_low").to_numpy(), column("_high").to_numpy())
                yield pa.RecordBatch.from_arrays([column("_ask"), *found.values()], ["_ask", *found])

    return run


def _met(items: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """Answers to asks (keys, _ask, _low, _high) that each lie in one block of the items (keys, at, lo and hi parts)."""
    crowd = asks.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (4 * ROWS)).cast("int").alias("_salts"))
    asks = asks.join(crowd, keys).withColumn("_salt", F.pmod(F.xxhash64("_ask"), F.col("_salts")).cast("int")).drop("_salts")
    items = items.join(crowd, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    sides = [f"{s}_{p}" for s in ("lo", "hi") for p in PARTS]
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    rows = items.select(*keys, "_salt", F.lit(0).alias("_kind"), "at", *sides, none(asks, "_ask"), none(asks, "_low"), none(asks, "_high"))
    rows = rows.unionByName(asks.select(*keys, "_salt", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("at"), *[none(items, x) for x in sides], "_ask", "_low", "_high"))
    shape = StructType().add("_ask", asks.schema["_ask"].dataType)
    for name in sides:
        shape = shape.add(name, items.schema[name].dataType)
    order = [*keys, "_salt", "_kind", "at"]
    return rows.repartition(*keys, "_salt").sortWithinPartitions(*order).mapInArrow(_answered([*keys, "_salt"]), shape)


def between(runs: DataFrame, asks: DataFrame) -> DataFrame:
    """Per ask (space, rid, low, high) the extremes among the runs (space, start, end, value) that start between low and
    high and have a value: space, rid, and the structs lo and hi (value, start, end).  Asks without any are left out.

    Equal values: the first run.  ``runs`` are read several times, so they should be stored.
    """
    asks = kept(asks, "asks")
    some = runs.filter(F.col("value").isNotNull()).select("space", F.col("start").cast("long"), F.col("end").cast("long"), "value")
    grid, block = gridded(some, "start")
    placed = some.join(grid, "space").withColumn("_block", block("start")).select("space", "_block", F.col("start").alias("at"), *[F.col(p).alias(f"{s}_{p}") for s in ("lo", "hi") for p in PARTS])
    ask = F.struct("space", "rid").alias("_ask")
    wanted = asks.select("space", ask, F.col("low").cast("long").alias("_low"), F.col("high").cast("long").alias("_high")).filter("_low <= _high")
    wanted = wanted.join(grid, "space").withColumns({"_first": block("_low"), "_last": block("_high")}).select("space", "_ask", "_low", "_high", "_first", "_last")
    # the part in the first block, and in the last if that is another; places beyond a block's items ask for all of them
    ends = F.array_distinct(F.array("_first", "_last"))
    ragged = wanted.withColumn("_block", F.explode(ends)).select("space", "_block", "_ask", "_low", "_high")
    parts = _met(placed, ragged, ["space", "_block"])
    whole = wanted.filter("_last - _first > 1").select("space", "_ask", (F.col("_first") + 1).alias("_low"), (F.col("_last") - 1).alias("_high"))
    least = F.min(F.struct(*[F.col(f"lo_{p}").alias(p) for p in PARTS]))
    most = F.max(F.struct(F.col("hi_value").alias("value"), (-F.col("hi_start")).alias("_early"), F.col("hi_start").alias("start"), F.col("hi_end").alias("end")))
    blocks = placed.groupBy("space", "_block").agg(least.alias("lo"), most.alias("hi"))
    blocks = blocks.select("space", F.col("_block").cast(LongType()).alias("at"), *[F.col(f"{s}.{p}").alias(f"{s}_{p}") for s in ("lo", "hi") for p in PARTS])
    parts = parts.unionByName(_met(blocks, whole, ["space"])).filter("lo_start is not null")
    pack = lambda s: F.struct(*[F.col(f"{s}.{p}").alias(p) for p in PARTS]).alias(s)
    return parts.groupBy("_ask").agg(least.alias("lo"), most.alias("hi")).select("_ask.space", "_ask.rid", pack("lo"), pack("hi"))

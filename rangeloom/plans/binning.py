"""Interval joins as equi-joins on bins.

Both sides are dealt to bins; ranges that meet share a bin.  A pair that shares several bins is kept in the first of them
alone, so nothing has to be made distinct.

Wide ranges would fill very many bins, so there are levels, each with bins ``STEP`` times as wide as the one below.  A
range's own level is the finest on which it fills few bins.  A pair meets on the higher of its two levels: there one side
stands in bins of its own level and the other, if its level is lower, in one or two wide ones.  The join key, a cell, is
a bin's number with its level and the side that is at home there, so that two narrow ranges never meet in a wide bin.
Rows are moved with that one number beside their own columns.

Bins are fitted to the data: their width and number of levels come from the widths on both sides, and bins in which very
many rows of either side stand are cut into sub-blocks, so that a rectangle of tasks takes the place of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

STEP = 32


@dataclass(frozen=True)
class Bins:
    """Width of the finest bins and number of levels."""

    width: int = 64
    levels: int = 4

    def size(self, level: Column) -> Column:
        return F.element_at(F.array(*[F.lit(self.width * STEP**k).cast("long") for k in range(self.levels)]), level + 1)

    def level(self, extent: Column) -> Column:
        out = F.lit(self.levels - 1)
        for k in range(self.levels - 2, -1, -1):
            out = F.when(extent < self.width * STEP**k * 8, k).otherwise(out)
        return out


def tune(*sides: DataFrame) -> Bins:
    """Bins for given data (start, end), from one pass over the widths."""
    return fitted(*[df.select((F.col("end") - F.col("start") + 1).alias("_extent")) for df in sides])


def fitted(*extents: DataFrame) -> Bins:
    """Bins for rows of which ``_extent`` tells how far they reach: as wide as the upper quartile on the wider side, and
    levels up to the widest."""
    each = [df.select(F.lit(i).alias("_side"), "_extent") for i, df in enumerate(extents)]
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    rows = both.groupBy("_side").agg(F.percentile_approx("_extent", 0.75, 100), F.max("_extent")).collect()
    top, largest = max((1, *(r[1] or 1 for r in rows))), max((1, *(r[2] or 1 for r in rows)))
    levels = 1
    while top * 8 * STEP ** (levels - 1) < largest:
        levels += 1
    return Bins(int(top), levels)


def edges(start: Column, end: Column) -> tuple[Column, Column]:
    """The positions that a range occupies; an empty one occupies the two around its place."""
    return F.least(start, end), F.greatest(start, end)


#: The join keys of both sides, and the rows of one side in a cell from which it is cut.
KEYS = ("space", "_cell")
BLOCK = 1 << 14


def cut_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *, block: int = BLOCK, most: int = 100_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both dealt sides with the further join keys that cut overfull bins: a left row stands in one row of a rectangle of
    blocks, a right row in one column, and each pair meets in one block.

    Bins are counted once, with partial sums before the shuffle.  Their list is broadcast if it is found to be short.
    """
    sides = [df.select(*KEYS, F.lit(a).cast("long").alias("_l"), F.lit(1 - a).cast("long").alias("_r")) for df, a in ((left, 1), (right, 0))]
    full = sides[0].unionByName(sides[1]).groupBy(*KEYS).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).filter((F.greatest("_l", "_r") > block) & (F.least("_l", "_r") > 0))
    full = kept(full.select(*KEYS, F.ceil(F.col("_l") / block).cast("int").alias("_rows"), F.ceil(F.col("_r") / block).cast("int").alias("_columns")), "full-bins")
    n = full.limit(most + 1).count()
    if n == 0:
        return left, right, []
    full = F.broadcast(full) if n <= most else full
    one = lambda name: F.coalesce(name, F.lit(1))
    own = lambda key, name: F.pmod(F.xxhash64(key), one(name)).cast("int")
    all_ = lambda name: F.explode(F.sequence(F.lit(0), one(name) - 1))
    left = left.join(full, list(KEYS), "left").withColumn("_row", own(left_id, "_rows")).withColumn("_column", all_("_columns")).drop("_rows", "_columns")
    right = right.join(full, list(KEYS), "left").withColumn("_column", own(right_id, "_columns")).withColumn("_row", all_("_rows")).drop("_rows", "_columns")
    return left, right, ["_row", "_column"]


def dealt(df: DataFrame, low: Column, high: Column, bins: Bins, side: str) -> DataFrame:
    """One side of the join: a row per cell in which a row stands between ``low`` and ``high``, with _cell.

    The query side is at home ("q") on its own level and a guest ("s" is at home) above it; the subject side is at home
    on its own level and a guest there and above.
    """
    bin_ = lambda at, size: F.floor(at / size).cast("long")
    if bins.levels == 1:
        return df.withColumn("_cell", F.explode(F.sequence(bin_(low, F.lit(bins.width)), bin_(high, F.lit(bins.width)))))
    own, top = bins.level(high - low), F.lit(bins.levels - 1)
    above = F.when(own < top, F.sequence(own + 1, top)).otherwise(F.expr("array()").cast("array<int>"))
    roles = lambda levels, guest: F.transform(levels, lambda k: k * 2 + guest)
    here = F.array(own)
    out = df.withColumn("_role", F.explode(F.concat(roles(here, 0), roles(above, 1)) if side == "q" else F.concat(roles(F.concat(here, above), 0), roles(here, 1))))
    size, role = bins.size(F.shiftright("_role", 1)), F.col("_role")
    cells = F.transform(F.sequence(bin_(low, size), bin_(high, size)), lambda b: b * (2 * bins.levels) + role)
    return out.withColumn("_cell", F.explode(cells)).drop("_role")


def first_cell(cell: Column, low: Column, bins: Bins) -> Column:
    """Whether a cell is the first that two rows share, which stand from ``low`` on (the larger of their two)."""
    if bins.levels == 1:
        return cell == F.floor(low / bins.width).cast("long")
    role = F.pmod(cell, F.lit(2 * bins.levels))
    return cell == F.floor(low / bins.size(F.shiftright(role.cast("int"), 1))).cast("long") * (2 * bins.levels) + role

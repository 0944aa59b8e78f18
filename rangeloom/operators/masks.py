"""Masks: named sets of normal ranges over [1, width], any number of which can be active.

A collection is two tables: masks (mask_id, name, desc, active, width) and ranges (mask_id, start, end).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intra
from ..plans.sweep import preceding
from ..sources.scratch import kept
from .algebra import gaps as _gaps
from .algebra import reduce

MASKS = "mask_id long, name string, desc string, active boolean, width long"


def _spaced(ranges: DataFrame) -> DataFrame:
    return ranges.select(F.col("mask_id").alias("space"), F.monotonically_increasing_id().alias("rid"), "start", "end")


@dataclass(frozen=True)
class Masks:
    masks: DataFrame
    ranges: DataFrame

    def measured(self) -> DataFrame:
        """Per mask: name, active, masked_width, masked_ratio, first and last masked position."""
        sums = self.ranges.groupBy("mask_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("masked_width"), F.min("start").alias("first"), F.max("end").alias("last"))
        out = self.masks.join(sums, "mask_id", "left").withColumn("masked_width", F.coalesce("masked_width", F.lit(0)))
        return out.select("mask_id", "name", "active", "masked_width", (F.col("masked_width") / F.col("width")).alias("masked_ratio"), "first", "last")

    def collapse(self) -> Masks:
        """One mask: the union of the active ones."""
        on = self.masks.filter("active")
        some = self.ranges.join(on.select("mask_id"), "mask_id", "left_semi").withColumn("mask_id", F.lit(1).cast("long"))
        one = reduce(_spaced(some), drop_empty=True).select(F.col("space").alias("mask_id"), "start", "end")
        head = self.masks.agg(F.max("width").alias("width")).select(F.lit(1).cast("long").alias("mask_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("desc"), F.lit(True).alias("active"), "width")
        return Masks(head, one)

    def append(self, other: Masks) -> Masks:
        """Both collections; the other's masks are numbered behind."""
        n = self.masks.agg(F.coalesce(F.max("mask_id"), F.lit(0)).alias("_n"))
        move = lambda df: df.crossJoin(F.broadcast(n)).withColumn("mask_id", F.col("mask_id") + F.col("_n")).drop("_n")  # noqa: E731  (one row)
        return Masks(self.masks.unionByName(move(other.masks)), self.ranges.unionByName(move(other.ranges)))

    def subset(self, *numbers: int) -> Masks:
        """Some masks by number; a number twice is an error."""
        if len(set(numbers)) < len(numbers):
            raise ValueError("a mask can't be taken twice")
        keep = lambda df: df.filter(F.col("mask_id").isin(list(numbers)))
        return Masks(keep(self.masks), keep(self.ranges))

    def activate(self, which: Column, on: bool = True) -> Masks:
        return replace(self, masks=self.masks.withColumn("active", F.when(which, F.lit(on)).otherwise(F.col("active"))))

    def named(self, names: Column, desc: Column | None = None) -> Masks:
        out = self.masks.withColumn("name", names)
        return replace(self, masks=out if desc is None else out.withColumn("desc", desc))

    def gaps(self) -> Masks:
        """What each mask leaves free; names and descriptions are reset."""
        spaces = self.masks.select(F.col("mask_id").alias("space"))
        wide = _gaps_by_width(_spaced(self.ranges), self.masks, spaces)
        head = self.masks.withColumns({"name": F.lit(None).cast("string"), "desc": F.lit(None).cast("string")})
        return Masks(head, wide.select(F.col("space").alias("mask_id"), "start", "end"))

    def narrow(self, start: int, end: int) -> Masks:
        """All masks cut to [start, end], which becomes [1, end - start + 1]."""
        cut = intra.restrict(_spaced(self.ranges), start, end, drop_empty=True)
        moved = intra.shift(cut, 1 - start).select(F.col("space").alias("mask_id"), "start", "end")
        return Masks(self.masks.withColumn("width", F.lit(end - start + 1).cast("long")), moved)

    def reverse(self) -> Masks:
        both = self.ranges.join(self.masks.select("mask_id", "width"), "mask_id")
        return replace(self, ranges=both.select("mask_id", (F.col("width") + 1 - F.col("end")).alias("start"), (F.col("width") + 1 - F.col("start")).alias("end")))


def _gaps_by_width(ranges: DataFrame, masks: DataFrame, spaces: DataFrame) -> DataFrame:
    """Gaps in [1, width] where each mask has its own width: gaps without an upper bound, then the tail."""
    widths = masks.select(F.col("mask_id").alias("space"), "width")
    top = ranges.groupBy("space").agg(F.max("end").alias("_top"))
    inner = _gaps(ranges, 1, None, spaces=spaces)
    tail = widths.join(top, "space", "left").select("space", (F.coalesce("_top", F.lit(0)) + 1).alias("start"), F.col("width").alias("end")).filter("end >= start")
    return inner.select("space", "start", "end").unionByName(tail)


def mask(spark: SparkSession, width: int, ranges: DataFrame, *, name: str | None = None, desc: str | None = None, beyond: bool = False) -> Masks:
    """One active mask from normal ranges (start, end); ranges that aren't normal or leave [1, width] are an error.

    With ``beyond`` the width is only what ratios are taken of, and ranges may go over it.
    """
    head = spark.createDataFrame([(1, name, desc, True, width)], MASKS)
    ranges = preceding(kept(ranges.select("start", "end"), "mask"), {"_before": F.col("end")}, "start", ["start", "end"], by=())
    wrong = (F.col("end") < F.col("start")) | (F.col("start") < 1) | (F.lit(not beyond) & (F.col("end") > width)) | F.coalesce(F.col("start") < F.col("_before") + 2, F.lit(False))
    checked = ranges.withColumn("start", F.when(wrong, F.raise_error(F.lit("the ranges of a mask must be normal")).cast("long")).otherwise(F.col("start")))
    return Masks(head, checked.select(F.lit(1).cast("long").alias("mask_id"), "start", "end"))


def empty(spark: SparkSession, width: int | None, *, name: str | None = None) -> Masks:
    """A mask of nothing, which needs a known width."""
    if width is None:
        raise ValueError("no rows for this sequence, and its width is unknown")
    return Masks(spark.createDataFrame([(1, name, f"{name} (empty)" if name else None, True, width)], MASKS), spark.createDataFrame([], "mask_id long, start long, end long"))

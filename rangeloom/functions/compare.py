"""Comparisons of paired ranges, as column expressions, and exact matches between frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import col, fail_if
from ..plans.sweep import chunked, preceding, swept

Bounds = tuple[Column, Column]


def _of(start: Column | str, end: Column | str) -> Bounds:
    return col(start), col(end)


def code(xs, xe, ys, ye) -> Column:
    """How x lies to y, -6 (before, apart) to 6 (behind, apart); 0 is equality.

    -6 before, -5 touching, -4 reaching in, -3 the same end but longer, -2 holding y, -1 the same start but shorter,
    and the mirror images above zero.
    """
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    a, b = e1 + 1, e2 + 1
    return (
        F.when(a < s2, -6)
        .when(a == s2, F.when((s1 == a) & (s2 == b), 0).otherwise(-5))
        .when(b < s1, 6)
        .when(b == s1, 5)
        .when(s1 < s2, F.when(a < b, -4).when(a == b, -3).otherwise(-2))
        .when(s1 == s2, F.when(a < b, -1).when(a == b, 0).otherwise(1))
        .otherwise(F.when(a < b, 2).when(a == b, 3).otherwise(4))
    )


def letter(of: Column) -> Column:
    """The code as a letter a to m, X for anything else."""
    return F.when(of.between(-6, 6), F.substring(F.lit("abcdefghijklm"), of + 7, F.lit(1))).otherwise("X")


def distance(xs, xe, ys, ye) -> Column:
    """Positions between two ranges; 0 if they overlap or touch."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    return F.greatest(F.greatest(s1, s2) - F.least(e1, e2) - 1, F.lit(0))


def shared(xs, xe, ys, ye) -> Column:
    """Positions that two ranges share (negative: apart)."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    return F.least(e1, e2) - F.greatest(s1, s2) + 1


def paired_overlap(xs, xe, ys, ye, *, maxgap: int = 0, minoverlap: int = 1, type: str = "any") -> Column:
    """Row-wise overlap.  For "any" x is widened by ``maxgap`` on both sides and must then share ``minoverlap``."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    common = shared(s1, e1, s2, e2)
    if type == "any":
        return shared(s1 - maxgap, e1 + maxgap, s2, e2) >= minoverlap
    if type == "within":
        return (s1 >= s2) & (e1 <= e2) & (e1 - s1 + 1 >= minoverlap)
    close = {"start": F.abs(s1 - s2) <= maxgap, "end": F.abs(e1 - e2) <= maxgap, "equal": (F.abs(s1 - s2) <= maxgap) & (F.abs(e1 - e2) <= maxgap)}[type]
    return close & (common >= minoverlap)


# ---- parallel set operations -----------------------------------------------------------------------------------------


def punion(xs, xe, ys, ye, *, fill_gap: bool = False) -> Bounds:
    """The hull of both; a gap between them is an error unless it is filled."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    s = F.least(s1, s2)
    return (s if fill_gap else fail_if(F.greatest(s1, s2) > F.least(e1, e2) + 1, "some pairs have a gap", s)), F.greatest(e1, e2)


def pintersect(xs, xe, ys, ye, *, resolve_empty: str = "max.start") -> Bounds:
    """What both share.  Pairs that share nothing give an empty range whose place is not determined unless they touch or
    one is empty inside the other: then an error (none), at the larger start (max.start), or at x's start (start.x)."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    held_x = (e1 < s1) & (((s1 >= s2) & (s1 <= e2)) | ((s1 == s2) & (e2 < s2)))
    held_y = (e2 < s2) & (s2 >= s1) & (s2 <= e1)
    apart = s > e + 1
    place = {"none": fail_if(apart, "some intersections have no determined place", s), "max.start": s, "start.x": F.when(apart, s1).otherwise(s)}[resolve_empty]
    first = F.when(held_y, s2).when(held_x, s1).otherwise(place)
    last = F.when(held_y, s2 - 1).when(held_x, s1 - 1).when(apart, place - 1).otherwise(e)
    return first, last


def psetdiff(xs, xe, ys, ye) -> Bounds:
    """x without y; y with both ends strictly inside x is an error."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    common = F.least(e1, e2) >= F.greatest(s1, s2)
    inside = (s2 > s1) & (e2 < e1)
    s = F.when(common & (s2 <= s1) & (e2 < e1), e2 + 1).otherwise(s1)
    e = F.when(common & (s2 <= s1) & (e2 >= e1), s1 - 1).when(common & (s2 > s1) & (e2 >= e1), s2 - 1).otherwise(e1)
    return fail_if(inside, "some ranges of y lie inside x", s), e


def pgap(xs, xe, ys, ye) -> Bounds:
    """What lies between two ranges; an empty range where they touch or overlap."""
    (s1, e1), (s2, e2) = _of(xs, xe), _of(ys, ye)
    high, low = F.greatest(s1, s2), F.least(e1, e2) + 1
    return low, F.greatest(high - 1, low - 1)


# ---- matches ---------------------------------------------------------------------------------------------------------


def match(x: DataFrame, table: DataFrame) -> DataFrame:
    """Per row of x: the least row of ``table`` with the same start and end in the same space (null if none)."""
    first = table.groupBy("space", "start", "end").agg(F.min("rid").alias("match"))
    return x.join(first, ["space", "start", "end"], "left")


def self_match(x: DataFrame) -> DataFrame:
    """Per row: the least row with the same range, and whether the row repeats an earlier one."""
    return match(x, x).select(*x.columns, "match", (F.col("match") < F.col("rid")).alias("duplicated"))


def unique(x: DataFrame) -> DataFrame:
    """The first row of each range."""
    rest = [c for c in x.columns if c not in ("space", "start", "end")]
    first = x.groupBy("space", "start", "end").agg(F.min(F.struct("rid", *[c for c in rest if c != "rid"])).alias("_r"))
    return first.select("space", "start", "end", *[F.col(f"_r.{c}").alias(c) for c in rest])


def ordered(x: DataFrame) -> DataFrame:
    """Per row: its place in the order by start, then width, then row (ranges are ranked in their space)."""
    order = ["start", "end", "rid"]
    rows = swept(chunked(x, "start"), {"place": ("sum", F.lit(1).cast("long")), "_last": ("max", F.struct(*order))}, order, before=["_last"])
    new = F.col("_last").isNull() | (F.col("_last.start") != F.col("start")) | (F.col("_last.end") != F.col("end"))
    return swept(rows, {"rank": ("max", F.when(new, F.col("place")))}, order).drop("_last", "_chunk")


def unsorted(x: DataFrame, *, strictly: bool = False) -> DataFrame:
    """Per space: whether the rows are out of order (by start, then width)."""
    rows = preceding(x, {"_start": F.col("start"), "_end": F.col("end")}, "rid", ["rid"])
    here, before = F.struct("start", "end"), F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"))
    wrong = (here <= before) if strictly else (here < before)
    return rows.withColumn("bad", F.col("_start").isNotNull() & wrong).groupBy("space").agg(F.bool_or("bad").alias("unsorted"))

"""As-of lookups: precede, follow, nearest and distances, by one sorted union instead of a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import distance
from ..plans.sweep import running
from ..sources.scratch import kept
from .overlaps import find, one_hit


def _asof(query: DataFrame, marks: DataFrame, *, strict: bool, chunk: int | None) -> DataFrame:
    """Per query (space, rid, pos): near, the largest mark at or before pos (strictly before it if ``strict``)."""
    q = query.select("space", F.col("pos"), F.lit(0 if strict else 1).alias("_kind"), F.col("rid"), F.lit(None).cast("long").alias("_mark"))
    m = marks.select("space", "pos").distinct().select("space", "pos", F.lit(1 if strict else 0).alias("_kind"), F.lit(None).cast("long").alias("rid"), F.col("pos").alias("_mark"))
    rows = running(q.unionByName(m), {"near": ("max", F.col("_mark"))}, "pos", ["pos", "_kind"], chunk=chunk, derived=True)
    return rows.filter(F.col("rid").isNotNull() & (F.col("_kind") == (0 if strict else 1))).select("space", "rid", "near")


def follow(x: DataFrame, subject: DataFrame, *, all: bool = False, chunk: int | None = None) -> DataFrame:
    """Per row of x the subject that ends nearest before it starts: the last of several by number, or all of them."""
    near = _asof(x.select("space", "rid", F.col("start").alias("pos")), subject.select("space", F.col("end").alias("pos")), strict=True, chunk=chunk)
    return _back(x, near, subject.select("space", F.col("end").alias("near"), F.col("rid").alias("found")), all, F.max)


def precede(x: DataFrame, subject: DataFrame, *, all: bool = False, chunk: int | None = None) -> DataFrame:
    """Per row of x the subject that starts nearest behind its end: the first of several by number, or all of them."""
    near = _asof(x.select("space", "rid", (-F.col("end")).alias("pos")), subject.select("space", (-F.col("start")).alias("pos")), strict=True, chunk=chunk)
    return _back(x, near, subject.select("space", (-F.col("start")).alias("near"), F.col("rid").alias("found")), all, F.min)


def _back(x: DataFrame, near: DataFrame, at: DataFrame, all: bool, pick) -> DataFrame:
    found = at if all else at.groupBy("space", "near").agg(pick("found").alias("found"))
    hits = near.filter("near is not null").join(found, ["space", "near"]).select("space", "rid", "found")
    if all:
        return hits.select("space", F.col("rid").alias("query_id"), F.col("found").alias("subject_id"))
    return x.select("space", "rid").join(hits, ["space", "rid"], "left").select("space", F.col("rid").alias("query_id"), F.col("found").alias("subject_id"))


def last_at_or_before(query: DataFrame, blocks: DataFrame, *, chunk: int | None = None) -> DataFrame:
    """Per query (space, rid, pos): found, the number of the block that starts nearest at or before pos."""
    near = _asof(query, blocks.select("space", F.col("start").alias("pos")), strict=False, chunk=chunk)
    at = blocks.groupBy("space", F.col("start").alias("near")).agg(F.max("rid").alias("found"))
    return near.join(at, ["space", "near"], "left").select("space", "rid", "found")


def find_run(query: DataFrame, runs: DataFrame, *, chunk: int | None = None) -> DataFrame:
    """Per query (space, rid, pos): the run (start, end, value) that holds the position; null outside all runs."""
    near = _asof(query, runs.select("space", F.col("start").alias("pos")), strict=False, chunk=chunk)
    out = query.join(near, ["space", "rid"]).join(runs.withColumn("near", F.col("start")), ["space", "near"], "left")
    inside = F.col("pos") <= F.col("end")
    return out.select("space", "rid", "pos", *[F.when(inside, F.col(c)).alias(c) for c in ("start", "end", "value")])


def _neighbours(x: DataFrame, subject: DataFrame, chunk: int | None) -> DataFrame:
    """Per row of x, by one sweep and without pairs: touch (whether it overlaps or touches a subject), before (the largest
    end before its start) and behind (the least start behind its end).

    Axis 0 has the subjects' starts and is asked behind x's ends; axis 1 has the ends and is asked before x's starts.
    """
    marks = lambda axis, pos: subject.groupBy("space", F.lit(axis).alias("axis"), F.col(pos).alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    asks = lambda axis, pos: x.select("space", F.lit(axis).alias("axis"), F.col(pos).alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(1 - axis).alias("kind"), "rid")
    both = kept(marks(0, "start").unionByName(marks(1, "end")), "marks")  # so that their shuffle is over before the sweep's
    rows = both.select("*", F.col("axis").alias("kind"), F.lit(None).cast(dict(x.dtypes)["rid"]).alias("rid"))
    rows = rows.unionByName(asks(0, "end")).unionByName(asks(1, "start")).withColumn("asks", F.col("rid").isNotNull())
    mark = F.when(~F.col("asks"), F.struct("pos", "n"))
    values = {"_sum": ("sum", F.col("n")), "_last": ("max", F.when(F.col("axis") == 1, mark)), "_next": ("next", F.when(F.col("axis") == 0, mark))}
    rows = running(rows, values, "pos", ["pos", "kind", "asks"], chunk=chunk, by=("space", "axis")).filter("asks")
    # starts up to a position behind the end, less ends before the position before the start
    beside = lambda mark, pos: F.when(F.col(f"{mark}.pos") == pos, F.col(f"{mark}.n")).otherwise(F.lit(0))
    hits = F.when(F.col("axis") == 0, F.col("_sum") + beside("_next", F.col("pos") + 1)).otherwise(beside("_last", F.col("pos") - 1) - F.col("_sum"))
    return rows.groupBy("space", "rid").agg((F.sum(hits) > 0).alias("touch"), F.max("_last.pos").alias("before"), F.min("_next.pos").alias("behind"))


def nearest(x: DataFrame, subject: DataFrame, *, all: bool = False, chunk: int | None = None) -> DataFrame:
    """Per row of x the nearest subject: one that it overlaps or touches, else the closer of those before and behind.

    One subject: the first it overlaps or touches; of two that are equally far the one before.  All: every subject
    that is as near as the nearest.  Pairs are made of those alone, and none for one subject.
    """
    hits = _nearest(x, subject, all, chunk).select("space", "query_id", "subject_id")
    return hits if all else x.select("space", F.col("rid").alias("query_id")).join(hits, ["space", "query_id"], "left")


def _nearest(x: DataFrame, subject: DataFrame, all: bool, chunk: int | None) -> DataFrame:
    """The hits of :func:`nearest` with their distance, which is known before any hit is made: so no hit is moved."""
    found = kept(_neighbours(x, subject, chunk), "neighbours").join(x.select("space", "rid", "start", "end"), ["space", "rid"])
    found = kept(found, "asked")
    left, right = F.col("start") - F.col("before"), F.col("behind") - F.col("end")
    use_left = F.col("before").isNotNull() & F.coalesce(left <= right, F.lit(True))
    use_right = F.col("behind").isNotNull() & F.coalesce((right <= left) if all else (right < left), F.lit(True))
    spots = F.explode(F.array(F.struct(F.lit(1).alias("axis"), F.when(use_left, F.col("before")).alias("pos")), F.struct(F.lit(0).alias("axis"), F.when(use_right, F.col("behind")).alias("pos"))))
    sides = found.filter("not touch").select("space", F.col("rid").alias("query_id"), (F.least(left, right) - 1).alias("distance"), spots.alias("_s")).select("space", "query_id", "distance", "_s.*").filter("pos is not null")
    near = found.filter("touch").select("space", "rid", "start", "end")
    edges = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("start").alias("pos")), F.struct(F.lit(1).alias("axis"), F.col("end").alias("pos"))))
    at = subject.select("space", F.col("rid").alias("subject_id"), edges.alias("_e")).select("space", "_e.axis", "_e.pos", "subject_id")
    if all:
        touching = find(near, subject, maxgap=0)
    else:
        first, last = F.min("subject_id"), F.max("subject_id")
        at = at.groupBy("space", "axis", "pos").agg(F.when(F.col("axis") == 0, first).otherwise(last).alias("subject_id"))
        touching = one_hit(near, subject, "first", maxgap=0, chunk=chunk)
    beside = sides.join(at, ["space", "axis", "pos"]).select("space", "query_id", "subject_id", "distance")
    # no subject stands on both sides: one that ends before a range and starts behind it is empty, and so is the range, and they touch
    return touching.withColumn("distance", F.lit(0).cast("long")).unionByName(beside)


def distance_to_nearest(x: DataFrame, subject: DataFrame, *, all: bool = False, chunk: int | None = None) -> DataFrame:
    """The nearest hits with their distance; rows without any are left out."""
    return _nearest(x, subject, all, chunk).filter("subject_id is not null")


def with_distance(hits: DataFrame, x: DataFrame, subject: DataFrame) -> DataFrame:
    q = x.select("space", F.col("rid").alias("query_id"), F.col("start").alias("_qs"), F.col("end").alias("_qe"))
    s = subject.select("space", F.col("rid").alias("subject_id"), F.col("start").alias("_ss"), F.col("end").alias("_se"))
    out = hits.join(q, ["space", "query_id"]).join(s, ["space", "subject_id"])
    return out.select("space", "query_id", "subject_id", distance("_qs", "_qe", "_ss", "_se").alias("distance"))


def select_nearest(hits: DataFrame | dict, x: DataFrame, subject: DataFrame) -> DataFrame:
    """Of hits those at the least distance of their query.

    Hits that aren't made yet are given as the options of :func:`~.overlaps.find`.  Then those of overlaps with a gap are
    chosen before they are made: they are the nearest subjects, if these are no farther than the gap.
    """
    if isinstance(hits, dict):
        gap = hits.get("maxgap", -1)
        if hits.get("type", "any") == "any" and gap > 0:
            return distance_to_nearest(x, subject, all=True).filter(F.col("distance") <= gap).select("space", "query_id", "subject_id")
        hits = find(x, subject, **hits)
    far = with_distance(hits, x, subject)
    least = F.min("distance").over(Window.partitionBy("space", "query_id"))
    return far.withColumn("_least", least).filter("distance = _least").select("space", "query_id", "subject_id")

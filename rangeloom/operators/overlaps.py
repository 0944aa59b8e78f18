"""Overlap joins and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import positions  # noqa: F401  (part of this module's vocabulary)
from ..plans.binning import KEYS, Bins, cut_blocks, dealt, edges, first_cell, fitted, tune
from ..plans.dominance import below
from ..plans.sweep import running
from ..sources.scratch import freed, kept

TYPES = ("any", "start", "end", "within", "extend", "equal")


def meets(type: str, maxgap: int, minoverlap: int, start: str = "q_start", end: str = "q_end") -> Column:
    """Whether the pair (q_start, q_end, s_start, s_end) is a hit; the query's ends may have other names."""
    qs, qe, ss, se = (F.col(c) for c in (start, end, "s_start", "s_end"))
    shared = F.least(qe, se) - F.greatest(qs, ss) + 1
    g = max(maxgap, 0)
    enough = shared >= minoverlap if minoverlap > 0 else F.lit(True)
    if type == "any":
        if minoverlap > 0:
            return enough
        return (qs <= se + maxgap + 1) & (ss <= qe + maxgap + 1)
    if type == "start":
        return (F.abs(qs - ss) <= g) & enough
    if type == "end":
        return (F.abs(qe - se) <= g) & enough
    if type == "equal":
        return (F.abs(qs - ss) <= g) & (F.abs(qe - se) <= g) & enough
    slack = (qs - ss) + (se - qe)
    if type == "within":
        return (qs >= ss) & (qe <= se) & (qe - qs + 1 >= minoverlap) & (slack <= g if g > 0 else F.lit(True))
    return (ss >= qs) & (se <= qe) & (se - ss + 1 >= minoverlap) & (-slack <= g if g > 0 else F.lit(True))


def find(query: DataFrame, subject: DataFrame, *, maxgap: int = -1, minoverlap: int = 0, type: str = "any", bins: Bins | None = None, pairs: bool = True) -> DataFrame:
    """All hits: space, query_id, subject_id.

    "any": the ranges share a position, or with ``maxgap`` lie at most so many positions apart (0: touch), or with
    ``minoverlap`` share so many.  "start", "end", "equal": those ends differ by at most ``maxgap``, which needs no
    shared position.  "within": the query lies in the subject, with at most ``maxgap`` positions to spare if given;
    "extend": the other way round.  Only spaces that both sides have can give hits.  Without ``pairs`` only the queries
    that hit something are found (space, query_id), by a semi-join that makes no pairs; wide ones may come up repeatedly.

    Both sides are read three times: for their widths, to count their bins, and for the join.  What costs more to make than
    to read is best stored before (``sources.scratch.kept``).
    """
    out = _hits(query, subject, maxgap=maxgap, minoverlap=minoverlap, type=type, bins=bins, pairs=pairs)
    return out.select("space", "query_id", "subject_id") if pairs else out


def _hits(query: DataFrame, subject: DataFrame, *, maxgap: int = -1, minoverlap: int = 0, type: str = "any", bins: Bins | None = None, pairs: bool = True, more: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """The hits with q_start, q_end, s_start, s_end and what ``more`` names of either side (q_..., s_...); ``where`` is a
    further condition on these, checked where a pair meets."""
    _checked(type, maxgap, minoverlap)
    q = query.select("space", F.col("rid").alias("query_id"), F.col("start").alias("q_start"), F.col("end").alias("q_end"), *[F.col(x).alias(f"q_{x}") for x in more if x in query.columns])
    s = subject.select("space", F.col("rid").alias("subject_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), *[F.col(x).alias(f"s_{x}") for x in more if x in subject.columns])
    hit = meets(type, maxgap, minoverlap) if where is None else meets(type, maxgap, minoverlap) & where
    exact = {"start": ["start"], "end": ["end"], "equal": ["start", "end"]}
    if type in exact and maxgap <= 0:
        keys = [F.col("q.space") == F.col("s.space")] + [F.col(f"q_{k}") == F.col(f"s_{k}") for k in exact[type]]
        return _joined(q, s, keys, hit, pairs)
    g = max(maxgap, 0)
    if type in ("start", "end", "equal"):
        point = "end" if type == "end" else "start"
        q_low, q_high = F.col(f"q_{point}") - g, F.col(f"q_{point}") + g
        s_low = s_high = F.col(f"s_{point}")
    elif type in ("within", "extend"):
        (q_low, q_high), (s_low, s_high) = edges(F.col("q_start"), F.col("q_end")), edges(F.col("s_start"), F.col("s_end"))
    else:
        low, high = edges(F.col("q_start"), F.col("q_end"))
        q_low, q_high = low - (maxgap + 1), high + (maxgap + 1)
        s_low, s_high = edges(F.col("s_start"), F.col("s_end"))
    return _met(q, s, (q_low, q_high), (s_low, s_high), hit, bins, pairs)


def _met(q: DataFrame, s: DataFrame, q_at: tuple[Column, Column], s_at: tuple[Column, Column], hit: Column, bins: Bins | None, pairs: bool = True) -> DataFrame:
    """Pairs of rows that meet between their lows and highs, by bins fitted to both sides, of which the overfull are cut.

    Lows and highs are made of columns whose names the sides don't share, so that they needn't be moved.
    """
    bins = bins or fitted(*[df.select((high - low + 1).alias("_extent")) for df, (low, high) in ((q, q_at), (s, s_at))])
    left, right = dealt(q, *q_at, bins, "q"), dealt(s, *s_at, bins, "s")
    left, right, blocks = cut_blocks(left, right, "query_id", "subject_id")
    same = [F.col(f"q.{k}") == F.col(f"s.{k}") for k in (*KEYS, *blocks)]
    once = first_cell(F.col("q._cell"), F.greatest(q_at[0], s_at[0]), bins)
    return _joined(left, right, same, once & hit, pairs)


def _joined(q: DataFrame, s: DataFrame, keys: list[Column], hit: Column, pairs: bool) -> DataFrame:
    if not pairs:
        return q.alias("q").join(s.alias("s"), [*keys, hit], "left_semi").select("space", "query_id")
    named = [x for df in (q, s) for x in df.columns if x != "space" and not x.startswith("_")]
    return q.alias("q").join(s.alias("s"), keys).filter(hit).select(F.col("q.space").alias("space"), *named)


def select(query: DataFrame, hits: DataFrame, which: str) -> DataFrame:
    """One row per query: the first or last subject by number, an arbitrary one (here the first), or the count."""
    key = ["space", F.col("rid").alias("query_id")]
    if which == "count":
        counts = hits.groupBy("space", "query_id").agg(F.count(F.lit(1)).alias("n"))
        return query.select(*key).join(counts, ["space", "query_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    agg = {"first": F.min, "last": F.max, "arbitrary": F.min}[which]
    return query.select(*key).join(hits.groupBy("space", "query_id").agg(agg("subject_id").alias("subject_id")), ["space", "query_id"], "left")


def find_self(x: DataFrame, *, drop_self: bool = False, drop_redundant: bool = False, **how) -> DataFrame:
    """Hits among the ranges of one frame; of A-B and B-A the one with the smaller query number stays if asked."""
    where = F.col("query_id") <= F.col("subject_id") if drop_redundant else F.lit(True)
    if drop_self:
        where = where & (F.col("query_id") != F.col("subject_id"))
    return _hits(x, x, where=where, **how).select("space", "query_id", "subject_id")


def points(df: DataFrame, pos: str) -> DataFrame:
    """Numbers as ranges of one position."""
    return df.withColumns({"start": F.col(pos).cast("long"), "end": F.col(pos).cast("long")})


def count(query: DataFrame, subject: DataFrame, *, chunk: int | None = None, **how) -> DataFrame:
    """Per query row, with all its columns: n, the number of subjects that it hits.

    No pairs are made: overlaps of any kind, shared starts and shared ends are differences of running counts over sorted
    positions; within, extend and equal are counts of points at or below others in two coordinates.  (Only least overlaps
    of shared starts or ends are counted from pairs.)
    """
    counts = _counted(query, subject, chunk, **how)
    if counts is None:
        counts = find(query, subject, **how).groupBy("space", F.col("query_id").alias("rid")).agg(F.count(F.lit(1)).alias("n"))
    return query.join(counts, ["space", "rid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _checked(type: str, maxgap: int, minoverlap: int) -> None:
    if type not in TYPES:
        raise ValueError(f"type must be one of {TYPES}")
    if type == "any" and maxgap != -1 and minoverlap != 0:
        raise ValueError("give maxgap or minoverlap, not both")
    if maxgap < -1 or minoverlap < 0:
        raise ValueError("maxgap must be at least -1 and minoverlap at least 0")


def _counted(query: DataFrame, subject: DataFrame, chunk: int | None, *, maxgap: int = -1, minoverlap: int = 0, type: str = "any") -> DataFrame | None:
    """Hits per query (space, rid, n; those without may be left out), or nothing if only pairs can tell."""
    _checked(type, maxgap, minoverlap)
    wide = lambda df: df.filter(F.col("end") - F.col("start") + 1 >= minoverlap) if minoverlap else df
    start, end, width, g = F.col("start"), F.col("end"), F.col("end") - F.col("start"), max(maxgap, 0)
    if type == "any":
        # both share m positions: both have as many, and the one ends that far behind the other's start
        return _ranked(wide(query), wide(subject), -minoverlap if minoverlap else maxgap, chunk)
    if type == "within":
        query = wide(query)
    elif type == "extend":
        subject = wide(subject)
    elif minoverlap:
        return None
    if type in ("start", "end") and g:
        return _beside(query, subject, type, g, chunk)
    if type in ("start", "end", "equal") and not g:
        keys = ["start", "end"] if type == "equal" else [type]
        each = subject.groupBy("space", *keys).agg(F.count(F.lit(1)).alias("n"))
        return query.join(each, ["space", *keys]).select("space", "rid", "n")
    # each case: what stands for x and y of a subject, and the signed corners of a query
    if type == "within" and not g:
        cases = [(start, -end, [(1, start, -end)])]
    elif type == "extend" and not g:
        cases = [(-start, end, [(1, -start, end)])]
    elif type == "equal":
        cases = [(start, end, [(1, start + g, end + g), (-1, start - g - 1, end + g), (-1, start + g, end - g - 1), (1, start - g - 1, end - g - 1)])]
    elif type == "within":
        # a triangle: starts up to g before, no wider than g more, less what ends too early
        cases = [(start, width, [(1, start, width + g), (-1, start - g - 1, width + g)]), (start, end, [(-1, start, end - 1), (1, start - g - 1, end - 1)])]
    else:
        cases = [(-start, -width, [(1, -start, g - width), (-1, -start - g - 1, g - width)]), (-start, -end, [(-1, -start, -end - 1), (1, -start - g - 1, -end - 1)])]
    sums = None
    for x, y, corners in cases:
        points = subject.select("space", x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(1).cast("long").alias("value"))
        corner = F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), ax.cast("long").alias("x"), ay.cast("long").alias("y")) for sign, ax, ay in corners]))
        asks = query.select("space", "rid", corner.alias("_c")).select("space", F.struct("space", "rid", "_c.sign").alias("ask"), "_c.x", "_c.y")
        # corners of one sign stay apart by their places
        asks = asks.withColumn("ask", F.struct("ask.space", "ask.rid", "ask.sign", "x", "y")) if len(corners) > 1 else asks
        found = below(points, asks, "sum", chunk=chunk).select("ask.space", "ask.rid", (F.col("ask.sign") * F.col("value")).alias("n"))
        sums = found if sums is None else sums.unionByName(found)
    return sums.groupBy("space", "rid").agg(F.sum("n").alias("n"))


def _beside(query: DataFrame, subject: DataFrame, point: str, g: int, chunk: int | None) -> DataFrame:
    """How many subjects start (end) at most g positions from a query's start (end)."""
    marks = subject.groupBy("space", F.col(point).alias("pos")).agg(F.count(F.lit(1)).alias("_one"))
    marks = marks.select("space", "pos", F.lit(0).alias("_kind"), F.lit(None).cast(query.schema["rid"].dataType).alias("rid"), F.lit(0).alias("_sign"), "_one")
    edge = F.explode(F.array(F.struct((F.col(point) + g).alias("pos"), F.lit(1).alias("sign")), F.struct((F.col(point) - g - 1).alias("pos"), F.lit(-1).alias("sign"))))
    asks = query.select("space", "rid", edge.alias("_e")).select("space", "_e.pos", F.lit(1).alias("_kind"), "rid", F.col("_e.sign").alias("_sign"), F.lit(0).cast("long").alias("_one"))
    rows = running(marks.unionByName(asks), {"_before": ("sum", F.col("_one"))}, "pos", ["pos", "_kind"], chunk=chunk)
    return rows.filter("_kind = 1").groupBy("space", "rid").agg(F.sum(F.col("_sign") * F.col("_before")).alias("n"))


def one_hit(query: DataFrame, subject: DataFrame, which: str = "first", *, maxgap: int = -1, minoverlap: int = 0, type: str = "any", chunk: int | None = None) -> DataFrame:
    """Per query row one subject that it hits, or null: the first or last by number, or an arbitrary one (here the first):
    space, query_id, subject_id.

    No pairs are made for overlaps of any kind, within and extend, and for equal starts and ends: the answer is the least
    (largest) number of the points at or below another in two coordinates.  With a tolerance the other types take it
    from pairs.
    """
    if which not in ("first", "last", "arbitrary"):
        raise ValueError("which must be first, last or arbitrary")
    _checked(type, maxgap, minoverlap)
    fold = "max" if which == "last" else "min"
    agg = F.max if which == "last" else F.min
    wide = lambda df: df.filter(F.col("end") - F.col("start") + 1 >= minoverlap) if minoverlap else df
    start, end = F.col("start"), F.col("end")
    key = ["space", F.col("rid").alias("query_id")]
    if type in ("start", "end", "equal") and maxgap <= 0 and not minoverlap:
        keys = ["start", "end"] if type == "equal" else [type]
        each = subject.groupBy("space", *keys).agg(agg("rid").alias("subject_id"))
        return query.join(each, ["space", *keys], "left").select(*key, "subject_id")
    if type == "any":
        far = 1 - minoverlap if minoverlap else maxgap + 1
        asked, points, ask, point = wide(query), wide(subject), (end + far, far - start), (start, -end)
    elif type == "within" and maxgap <= 0:
        asked, points, ask, point = wide(query), subject, (start, -end), (start, -end)
    elif type == "extend" and maxgap <= 0:
        asked, points, ask, point = query, wide(subject), (-start, end), (-start, end)
    else:
        return select(query, find(query, subject, maxgap=maxgap, minoverlap=minoverlap, type=type), which)
    points = points.select("space", point[0].cast("long").alias("x"), point[1].cast("long").alias("y"), F.col("rid").alias("value"))
    asks = asked.select("space", F.struct("space", "rid").alias("ask"), ask[0].cast("long").alias("x"), ask[1].cast("long").alias("y"))
    found = below(points, asks, fold, chunk=chunk).select("ask.space", F.col("ask.rid").alias("query_id"), F.col("value").alias("subject_id"))
    return query.select(*key).join(found, ["space", "query_id"], "left")


def _ranked(query: DataFrame, subject: DataFrame, maxgap: int, chunk: int | None) -> DataFrame:
    """Counts by rank: axis 0 has the subjects' starts, axis 1 their ends; queries stand behind equal positions."""
    ends = lambda first, last: F.explode(F.array(F.struct(F.lit(0).alias("axis"), first.alias("pos")), F.struct(F.lit(1).alias("axis"), last.alias("pos"))))
    marks = subject.select("space", ends(F.col("start"), F.col("end")).alias("_e")).groupBy("space", "_e.axis", "_e.pos").agg(F.count(F.lit(1)).alias("_one"))
    marks = marks.select("space", "axis", "pos", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("rid"), "_one")
    asks = query.select("space", "rid", ends(F.col("end") + maxgap + 1, F.col("start") - maxgap - 2).alias("_e")).select("space", "_e.axis", "_e.pos", F.lit(1).alias("_kind"), "rid", F.lit(0).cast("long").alias("_one"))
    rows = running(marks.unionByName(asks), {"_before": ("sum", F.col("_one"))}, "pos", ["pos", "_kind"], chunk=chunk, by=("space", "axis"))
    out = rows.filter("_kind = 1").groupBy("space", "rid").agg(F.sum(F.when(F.col("axis") == 0, F.col("_before")).otherwise(-F.col("_before"))).alias("n"))
    if maxgap >= 0:
        return out
    # an empty query has been charged for the empty subjects at its own place, which neither start before nor hit it
    twins = subject.filter("end < start").groupBy("space", "start").agg(F.count(F.lit(1)).alias("_twins"))
    hollow = query.filter("end < start").join(twins, ["space", "start"]).select("space", "rid", "_twins")
    return out.join(hollow, ["space", "rid"], "left").select("space", "rid", (F.col("n") + F.coalesce("_twins", F.lit(0))).alias("n"))


def touched(query: DataFrame, subject: DataFrame, *, chunk: int | None = None, **how) -> DataFrame:
    """The numbers of the queries that hit something: space, rid.  No pairs are made."""
    counts = _counted(query, subject, chunk, **how)
    if counts is not None:
        return counts.filter("n > 0").select("space", "rid")
    return find(query, subject, pairs=False, **how).select("space", F.col("query_id").alias("rid")).distinct()


def any_overlap(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """Per query row: hit, whether it hits any subject."""
    found = touched(query, subject, **how).withColumn("hit", F.lit(True))
    return query.join(found, ["space", "rid"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def subset(x: DataFrame, by: DataFrame, *, invert: bool = False, **how) -> DataFrame:
    """The rows of x that hit something in ``by`` (or those that don't)."""
    return x.join(touched(x, by, **how), ["space", "rid"], "left_anti" if invert else "left_semi")


def merge(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """The hits with all columns of both sides, prefixed q_ and s_.

    The columns go with the sides to where they meet, so that no hit is moved to fetch them.
    """
    more = [c for c in dict.fromkeys([*query.columns, *subject.columns]) if c not in ("space", "rid", "start", "end")]
    hits = _hits(query, subject, more=more, **how).withColumnsRenamed({"query_id": "q_rid", "subject_id": "s_rid"})
    return hits.select("space", *[f"{p}_{c}" for p, df in (("q", query), ("s", subject)) for c in df.columns if c != "space"])


def pairs(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """The hits as pairs of structs: space, first, second."""
    wide = merge(query, subject, **how)
    pack = lambda p, df: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in df.columns if c != "space"])
    return wide.select("space", pack("q", query).alias("first"), pack("s", subject).alias("second"))


def intersections(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """For each hit what both ranges share: space, query_id, subject_id, start, end."""
    hits = _hits(query, subject, **how)
    return hits.select("space", "query_id", "subject_id", F.greatest("q_start", "s_start").alias("start"), F.least("q_end", "s_end").alias("end"))


def find_pairs(query_pairs: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """Queries that are pairs of ranges (rid, first, second as structs of start and end): a pair hits what either hits."""
    part = lambda name, i: F.struct(F.lit(i).alias("part"), F.col(f"{name}.start").alias("start"), F.col(f"{name}.end").alias("end"))
    both = query_pairs.select("space", "rid", "first", F.explode(F.array(part("first", 0), part("second", 1))).alias("_r")).select("space", "rid", "first", "_r.*")
    # what the first of a pair hits already isn't told again for the second
    known = meets(how.get("type", "any"), how.get("maxgap", -1), how.get("minoverlap", 0), "q_first.start", "q_first.end")
    where = (F.col("q_part") == 0) | ~F.coalesce(known, F.lit(False))
    subject = subject.select("space", "rid", "start", "end")
    return _hits(both, subject, more=["part", "first"], where=where, **how).select("space", "query_id", "subject_id")


def _on_circle(df: DataFrame, low: Column, high: Column, length: int, side: str) -> DataFrame:
    """A row per piece, one or two, of what lies between low and high on a circle: its low and high (1 to length, prefixed
    with the side), _piece (its number) and _pieces (all of them)."""
    first = F.pmod(low - 1, F.lit(length)) + 1
    last = first + (high - low)
    piece = lambda a, z: F.struct(F.lit(a).cast("long").alias("low") if isinstance(a, int) else a.cast("long").alias("low"), F.lit(z).cast("long").alias("high") if isinstance(z, int) else z.cast("long").alias("high"))
    pieces = F.when(high - low + 1 >= length, F.array(piece(1, length))).when(last <= length, F.array(piece(first, last))).otherwise(F.array(piece(first, length), piece(1, last - length)))
    out = df.withColumn("_pieces", pieces).select("*", F.posexplode("_pieces").alias("_piece", "_p"))
    return out.withColumns({f"_{side}_low": F.col("_p.low"), f"_{side}_high": F.col("_p.high")}).drop("_p")


def _first_meeting() -> Column:
    """Whether the two pieces meet and no earlier ones of the same ranges: two ranges on a circle may meet in four places."""
    at = lambda side, i: F.get(F.col(f"{side}._pieces"), F.lit(i) if isinstance(i, int) else i)
    meet = lambda a, b: F.coalesce((a["low"] <= b["high"]) & (b["low"] <= a["high"]), F.lit(False))
    out = meet(at("q", F.col("q._piece")), at("s", F.col("s._piece")))
    for i in (0, 1):
        for j in (0, 1):
            earlier = (F.col("q._piece") > i) | ((F.col("q._piece") == i) & (F.col("s._piece") > j))
            out = out & ~(earlier & meet(at("q", i), at("s", j)))
    return out


def find_circular(query: DataFrame, subject: DataFrame, length: int, *, type: str = "any", maxgap: int = -1, minoverlap: int = 0, bins: Bins | None = None) -> DataFrame:
    """Overlaps on circles of the given length, of any type.

    Starts and ends are compared round the circle, so that ranges whose ends differ by whole circles end at one place.
    For the other types a pair hits if it does with the query moved on by some number of circles, which two quotients
    tell.  Ranges stand in bins on the circle, those that go over its end in two pieces, so the work doesn't depend on how
    often they go round or on ``maxgap``; a pair is kept where its first pieces meet.
    """
    _checked(type, maxgap, minoverlap)
    q = query.select("space", F.col("rid").alias("query_id"), F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    s = subject.select("space", F.col("rid").alias("subject_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    qs, qe, ss, se = (F.col(x) for x in ("q_start", "q_end", "s_start", "s_end"))
    g, q_width, s_width = max(maxgap, 0), qe - qs + 1, se - ss + 1
    turns = lambda low, high: F.floor(high / length) >= F.ceil(low / length)  # noqa: E731  whole circles between two moves
    if type in ("start", "end", "equal"):
        near = lambda a, b: F.least(F.pmod(a - b, F.lit(length)), F.pmod(b - a, F.lit(length))) <= g
        at_q, at_s = (qe, se) if type == "end" else (qs, ss)
        left, right = _on_circle(q, at_q - g, at_q + g, length, "q"), _on_circle(s, at_s, at_s, length, "s")
        hit = near(at_q, at_s)
        if type == "equal":
            hit = hit & near(qe, se) & (F.abs(q_width - s_width) <= 2 * g)
        if minoverlap > 0:
            # the most that both share in any turn
            turn = F.floor((ss - qs) / length)
            shared = lambda t: F.least(qe + t * length, se) - F.greatest(qs + t * length, ss) + 1
            hit = hit & (F.greatest(shared(turn), shared(turn + 1)) >= minoverlap)
    else:
        far = maxgap + 1 if type == "any" else 0
        (q_low, q_high), (s_low, s_high) = edges(qs, qe), edges(ss, se)
        left, right = _on_circle(q, q_low - far, q_high + far, length, "q"), _on_circle(s, s_low, s_high, length, "s")
        if type == "any" and minoverlap:
            hit = (q_width >= minoverlap) & (s_width >= minoverlap) & turns(minoverlap - 1 + ss - qe, se - qs + 1 - minoverlap)
        elif type == "any":
            hit = turns(ss - qe - far, se + far - qs)
        else:
            slack = s_width - q_width if type == "within" else q_width - s_width
            low, high = (ss - qs, se - qe) if type == "within" else (se - qe, ss - qs)
            hit = turns(low, high) & ((q_width if type == "within" else s_width) >= minoverlap) & (slack <= g if g else F.lit(True))
    at = [(F.col(f"_{p}_low"), F.col(f"_{p}_high")) for p in "qs"]
    return _met(left, right, *at, hit & _first_meeting(), bins).select("space", "query_id", "subject_id")


def count_circular(query: DataFrame, subject: DataFrame, length: int, *, maxgap: int = -1) -> DataFrame:
    """Per query row that hits something on a circle (overlaps of any kind): space, query_id, n (the number of subjects) and
    total (the sum of their numbers).

    No pairs are made, but for ranges so wide that two of them could meet in two places (wider than about half a circle).
    """
    far = maxgap + 1
    narrow = F.col("end") - F.col("start") + 1 <= (length + 1 - 2 * far) // 2
    parts = [_round_counts(query.filter(narrow), subject.filter(narrow), length, far)]
    for q, s in ((query.filter(~narrow), subject), (query.filter(narrow), subject.filter(~narrow))):
        if not (q.isEmpty() or s.isEmpty()):
            wide = find_circular(q, s, length, maxgap=maxgap)
            parts.append(wide.groupBy("space", "query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("subject_id").alias("total")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("space", "query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")


def _round_counts(query: DataFrame, subject: DataFrame, length: int, far: int) -> DataFrame:
    """n and total of narrow ranges: of a pair that meets once at most, the whole circles between two moves are

        floor((subject's end + far - query's start) / length) - floor((subject's start - far - 1 - query's end) / length)

    and such quotients are summed from those of either side and from the remainders that are smaller than the query's.
    """
    turns, rest = lambda x: F.floor(x / length), lambda x: F.pmod(x, F.lit(length))
    start, end = F.col("start"), F.col("end")
    edge = lambda axis, x: F.struct(F.lit(axis).alias("axis"), rest(x).cast("long").alias("pos"), turns(x).cast("long").alias("turns"))
    s_edges = F.array(edge(0, start - far - 1), edge(1, end + far))
    q_edges = F.array(edge(0, end), edge(1, start))
    if far == 0:  # an empty query meets no empty subject, and is asked of the others alone (axes 2 and 3)
        s_edges = F.when(end >= start, F.concat(s_edges, F.array(edge(2, start - 1), edge(3, end)))).otherwise(s_edges)
        q_edges = F.when(end < start, F.array(edge(2, end), edge(3, start))).otherwise(q_edges)
    marks = subject.select("space", F.col("rid").cast("long").alias("rid"), F.explode(s_edges).alias("_e")).select("space", "rid", "_e.*").groupBy("space", "axis", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rid").alias("total"), F.sum("turns").alias("n_turns"), F.sum(F.col("turns") * F.col("rid")).alias("total_turns")
    )
    marks = kept(marks, "marks")
    asked = query.select("space", F.col("rid").alias("query_id"), F.explode(q_edges).alias("_e")).select("space", "query_id", "_e.*")
    sums = ("n", "total")
    all_ = marks.groupBy("space", "axis").agg(*[F.sum(f"{x}").alias(f"_all_{x}") for x in sums], *[F.sum(f"{x}_turns").alias(f"_turns_{x}") for x in sums])
    none = F.lit(None).cast("long")
    rows = marks.select("space", "axis", "pos", F.lit(1).alias("kind"), *sums).unionByName(asked.select("space", "axis", "pos").distinct().select("*", F.lit(0).alias("kind"), none.alias("n"), none.alias("total")))
    rows = running(rows, {f"_less_{x}": ("sum", F.col(x)) for x in sums}, "pos", ["pos", "kind"], by=("space", "axis"), derived=True)
    less = rows.filter("kind = 0").join(all_, ["space", "axis"]).select("space", "axis", "pos", *[f"_{y}_{x}" for x in sums for y in ("less", "all", "turns")])
    sign = F.when(F.col("axis") % 2 == 1, 1).otherwise(-1)
    told = [F.sum(sign * (F.col(f"_turns_{x}") - F.col(f"_all_{x}") * F.col("turns") - F.col(f"_less_{x}"))).alias(x) for x in sums]
    return asked.join(less, ["space", "axis", "pos"]).groupBy("space", "query_id").agg(*told)


def find_grouped(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """Overlaps in groups (column ``group``) whose ranges have a code: ranges of different codes don't meet, code 0 meets
    any.  Returns group, query_id, subject_id."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.col("group").alias("space"), "rid", "start", "end", "code")

    agree = (F.col("q_code") == 0) | (F.col("s_code") == 0) | (F.col("q_code") == F.col("s_code"))
    return _hits(keyed(query), keyed(subject), more=["code"], where=agree, **how).select(F.col("space").alias("group"), "query_id", "subject_id")


def local_ids(df: DataFrame) -> DataFrame:
    """Add ``local``, a row's place in its space."""
    return running(df, {"local": ("sum", F.lit(1).cast("long"))}, "rid", ["rid"])


def find_local(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """Hits with rows numbered inside their spaces."""
    swap = lambda df: kept(local_ids(df.select("space", "rid", "start", "end")).withColumn("rid", F.col("local")).drop("local"), "local")
    return find(swap(query), swap(subject), **how)


def in_partition(query: DataFrame, parts: DataFrame, *, empty_queries: bool = False, empty_blocks: bool = False) -> DataFrame:
    """Hits of ranges with adjacent sorted blocks (rid, start, end): the first and last block of a range are found by
    their starts, and those between follow by number.

    Empty ranges and empty blocks are left out unless asked for: an empty range hits a block if it stands inside it
    (behind its first position), an empty block is hit if it stands inside a range (at its first position or behind).
    """
    from .nearest import last_at_or_before

    some = query.filter("end >= start")
    blocks = parts.filter("end >= start").select("space", "rid", "start", "end")
    first = last_at_or_before(some.select("space", "rid", F.col("start").alias("pos")), blocks).withColumnRenamed("found", "_first")
    last = last_at_or_before(some.select("space", "rid", F.col("end").alias("pos")), blocks).withColumnRenamed("found", "_last")
    low = blocks.groupBy("space").agg(F.min("rid").alias("_low"), F.max("end").alias("_top"))
    spans = some.select("space", "rid", "start").join(first.select("space", "rid", "_first"), ["space", "rid"]).join(last.select("space", "rid", "_last"), ["space", "rid"]).join(low, "space")
    spans = spans.filter("_last is not null and start <= _top")
    out = spans.select("space", F.col("rid").alias("query_id"), F.explode(F.sequence(F.coalesce("_first", "_low"), F.col("_last"))).alias("subject_id"))
    out = out.join(blocks.select("space", F.col("rid").alias("subject_id")), ["space", "subject_id"], "left_semi").select("space", "query_id", "subject_id")
    if empty_queries:
        hollow = query.filter("end < start").select("space", "rid", F.col("start").alias("pos"))
        hit = last_at_or_before(hollow.withColumn("pos", F.col("pos") - 1), blocks).join(hollow, ["space", "rid"])
        tops = blocks.select("space", F.col("rid").alias("found"), F.col("end").alias("_end"))
        out = out.unionByName(hit.join(tops, ["space", "found"]).filter("pos <= _end").select("space", F.col("rid").alias("query_id"), F.col("found").alias("subject_id")))
    if empty_blocks:
        bare = parts.filter("end < start").select("space", "rid", "start", "end")
        out = out.unionByName(find(bare.withColumn("end", F.col("start")), some if not empty_queries else query, type="within").select("space", F.col("subject_id").alias("query_id"), F.col("query_id").alias("subject_id")))
    return out


def partition_overlaps(x: DataFrame, y: DataFrame) -> DataFrame:
    """Two partitionings of one line (space, rid, start, end): the pieces into which both cut it, with their blocks."""
    from .algebra import disjoin

    pieces = kept(disjoin(x.select("space", "rid", "start", "end").unionByName(y.select("space", "rid", "start", "end"))).withColumn("rid", F.col("start")), "pieces")
    a = find(pieces, x).select("space", F.col("query_id").alias("start"), F.col("subject_id").alias("x_id"))
    b = find(pieces, y).select("space", F.col("query_id").alias("start"), F.col("subject_id").alias("y_id"))
    return pieces.drop("rid").join(a, ["space", "start"], "left").join(b, ["space", "start"], "left")


@dataclass(frozen=True)
class Index:
    """A subject prepared for many joins: a table of its ranges in bins, stored in buckets by bin."""

    spark: SparkSession
    table: str
    bins: Bins

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def build_index(subject: DataFrame, table: str, *, buckets: int = 200, bins: Bins | None = None, path: str | None = None) -> Index:
    """Write a subject's bin table, bucketed and sorted by bin, under ``table`` (with its files at ``path`` if given).

    Joins with it move the queries alone.  The bins are kept with the table, so that :func:`open_index` finds them.
    """
    spark = subject.sparkSession
    bins = bins or tune(subject)
    s = subject.select("space", F.col("rid").alias("subject_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    rows = dealt(s, *edges(F.col("s_start"), F.col("s_end")), bins, "s")
    writer = rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).format("parquet").mode("overwrite")
    with freed(spark):
        (writer.option("path", path) if path else writer).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('bins.width' = '{bins.width}', 'bins.levels' = '{bins.levels}')")
    return Index(spark, table, bins)


def open_index(spark: SparkSession, table: str) -> Index:
    """The index that :func:`build_index` has written."""
    found = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return Index(spark, table, Bins(int(found["bins.width"]), int(found["bins.levels"])))


def find_in_index(query: DataFrame, index: Index, *, maxgap: int = -1, minoverlap: int = 0) -> DataFrame:
    """Overlaps of any kind with an indexed subject: space, query_id, subject_id."""
    _checked("any", maxgap, minoverlap)
    q = query.select("space", F.col("rid").alias("query_id"), F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    low, high = edges(F.col("q_start"), F.col("q_end"))
    left = dealt(q, low - (maxgap + 1), high + (maxgap + 1), index.bins, "q")
    same = [F.col(f"q.{k}") == F.col(f"s.{k}") for k in KEYS]
    once = first_cell(F.col("q._cell"), F.greatest(low - (maxgap + 1), edges(F.col("s_start"), F.col("s_end"))[0]), index.bins)
    return _joined(left, index.read(), same, once & meets("any", maxgap, minoverlap), True).select("space", "query_id", "subject_id")

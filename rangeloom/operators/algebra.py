"""Interval algebra: range, reduce, gaps, disjoin, set operations, coverage and slices, all by sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..model import col
from ..plans.sweep import ROWS, chunked, merged, preceding, running, runs, segments, sliced, stretches, swept
from ..sources.scratch import kept


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows of each space from 1."""
    return df.withColumn("rid", F.row_number().over(Window.partitionBy("space").orderBy(*order)).cast("long"))


def hull(df: DataFrame, *, revmap: bool = False) -> DataFrame:
    """Per space: the range from the least start to the largest end, with all row numbers if asked."""
    more = [F.array_sort(F.collect_list("rid")).alias("revmap")] if revmap else []
    return df.groupBy("space").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more)


def islands(df: DataFrame, *, min_gap: int = 1, chunk: int | None = None, derived: bool = False) -> DataFrame:
    """Add ``island``, the row (start, end, rid) that begins the island to which each range belongs.

    In order of start and end, a range begins an island if it starts at least ``min_gap`` positions behind everything
    before it.
    """
    order = ["start", "end", "rid"]
    rows = swept(chunked(df, "start", chunk=chunk, derived=derived), {"_reach": ("max", F.col("end"))}, order, before=["_reach"])
    first = F.col("_reach").isNull() | (F.col("start") - F.col("_reach") - 1 >= min_gap)
    rows = swept(rows, {"island": ("max", F.when(first, F.struct(*order)))}, order)
    return rows.drop("_reach", "_chunk")


def reduce(df: DataFrame, *, drop_empty: bool = False, min_gap: int = 1, revmap: bool = False, chunk: int | None = None) -> DataFrame:
    """Merge ranges that overlap or lie fewer than ``min_gap`` positions apart.

    ``drop_empty``: islands of empty ranges go, and empty ranges don't move an island's start.  ``revmap``: the numbers
    of the merged rows, in order of start and end.  With ``min_gap`` 0 an empty range that repeats is merged away.
    """
    if not revmap:
        df = df.groupBy("space", "start", "end").agg(F.min("rid").alias("rid"))
    rows = islands(df, min_gap=min_gap, chunk=chunk, derived=not revmap)
    full = F.col("end") >= F.col("start")
    start = F.min(F.when(full, F.col("start"))) if drop_empty else F.min("start")
    more = [F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "rid"))), lambda x: x["rid"]).alias("revmap")] if revmap else []
    out = rows.groupBy("space", "island").agg(start.alias("start"), F.max("end").alias("end"), F.bool_or(full).alias("_full"), *more)
    if drop_empty:
        out = out.filter("_full")
    elif min_gap == 0:
        rank = F.row_number().over(Window.partitionBy("space", "start", "end").orderBy("island"))
        out = out.withColumn("_again", rank).filter("_full or _again = 1").drop("_again")
    return out.drop("island", "_full")


def inframe(df: DataFrame, *, chunk: int | None = None) -> DataFrame:
    """Each range's start after the gaps between the reduced ranges are squeezed out (which then begin at 1)."""
    rows = islands(df, chunk=chunk)
    whole = rows.groupBy("space", "island").agg(F.min("start").alias("_from"), F.max("end").alias("_to"))
    sums = running(whole, {"_before": ("sum", F.col("_to") - F.col("_from") + 1)}, "_from", ["_from", "_to", "island"], before=["_before"], chunk=chunk, derived=True)
    out = rows.join(sums.select("space", "island", "_from", "_before"), ["space", "island"])
    return out.withColumn("inframe", F.col("start") - F.col("_from") + F.col("_before") + 1).drop("island", "_from", "_before")


def gaps(df: DataFrame, low: Column | int | None = None, high: Column | int | None = None, *, spaces: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """What the ranges leave uncovered between the bounds; without bounds, between the ranges.

    Spaces without ranges are known only from ``spaces`` (column space); there both bounds together give a whole gap.
    """
    whole = low is not None and high is not None
    low, high = col(low), col(high)
    some = df.filter("end >= start").select("space", "start", "end")
    hulls = some.groupBy("space").agg(F.min("start").alias("_from"), F.max("end").alias("_to"))
    if spaces is not None or whole:
        hulls = (spaces if spaces is not None else df).select("space").distinct().join(hulls, "space", "left")
    frame = hulls.select("space", F.coalesce(low, "_from").alias("start"), F.coalesce(high, "_to").alias("end")).filter("end >= start")

    def events(rows: DataFrame, covered: int, framed: int) -> DataFrame:
        ends = F.array(*[F.struct(p.alias("pos"), F.lit(sign * covered).alias("c"), F.lit(sign * framed).alias("f")) for p, sign in ((F.col("start"), 1), (F.col("end") + 1, -1))])
        return rows.select("space", F.explode(ends).alias("_e")).select("space", "_e.*")

    cuts = (F.col("c") != 0) | (F.col("f") != 0)
    return stretches(events(some, 1, 0).unionByName(events(frame, 0, 1)), ["c", "f"], lambda n: (n["f"] > 0) & (n["c"] == 0), keep=cuts, chunk=chunk)


def disjoin(df: DataFrame, *, revmap: bool = False, chunk: int | None = None) -> DataFrame:
    """The segments between all starts and ends that some range covers; empty ranges only cut.

    ``revmap``: for each segment the numbers of the rows that cover it.
    """
    full = F.col("end") >= F.col("start")
    one = F.when(full, F.lit(1)).otherwise(F.lit(0))
    ends = F.array(F.struct(F.col("start").alias("pos"), one.alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-one).alias("d")))
    events = df.select("space", F.explode(ends).alias("_e")).select("space", "_e.pos", "_e.d")
    out = segments(events, ["d"], chunk=chunk).filter("d > 0").drop("d")
    if not revmap:
        return out
    from .overlaps import find

    out = kept(out, "segments")
    numbers = out.withColumn("rid", F.col("start"))
    hits = find(numbers, df.filter(full))
    back = hits.groupBy("space", F.col("query_id").alias("start")).agg(F.array_sort(F.collect_list("subject_id")).alias("revmap"))
    return out.join(back, ["space", "start"])


def _coloured(frame, state):
    """Bins of rows in order, and what is still open behind them.  ``state``: the open ends and their bins from before."""
    import heapq

    busy = [(int(e), int(k)) for e, k in zip(state[0], state[1], strict=True)] if state else []
    heapq.heapify(busy)
    top = state[2] if state else 0
    free = sorted(set(range(top)) - {k for _, k in busy})
    bins = []
    for s, e in zip(frame["start"].tolist(), frame["end"].tolist(), strict=True):
        while busy and busy[0][0] < s:
            heapq.heappush(free, heapq.heappop(busy)[1])
        if free:
            k = heapq.heappop(free)
        else:
            k, top = top, top + 1
        heapq.heappush(busy, (e, k))
        bins.append(k + 1)
    return bins, ([e for e, _ in busy], [k for _, k in busy], top)


def disjoint_bins(df: DataFrame, *, piece: int = ROWS, chunk: int | None = None) -> DataFrame:
    """The lowest bin in which each range overlaps no earlier one, in order of start: space, rid, start, end, bin.

    Ranges whose islands are apart don't touch each other's bins.  Islands are coloured in parallel, many to a task, and
    an island of more than ``piece`` rows is coloured piece by piece: what is open at a piece's end (as many ends as ranges
    overlap there) is handed on to the next, so each task holds a piece.  If the rows of a space are sorted by start already
    their order decides ties, else start and end.
    """
    df = kept(df.select("space", "rid", "start", "end"), "ranges")
    back = preceding(df, {"_before": F.col("start")}, "rid", ["rid"], chunk=chunk)
    mixed = back.groupBy("space").agg(F.coalesce(F.bool_or(F.col("start") < F.col("_before")), F.lit(False)).alias("_mixed"))
    rows = df.join(mixed, "space").withColumn("_tie", F.when(F.col("_mixed"), F.col("end")).otherwise(F.lit(0)))
    order = ["start", "_tie", "rid"]
    rows = swept(chunked(rows, "start", chunk=chunk), {"_reach": ("max", F.col("end")), "_row": ("sum", F.lit(1).cast("long"))}, order, before=["_reach"])
    first = F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))
    rows = swept(rows, {"_island": ("max", F.when(first, F.col("_row")))}, order)
    part = F.floor((F.col("_row") - F.col("_island")) / piece)
    rows = kept(rows.select("space", "rid", "start", "end", "_row", "_island", part.cast("long").alias("_part")), "islands")
    space, rid = (rows.schema[x].dataType for x in ("space", "rid"))
    shape = StructType().add("space", space).add("rid", rid).add("start", "long").add("end", "long").add("bin", "long").add("_island", "long").add("_ends", ArrayType(LongType())).add("_bins", ArrayType(LongType())).add("_top", "integer")

    def told(frame, bins, state, island, more: bool):
        """A row per range; the last one of a piece that another may follow has what is open."""
        out = frame[["space", "rid", "start", "end"]].assign(bin=bins, _island=island)
        none = [None] * (len(out) - 1)
        ends, held, top = state if more else (None, None, None)
        return out.assign(_ends=[*none, ends], _bins=[*none, held], _top=[*none, top])

    def begun(frame):
        import pandas as pd

        frame = frame.sort_values("_row")
        done = []
        for island, one in frame.groupby("_island", sort=False):
            bins, state = _coloured(one, None)
            done.append(told(one, bins, state, island, len(one) == piece))
        return pd.concat(done, ignore_index=True).astype({"_top": "Int32"})

    def gone_on(frame, before):
        frame = frame.sort_values("_row")
        open_ = before.iloc[0]
        bins, state = _coloured(frame, (open_["_ends"], open_["_bins"], int(open_["_top"])))
        return told(frame, bins, state, frame["_island"].iloc[0], len(frame) == piece).astype({"_top": "Int32"})

    last = rows.agg(F.max("_part")).first()[0] or 0
    # islands side by side share a task; the islands of a group begin within ``piece`` rows
    whole = rows.filter("_part = 0").withColumn("_group", F.floor(F.col("_island") / piece))
    step = kept(whole.groupBy("space", "_group").applyInPandas(begun, shape), "bins")
    columns = ["space", "rid", "start", "end", "bin"]
    out = step.select(*columns)
    for k in range(1, last + 1):
        state = step.filter("_ends is not null").select("space", "_island", "_ends", "_bins", "_top")
        keys = ["space", "_island"]
        step = kept(rows.filter(F.col("_part") == k).groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(_only_both(gone_on, shape), shape), "bins")
        out = out.unionByName(step.select(*columns))
    return out


def _only_both(function, shape: StructType):
    """For cogrouped rows: nothing where there are no rows to go on with."""

    def run(frame, before):
        import pandas as pd

        if frame.empty:
            return pd.DataFrame({f.name: [] for f in shape})
        return function(frame, before)

    return run


# ---- set operations --------------------------------------------------------------------------------------------------


def _both(x: DataFrame, y: DataFrame, holds, chunk: int | None) -> DataFrame:
    """The stretches on which a condition holds on the numbers of ranges of x and of y that cover a position."""

    def events(df: DataFrame, dx: int, dy: int) -> DataFrame:
        ends = F.array(*[F.struct(p.alias("pos"), F.lit(sign * dx).alias("cx"), F.lit(sign * dy).alias("cy")) for p, sign in ((F.col("start"), 1), (F.col("end") + 1, -1))])
        return df.filter("end >= start").select("space", F.explode(ends).alias("_e")).select("space", "_e.*")

    cuts = (F.col("cx") != 0) | (F.col("cy") != 0)
    return stretches(events(x, 1, 0).unionByName(events(y, 0, 1)), ["cx", "cy"], lambda n: holds(n["cx"] > 0, n["cy"] > 0), keep=cuts, chunk=chunk)


def union(x: DataFrame, y: DataFrame, *, chunk: int | None = None) -> DataFrame:
    return _both(x, y, lambda in_x, in_y: in_x | in_y, chunk)


def intersect(x: DataFrame, y: DataFrame, *, chunk: int | None = None) -> DataFrame:
    return _both(x, y, lambda in_x, in_y: in_x & in_y, chunk)


def setdiff(x: DataFrame, y: DataFrame, *, chunk: int | None = None) -> DataFrame:
    return _both(x, y, lambda in_x, in_y: in_x & ~in_y, chunk)


# ---- coverage --------------------------------------------------------------------------------------------------------


def circular(df: DataFrame, length: Column | int) -> DataFrame:
    """Ranges on circles of the given length: starts are moved into [1, length] and tails are folded to the front,
    once round for each whole circle in the width."""
    size = col(length)
    s = F.pmod(F.col("start") - 1, size) + 1
    moved = df.withColumns({"_s": s, "_e": s + F.col("end") - F.col("start"), "_l": size}).filter("_e >= _s")
    laps = moved.withColumn("_lap", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_e") - 1) / F.col("_l")))))
    start = F.greatest(F.col("_s") - F.col("_lap") * F.col("_l"), F.lit(1).cast("long"))
    end = F.least(F.col("_e") - F.col("_lap") * F.col("_l"), F.col("_l"))
    return laps.withColumns({"start": start, "end": end}).drop("_s", "_e", "_l", "_lap")


def coverage(
    df: DataFrame, *, shift: Column | str | int = 0, width: Column | str | int | None = None, weight: Column | str | int | float = 1, low: Column | int | None = 1, decimals: int = 12, chunk: int | None = None, dealt: bool = False
) -> DataFrame:
    """How many ranges (by weight) cover each position, as runs: space, start, end, value.

    Runs go from 1 to ``width``, or to the largest end; positions outside are left out, zeros inside are kept.  With
    ``low`` None they go from the least start.  Integer weights give integers; others are summed as decimals, so that
    the result doesn't depend on the order of summing and no residue is left.  ``dealt`` runs keep the chunks of the sweep
    (column ``_chunk``) and the value before each run (``_was``), which spares :func:`slice_runs` a sweep.
    """
    by = col(shift) if not isinstance(shift, str) else F.col(shift)
    w = F.lit(weight) if isinstance(weight, (int, float)) else col(weight)
    moved = df.select("space", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), w.alias("w"), col(width).alias("_width"))
    real = dict(moved.dtypes)["w"] in ("double", "float") or dict(moved.dtypes)["w"].startswith("decimal")
    moved = moved.withColumn("w", F.col("w").cast(f"decimal(38,{decimals})" if real else "long"))
    lengths = moved.groupBy("space").agg(F.coalesce(F.max("_width"), F.greatest(F.max("end"), F.lit(0))).alias("_top"), F.min("start").alias("_low"))
    bottom = F.col("_low") if low is None else col(low)
    clipped = moved.drop("_width").join(lengths, "space").withColumns({"start": F.greatest(F.col("start"), bottom), "end": F.least("end", "_top")}).filter("end >= start")
    ends = F.array(F.struct(F.col("start").alias("pos"), F.col("w").alias("value")), F.struct((F.col("end") + 1).alias("pos"), (-F.col("w")).alias("value")))
    events = clipped.select("space", F.explode(ends).alias("_e")).select("space", "_e.pos", "_e.value")
    frame = lengths.filter(F.col("_top") >= bottom).select("space", F.explode(F.array(F.struct(bottom.alias("pos"), F.lit(1).alias("_edge")), F.struct((F.col("_top") + 1).alias("pos"), F.lit(-1).alias("_edge")))).alias("_f"))
    frame = frame.select("space", "_f.pos", F.lit(0).cast(dict(events.dtypes)["value"]).alias("value"), "_f._edge")
    # a run ends where the changes at a position don't cancel out, and at the frame's edges
    cuts = (F.col("value") != 0) | (F.col("_edge") != 0)
    runs = segments(events.withColumn("_edge", F.lit(0)).unionByName(frame), ["value", "_edge"], keep=cuts, chunk=chunk, dealt=dealt)
    if dealt:
        runs = runs.withColumn("_was", F.when(F.col("_was__edge") > 0, F.col("_was_value"))).drop("_was_value", "_was__edge")
    return runs.withColumns({k: F.col(k).cast("double") if real else F.col(k) for k in ("value", *["_was"] * dealt)}).drop("_edge")


def window_coverage(df: DataFrame, low: int | None = None, high: int | None = None, *, weight=1, collapse: bool = True, chunk: int | None = None) -> DataFrame:
    """Coverage over the window [low, high] (default each space's hull), as runs or, not collapsed, a row per position."""
    some = df if high is None else df.filter(F.col("start") <= high)
    out = coverage(some, weight=weight, low=low, width=None if high is None else F.lit(high).cast("long"), chunk=chunk)
    if collapse:
        return out
    return out.withColumn("pos", F.explode(F.sequence("start", "end"))).select("space", "pos", "value")


def slice_runs(table: DataFrame, lower: float | None = None, upper: float | None = None, *, include_lower: bool = True, include_upper: bool = True, chunk: int | None = None) -> DataFrame:
    """The longest stretches of a run table whose values lie in the bounds, as ranges."""

    def ok(name: str) -> Column:
        x = F.col(name)
        out = x.isNotNull()
        if lower is not None:
            out = out & ((x >= lower) if include_lower else (x > lower))
        if upper is not None:
            out = out & ((x <= upper) if include_upper else (x < upper))
        return F.coalesce(out, F.lit(False))

    if "_was" in table.columns:
        return sliced(table, ok("value"), ok("_was"))
    return merged(table.filter(ok("value")).select("space", "start", "end"), chunk=chunk)


# ---- run tables ------------------------------------------------------------------------------------------------------


def align(*tables: DataFrame, chunk: int | None = None) -> DataFrame:
    """Run tables side by side: common runs with the values v1, v2, ... (null where a table has no run).

    One sweep over all starts and ends carries each table's last run along.
    """
    names = [f"_t{i}" for i in range(1, len(tables) + 1)]
    kinds = [f"struct<s:bigint,e:bigint,v:{t.schema['value'].dataType.simpleString()}>" for t in tables]
    cuts = None
    for name, t in zip(names, tables, strict=True):
        run = F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("value").alias("v"))
        at = F.explode(F.array(F.struct(F.col("start").alias("pos"), run.alias("run")), F.struct((F.col("end") + 1).alias("pos"), F.lit(None).cast(kinds[names.index(name)]).alias("run"))))
        own = t.select("space", at.alias("_a")).select("space", "_a.pos", *[F.col("_a.run").alias(n) if n == name else F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])
        cuts = own if cuts is None else cuts.unionByName(own)
    rows = chunked(cuts.groupBy("space", "pos").agg(*[F.max(n).alias(n) for n in names]), "pos", chunk=chunk, derived=True)
    rows = swept(rows, {n: ("max", F.col(n)) for n in names} | {"_next": ("next", F.col("pos"))}, ["pos"])
    open_ = [F.col(n)["e"] >= F.col("pos") for n in names]
    some = open_[0]
    for one in open_[1:]:
        some = F.coalesce(some, F.lit(False)) | F.coalesce(one, F.lit(False))
    out = rows.filter(F.col("_next").isNotNull() & F.coalesce(some, F.lit(False)))
    return out.select("space", F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"), *[F.when(on, F.col(n)["v"]).alias(f"v{i}") for i, (n, on) in enumerate(zip(names, open_, strict=True), 1)])


def runs_of(df: DataFrame, value: str = "value") -> DataFrame:
    """Run-length encoding of a vector (space, rid, value) with rows numbered from 1 without holes."""
    return runs(df, value).withColumnRenamed(value, "value")


def split_runs(runs: DataFrame) -> DataFrame:
    """The runs grouped by value: per value its ranges, in order."""
    return runs.groupBy("space", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat_ws("-", x["start"], x["end"])).alias("ranges"))


def order_runs(runs: DataFrame) -> DataFrame:
    """The runs in order of their values (ties by start): place, start, end."""
    if dict(runs.dtypes)["value"].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        w = Window.partitionBy("space").orderBy("value", "start")  # only numbers can be dealt to chunks
        return runs.withColumn("place", F.row_number().over(w).cast("long"))
    null = F.col("value").isNull()
    rows = runs.withColumns({"_null": null, "_at": F.coalesce(F.col("value").cast("double"), F.lit(0.0))})
    rows = running(rows, {"_place": ("sum", F.lit(1).cast("long"))}, "_at", ["_at", "start"], by=("space", "_null"))
    nulls = runs.groupBy("space").agg(F.count(F.when(null, 1)).alias("_nulls"))
    place = F.col("_place") + F.when(F.col("_null"), F.lit(0)).otherwise(F.col("_nulls"))
    return rows.join(nulls, "space").select(*runs.columns, place.alias("place"))


def dice(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs cut at the borders of adjacent parts (space, rid, start, end): part, start, end, value."""
    from .overlaps import find

    own = kept(runs.withColumn("rid", F.col("start")), "runs")
    hits = find(own.select("space", "rid", "start", "end"), parts)
    out = hits.join(own.withColumnRenamed("rid", "query_id"), ["space", "query_id"]).join(parts.select("space", F.col("rid").alias("subject_id"), F.col("start").alias("_s"), F.col("end").alias("_e")), ["space", "subject_id"])
    return out.select("space", F.col("subject_id").alias("part"), F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end"), "value")

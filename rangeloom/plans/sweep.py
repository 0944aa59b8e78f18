"""Running values over sorted positions, in two levels.

A window over a whole group would put that group into one task.  Here a group's positions are dealt to chunks, each chunk
sums up what it hands on (a row), a window over those few rows turns them into what each chunk receives from those before
and behind it, and the values are finished inside the chunks.

Rows move once, when they are dealt to chunks: the sums and the rows read the same exchange, and further sweeps along the
same positions (``dealt`` frames, which have the column ``_chunk``) need no other.

Chunks are as wide as a group's rows need: each group has about a chunk per ``ROWS`` rows, so what is handed on stays small
beside the rows.  Where a group's rows crowd together is counted first, in pieces of its positions, and chunks are narrow
there; only rows that crowd inside a piece, a thousandth of a group's positions, can make a chunk larger.

Finding the chunks reads the rows several times.  Rows that come from a shuffle or another sweep are therefore stored first
(``derived``): sweeps stacked on sweeps then cost their sum, and not a power of what one costs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Rows in a chunk, about, and the number of chunks that groups of fewer rows are cut into (of 64 rows at least).
ROWS, SOME = 1 << 17, 8

#: Pieces of equal width in which the rows of a group are counted that has more than two chunks' rows.
PIECES = 1024

#: How a running value is made: "sum" and "max" of the rows before, "next": the least of the rows behind, "top": the
#: largest of all rows.
_AGG = {"sum": F.sum, "max": F.max, "next": F.min, "top": F.max}


def chunked(df: DataFrame, at: str, *, chunk: int | None = None, by: Sequence[str] = ("space",), derived: bool = False) -> DataFrame:
    """Deal rows to chunks of positions ``at``: adds ``_chunk`` and moves the rows there.

    ``chunk`` is the number of positions in a chunk; if it isn't given, the rows are counted to find each group's, and
    stored before that if they are ``derived`` (if it costs more to make them again than to read them).
    """
    if chunk is not None:
        return df.withColumn("_chunk", F.floor(F.col(at) / chunk).cast("long")).repartition(*by, "_chunk")
    if derived:
        df = kept(df, "swept")
    grid, place = gridded(df, at, by=by)
    return _with_group(df, grid, by).withColumn("_chunk", place(at)).drop(*GRID).repartition(*by, "_chunk")


#: The columns of a grid: each group's least position, the width of its cells, the number of the last one, and the rows up
#: to each cell's end (from 0; null where cells are chunks).
GRID = ("_grid_low", "_grid_width", "_grid_top", "_grid_rows")


def gridded(df: DataFrame, at: str, *, by: Sequence[str] = ("space",)) -> tuple[DataFrame, Callable[[str], Column]]:
    """Each group's chunks of positions ``at``, a row per group; and how to tell a position's chunk in rows joined to them
    (positions outside count to the first or last).

    A group of at most two chunks' rows is cut evenly.  The rows of others are counted in ``PIECES`` cells, and a position's
    chunk is the number of rows before it, taken to be even inside a cell, over ``ROWS``.  Both are exact counts, so that
    tasks that run again deal the same rows to the same chunks.
    """
    low, width, top, upto = GRID
    n = F.count(F.lit(1))
    cells = F.when(n > 2 * ROWS, F.lit(PIECES)).otherwise(F.least(F.lit(SOME), F.ceil(n / 64)))
    size = F.greatest(F.ceil((F.max(at).cast("double") - F.min(at) + 1) / cells), F.lit(1)).cast("double")
    last = F.floor((F.max(at).cast("double") - F.min(at)) / size).cast("long")
    grid = df.groupBy(*by).agg(F.min(at).alias(low), size.alias(width), last.alias(top), n.alias("_n"))

    def cell(position: str) -> Column:
        found = F.floor((F.col(position).cast("double") - F.col(low)) / F.col(width)).cast("long")
        return F.greatest(F.least(found, F.col(top)), F.lit(0))

    large = grid.filter(F.col("_n") > 2 * ROWS)
    counts = _with_group(df.select(*by, at), large, by).groupBy(*by, cell(at).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*by).orderBy("_cell")  # at most PIECES rows a group
    counts = counts.select(*by, "_cell", F.sum("_n").over(along).alias("_upto"), F.lead("_cell").over(along).alias("_other"))
    steps = F.array_sort(F.collect_list(F.struct("_cell", "_upto", (F.coalesce("_other", F.col("_cell") + 1) - F.col("_cell")).cast("int").alias("_times"))))
    filled = F.flatten(F.transform(steps, lambda x: F.array_repeat(x["_upto"], x["_times"])))
    rows = counts.groupBy(*by).agg(F.concat(F.array(F.lit(0).cast("long")), filled).alias(upto)).filter(F.size(upto) > 1)  # without groups there is a row even of no counts
    grid = grid.drop("_n").join(rows, list(by) if by else F.lit(True), "left")

    def place(position: str) -> Column:
        at_cell = cell(position)
        share = (F.col(position).cast("double") - F.col(low)) / F.col(width) - at_cell
        share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
        before, end = F.get(F.col(upto), at_cell.cast("int")), F.get(F.col(upto), at_cell.cast("int") + 1)
        return F.when(F.col(upto).isNull(), at_cell).otherwise(F.floor((before + share * (end - before)) / ROWS).cast("long"))

    return grid, place


def _with_group(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group; without groups ``groups`` has a row at most."""
    return df.join(groups, list(by)) if by else df.crossJoin(F.broadcast(groups))


def swept(rows: DataFrame, values: dict[str, tuple[str, Column]], order: Sequence[str], *, before: Sequence[str] = (), by: Sequence[str] = ("space",)) -> DataFrame:
    """Add running values along ``order`` in each group ``by`` to rows from :func:`chunked`, in one window pass.

    ``values`` maps a new column to ("sum" | "max" | "next" | "top", expression).  Sums and maxima include the row itself unless
    their column is named in ``before``; "next" is the least value of all rows behind, "top" the
    largest of all.  A sum of no rows is 0, the others
    are null.
    """
    raw = {f"_v_{k}": e for k, (_, e) in values.items()}
    rows = rows.withColumns(raw)
    carry = rows.groupBy(*by, "_chunk").agg(*[_AGG[how](f"_v_{k}").alias(f"_c_{k}") for k, (how, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    over = {"next": later, "top": Window.partitionBy(*by)}
    carry = carry.select(*by, "_chunk", *[_AGG[how](f"_c_{k}").over(over.get(how, earlier)).alias(f"_c_{k}") for k, (how, _) in values.items()])
    rows = rows.join(carry, [*by, "_chunk"])
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    behind = Window.partitionBy(*by, "_chunk").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    done = {}
    for k, (how, _) in values.items():
        if how == "top":
            done[k] = F.col(f"_c_{k}")
            continue
        frame = behind if how == "next" else inside.rowsBetween(Window.unboundedPreceding, -1 if k in before else 0)
        own, other = _AGG[how](f"_v_{k}").over(frame), F.col(f"_c_{k}")
        done[k] = {"max": F.greatest, "next": F.least}[how](other, own) if how != "sum" else F.coalesce(other, F.lit(0)) + F.coalesce(own, F.lit(0))
    return rows.withColumns(done).drop(*raw, *[f"_c_{k}" for k in values])


def running(df: DataFrame, values: dict[str, tuple[str, Column]], at: str, order: Sequence[str], *, before: Sequence[str] = (), chunk: int | None = None, by: Sequence[str] = ("space",), derived: bool = False) -> DataFrame:
    """:func:`swept` over rows that aren't dealt yet; ``order`` starts with position ``at``.  ``derived``: see :func:`chunked`."""
    return swept(chunked(df, at, chunk=chunk, by=by, derived=derived), values, order, before=before, by=by).drop("_chunk")


def preceding(df: DataFrame, values: dict[str, Column], at: str, order: Sequence[str], *, chunk: int | None = None, by: Sequence[str] = ("space",)) -> DataFrame:
    """Add what each expression is in the row before along ``order`` (which starts with position ``at``) in each group
    ``by``; null in the first row."""
    return _with_last(chunked(df, at, chunk=chunk, by=by), values, order, by).drop("_chunk")


def _with_last(rows: DataFrame, values: dict[str, Column], order: Sequence[str], by: Sequence[str], more: dict | None = None) -> DataFrame:
    """The row before is the largest of those before, if rows are compared by ``order`` first.  ``more`` is swept along."""
    own = F.struct(F.struct(*order).alias("o"), F.struct(*[e.alias(k) for k, e in values.items()]).alias("v"))
    rows = swept(rows, {"_last": ("max", own)} | (more or {}), order, before=["_last"], by=by)
    return rows.withColumns({k: F.col("_last.v")[k] for k in values}).drop("_last")


def segments(events: DataFrame, changes: Sequence[str], *, keep: Column | None = None, chunk: int | None = None, by: Sequence[str] = ("space",), dealt: bool = False) -> DataFrame:
    """From events (position, changes) the segments between positions: start, end and the running sum of each change.

    Changes at one position are summed first, so a position that very many ranges share is a single row.  Of those rows
    only the ones for which ``keep`` holds cut (the others must change nothing).  ``dealt`` keeps ``_chunk`` and adds
    what each sum was before, ``_was_...``.
    """
    rows = _positions(events, changes, keep, chunk, by)
    values = {f"_r_{c}": ("sum", F.col(c)) for c in changes} | {"_next": ("next", F.col("pos"))}
    run = swept(rows, values, ["pos"], by=by).filter(F.col("_next").isNotNull())
    more = ["_chunk", *[(F.col(f"_r_{c}") - F.col(c)).alias(f"_was_{c}") for c in changes]] if dealt else []
    return run.select(*by, *more, F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"), *[F.col(f"_r_{c}").alias(c) for c in changes])


def _positions(events: DataFrame, changes: Sequence[str], keep: Column | None, chunk: int | None, by: Sequence[str]) -> DataFrame:
    summed = events.groupBy(*by, "pos").agg(*[F.sum(c).alias(c) for c in changes])
    return chunked(summed if keep is None else summed.filter(keep), "pos", chunk=chunk, by=by, derived=True)


def stretches(events: DataFrame, changes: Sequence[str], holds, *, keep: Column | None = None, chunk: int | None = None, by: Sequence[str] = ("space",)) -> DataFrame:
    """From events (position, changes) the longest stretches on which a condition on the running sums holds: start, end.

    ``holds`` makes the condition from a dictionary of columns; it must not hold where all sums are 0.
    """
    rows = swept(_positions(events, changes, keep, chunk, by), {f"_r_{c}": ("sum", F.col(c)) for c in changes}, ["pos"], by=by)
    now, was = holds({c: F.col(f"_r_{c}") for c in changes}), holds({c: F.col(f"_r_{c}") - F.col(c) for c in changes})
    edges = rows.select(*by, "_chunk", "pos", now.alias("_now"), was.alias("_was")).filter("_now <> _was")
    return swept(edges, {"_next": ("next", F.col("pos"))}, ["pos"], by=by).filter("_now").select(*by, F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"))


def sliced(runs: DataFrame, now: Column, was: Column, *, by: Sequence[str] = ("space",)) -> DataFrame:
    """The longest stretches of dealt runs that cover a group without holes on which a condition holds: it is given for
    each run and for the run before (false in the first)."""
    rows = runs.select(*by, "_chunk", "start", "end", now.alias("_now"), was.alias("_was"))
    turn = F.when(F.col("_now") != F.col("_was"), F.col("start"))
    rows = swept(rows, {"_next": ("next", turn), "_top": ("top", F.col("end"))}, ["start"], by=by).filter("_now and not _was")
    return rows.select(*by, "start", F.coalesce(F.col("_next") - 1, F.col("_top")).alias("end"))


def merged(parts: DataFrame, same: Sequence[str] = (), *, chunk: int | None = None, by: Sequence[str] = ("space",)) -> DataFrame:
    """Merge disjoint segments that touch and agree in the columns ``same``; ``parts`` may be dealt already."""
    rows = parts if "_chunk" in parts.columns else chunked(parts, "start", chunk=chunk, by=by, derived=True)
    key = F.struct(*[F.col(c) for c in same]) if same else F.lit(0)
    rows = _with_last(rows.withColumn("_key", key), {"_before": F.col("end"), "_other": F.col("_key")}, ["start"], by, {"_top": ("top", F.col("end"))})
    first = F.col("_before").isNull() | (F.col("_before") != F.col("start") - 1) | ~F.col("_other").eqNullSafe(F.col("_key"))
    return _islands(rows, first, by).select(*by, "start", "end", *same)


def runs(rows: DataFrame, value: str, *, chunk: int | None = None, by: Sequence[str] = ("space",)) -> DataFrame:
    """The runs of equal values in row order (column rid): start and end (the first and last row), value."""
    rows = _with_last(chunked(rows, "rid", chunk=chunk, by=by), {"_before": F.col("rid"), "_other": F.col(value)}, ["rid"], by, {"_top": ("top", F.col("rid"))})
    first = F.col("_before").isNull() | ~F.col("_other").eqNullSafe(F.col(value))
    return _islands(rows.withColumns({"start": F.col("rid"), "end": F.col("rid")}), first, by).select(*by, "start", "end", value)


def _islands(rows: DataFrame, first: Column, by: Sequence[str]) -> DataFrame:
    """The rows that begin an island, each with the end of its island.

    Such a row also tells where the island before ends (``_before``, the end of the row before); the last island of a
    group ends with its last row (``_top``).  So only the beginnings are left to be swept.
    """
    island = F.struct(F.col("start").alias("s"), F.col("_before").alias("e"))
    rows = swept(rows.filter(first), {"_next": ("next", island)}, ["start"], by=by)
    return rows.withColumn("end", F.coalesce("_next.e", "_top"))

"""The data model: range frames, their construction, checks and accessors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.sweep import preceding, running

KEY = ("space", "rid", "start", "end")
LIMIT = 2**31 - 1


def col(x: Column | str | int | None) -> Column:
    return F.lit(x).cast("long") if x is None or isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def fail_if(wrong: Column, message: str, value: Column) -> Column:
    """``value``, or an error at run time where ``wrong`` holds."""
    return F.when(wrong, F.raise_error(F.lit(message)).cast("long")).otherwise(value)


def width(start: Column | str = "start", end: Column | str = "end") -> Column:
    return col(end) - col(start) + 1


def mid(start: Column | str = "start", end: Column | str = "end") -> Column:
    """Middle position; halves are cut toward zero, so an empty range's middle is its start."""
    return col(start) + F.expr("0") + F.signum(width(start, end) - 1).cast("long") * F.floor(F.abs(width(start, end) - 1) / 2)


def extra(df: DataFrame) -> list[str]:
    """The columns of a range frame beside the four that make a range."""
    return [c for c in df.columns if c not in KEY]


# ---- constructors ----------------------------------------------------------------------------------------------------


def ranges(df: DataFrame, *, start=None, end=None, width=None, space=0, rid=None, strict: bool = False) -> DataFrame:
    """A range frame from any two of start, end and width, row by row: nulls are solved from the other two.

    Errors: fewer than two known, three that disagree, a negative width, and in strict mode a bound beyond 32 bits.
    """
    s, e, w = (col(x).cast("long") for x in (start, end, width))
    known = s.isNotNull().cast("int") + e.isNotNull().cast("int") + w.isNotNull().cast("int")
    first = F.coalesce(s, e - w + 1)
    last = F.coalesce(e, s + w - 1)
    wrong = (known < 2) | F.coalesce(last - first + 1 != w, F.lit(False)) | F.coalesce(last < first - 1, F.lit(False))
    if strict:
        wrong = wrong | (F.abs(first) > LIMIT) | (F.abs(last) > LIMIT)
    number = col(rid) if rid is not None else F.monotonically_increasing_id()
    out = df.withColumns({"_s": fail_if(wrong, "start, end and width can't be solved", first), "_e": last})
    rest = [c for c in df.columns if c not in KEY]
    return out.select((col(space) if not isinstance(space, int) else F.lit(space).cast("long")).alias("space"), number.alias("rid"), F.col("_s").alias("start"), F.col("_e").alias("end"), *rest)


def solve_window(refwidth, start=None, end=None, width=None, *, negative: bool = True, widening: bool = False) -> tuple[Column, Column]:
    """A window inside [1, refwidth] from at most two of start, end and width: (start, end).

    Negative coordinates count from the end (-1 is the last).  A width alone is an error, as is a window that leaves
    [1, refwidth] unless ``widening``.
    """
    ref = col(refwidth)
    turn = lambda x: F.when(x < 0, x + ref + 1).otherwise(x) if negative else x
    s, e, w = turn(col(start).cast("long")), turn(col(end).cast("long")), col(width).cast("long")
    first = F.coalesce(s, F.when(w.isNotNull(), e - w + 1).otherwise(F.lit(1)))
    last = F.coalesce(F.when(w.isNotNull() & s.isNotNull(), s + w - 1), e, ref)
    wrong = (w.isNotNull() & (s.isNull() == e.isNull())) | F.coalesce(w < 0, F.lit(False)) | (last < first - 1)
    if not widening:
        wrong = wrong | (first < 1) | (last > ref)
    return fail_if(wrong, "the window can't be solved", first), last


#: "a-b", "a..b" or "p".
TEXT = r"^\s*(-?\d+)(?:\s*(?:-|\.\.)\s*(-?\d+))?\s*$"


def from_text(df: DataFrame, text: str, *, space=0, rid=None) -> DataFrame:
    """Ranges from their written form; anything else is an error."""
    first, last = F.regexp_extract(text, TEXT, 1), F.regexp_extract(text, TEXT, 2)
    start = fail_if(~F.col(text).rlike(TEXT), "not a range", F.nullif(first, F.lit("")).cast("long"))
    return ranges(df, start=start, end=F.coalesce(F.nullif(last, F.lit("")), first).cast("long"), space=space, rid=rid)


def to_text(start: Column | str = "start", end: Column | str = "end") -> Column:
    """The written form: "p" for a single position, else "start-end"."""
    s, e = col(start), col(end)
    return F.when(s == e, s.cast("string")).otherwise(F.concat_ws("-", s.cast("string"), e.cast("string")))


def _islands(df: DataFrame, value: str, next_to: str) -> DataFrame:
    """Rows in row order with the number of their island: one begins where ``value`` isn't the row before's ``next_to`` + 1."""
    rows = preceding(df, {"_before": F.col(next_to)}, "rid", ["rid"])
    first = F.coalesce(F.col(value) != F.col("_before") + 1, F.lit(True))
    return running(rows, {"island": ("sum", first.cast("long"))}, "rid", ["rid"])


def from_integers(df: DataFrame, value: str = "pos") -> DataFrame:
    """Runs of values that grow by one, in row order, as ranges (columns space, rid, value)."""
    marked = _islands(df, value, value)
    runs = marked.groupBy("space", "island").agg(F.min(value).alias("start"), F.max(value).alias("end"))
    return runs.select("space", F.col("island").alias("rid"), "start", "end")


def from_logical(df: DataFrame, value: str = "value") -> DataFrame:
    """The runs of true values as normal ranges of row numbers; a null is an error."""
    checked = df.withColumn("pos", fail_if(F.col(value).isNull(), "nulls aren't allowed", F.col("rid")))
    return from_integers(checked.filter(F.col("pos").isNotNull() & F.col(value)))


def from_logical_runs(runs: DataFrame, value: str = "value") -> DataFrame:
    """The true runs of a run table (space, start, end, value) as ranges."""
    checked = runs.withColumn("start", fail_if(F.col(value).isNull(), "nulls aren't allowed", F.col("start"))).filter(F.col("start").isNotNull() & F.col(value))
    return running(checked, {"_n": ("sum", F.lit(1).cast("long"))}, "start", ["start"]).select("space", F.col("_n").alias("rid"), "start", "end")


def positions(df: DataFrame) -> DataFrame:
    """Each position of each range as a row: the range's columns and pos; empty ranges give none."""
    return df.filter("end >= start").withColumn("pos", F.explode(F.sequence("start", "end"))).drop("start", "end")


def stitch(df: DataFrame) -> DataFrame:
    """Neighbouring rows of which one starts right behind the other's end, merged in row order; empty ranges are dropped."""
    marked = _islands(df.filter("end >= start"), "start", "end")
    return marked.groupBy("space", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("space", F.col("island").alias("rid"), "start", "end")


def successive(df: DataFrame, width: str = "width", *, gap: int = 0, first: int = 1) -> DataFrame:
    """Ranges of the given widths, one behind the other in row order with ``gap`` positions between."""
    out = running(df, {"_before": ("sum", F.col(width) + gap)}, "rid", ["rid"], before=["_before"])
    out = out.withColumn("start", F.lit(first) + F.col("_before")).drop("_before")
    return out.withColumn("end", F.col("start") + F.col(width) - 1)


def sliding(spark: SparkSession, length: int, width: int, shift: int = 1) -> DataFrame:
    """Windows of one width that fit into [1, length], ``shift`` apart.

    The last window that fits is included.
    """
    n = max(0, (length - width) // shift + 1)
    return spark.range(n).select(F.lit(0).cast("long").alias("space"), (F.col("id") + 1).alias("rid"), (F.col("id") * shift + 1).alias("start"), (F.col("id") * shift + width).alias("end"))


def chunks(spark: SparkSession, total: int, *, n: int | None = None, size: int | None = None) -> DataFrame:
    """[1, total] cut into ``n`` chunks of about equal size, or into chunks of ``size`` with a short last one."""
    if (n is None) == (size is None):
        raise ValueError("give n or size")
    if n is None:
        n = -(-total // size)
        end = F.least((F.col("id") + 1) * size, F.lit(total))
        start = F.col("id") * size + 1
    else:
        end = F.floor((F.col("id") + 1) * total / n).cast("long")
        start = F.floor(F.col("id") * total / n).cast("long") + 1
    return spark.range(n).select(F.lit(0).cast("long").alias("space"), (F.col("id") + 1).alias("rid"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def centered(df: DataFrame, center: str, flank) -> DataFrame:
    return df.withColumns({"start": col(center) - col(flank), "end": col(center) + col(flank)})


def grouped(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """A table split by a column: a row per group with its rows as a list of structs in row order."""
    rows = F.array_sort(F.collect_list(F.struct("rid", *values)))
    return df.groupBy(by).agg(F.transform(rows, lambda x: F.struct(*[x[v].alias(v) for v in values])).alias("rows"))


# ---- checks ----------------------------------------------------------------------------------------------------------


def is_normal(df: DataFrame) -> DataFrame:
    """Per space: whether all ranges are non-empty and, in row order, apart by a position at least; and the first row
    that is not (null if normal)."""
    rows = preceding(df, {"_end": F.col("end")}, "rid", ["rid"])
    bad = (F.col("end") < F.col("start")) | F.coalesce(F.col("start") < F.col("_end") + 2, F.lit(False))
    return rows.withColumn("bad", bad).groupBy("space").agg((~F.bool_or("bad")).alias("normal"), F.min(F.when(F.col("bad"), F.col("rid"))).alias("first_bad"))


def is_disjoint(df: DataFrame) -> DataFrame:
    """Per space: whether, sorted by start and width, each range starts behind the end of the one before."""
    rows = preceding(df, {"_end": F.col("end")}, "start", ["start", "end", "rid"])
    bad = F.coalesce(F.col("start") <= F.col("_end"), F.lit(False))
    return rows.withColumn("bad", bad).groupBy("space").agg((~F.bool_or("bad")).alias("disjoint"))


# ---- setters and subsets ---------------------------------------------------------------------------------------------


def set_start(df: DataFrame, start) -> DataFrame:
    """A new start under the same end."""
    return df.withColumn("start", fail_if(col("end") < col(start) - 1, "negative width", col(start)))


def set_end(df: DataFrame, end) -> DataFrame:
    return df.withColumn("end", fail_if(col(end) < F.col("start") - 1, "negative width", col(end)))


def set_width(df: DataFrame, width) -> DataFrame:
    """A new width under the same start."""
    return df.withColumn("end", fail_if(col(width) < 0, "negative width", F.col("start") + col(width) - 1))


def update(df: DataFrame, *, start=None, end=None, width=None) -> DataFrame:
    """Any one or two of start, end and width."""
    given = [x is not None for x in (start, end, width)]
    if sum(given) > 2:
        raise ValueError("at most two of start, end and width")
    if start is not None and width is not None:
        s, e = col(start), col(start) + col(width) - 1
    elif end is not None and width is not None:
        s, e = col(end) - col(width) + 1, col(end)
    elif width is not None:
        s, e = F.col("start"), F.col("start") + col(width) - 1
    else:
        s = col(start) if start is not None else F.col("start")
        e = col(end) if end is not None else F.col("end")
    return df.withColumns({"start": fail_if(e < s - 1, "negative width", s), "end": e})


def take(df: DataFrame, at: DataFrame) -> DataFrame:
    """Rows by number: ``at`` has (n, rid), the place in the result and the row; a row may be taken often.

    A number that no row has is an error.
    """
    hit = at.join(df.withColumn("found", F.lit(True)), "rid", "left")
    hit = hit.withColumn("n", fail_if(F.col("found").isNull(), "subscript out of bounds", F.col("n")))
    return hit.filter(F.col("n").isNotNull()).drop("found")


def take_ranges(df: DataFrame, at: DataFrame) -> DataFrame:
    """The rows whose numbers lie in any of the ranges ``at`` (start, end), once for each range that holds them."""
    wanted = at.filter("end >= start").select(F.explode(F.sequence("start", "end")).alias("rid"))
    return df.join(wanted, "rid")


def assign(df: DataFrame, new: DataFrame) -> DataFrame:
    """Rows replaced by those of ``new`` with the same number."""
    names = [c for c in df.columns if c != "rid"]
    fresh = new.select("rid", F.struct(*names).alias("_new"))
    return df.join(fresh, "rid", "left").select("rid", *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in names])


def replace_window(df: DataFrame, first: int, last: int, new: DataFrame) -> DataFrame:
    """Rows ``first`` to ``last`` replaced by the rows of ``new`` (numbered from 1), the rest numbered anew."""
    n = new.agg(F.count(F.lit(1)).alias("n"))
    move = F.col("n") - (last - first + 1)
    tail = df.filter(F.col("rid") > last).join(F.broadcast(n)).withColumn("rid", F.col("rid") + move).drop("n")
    return df.filter(F.col("rid") < first).unionByName(new.withColumn("rid", F.col("rid") + first - 1)).unionByName(tail)


def concat(*frames: DataFrame) -> DataFrame:
    """Frames one behind the other; rows keep their space and are numbered by frame and row."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    from .plans.sweep import running

    rows = running(out, {"_number": ("sum", F.lit(1).cast("long"))}, "rid", ["rid"], by=("space", "part"))
    # a row per space and frame
    w = Window.partitionBy("space").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = out.groupBy("space", "part").agg(F.count(F.lit(1)).alias("_n")).select("space", "part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    numbered = rows.join(before, ["space", "part"]).withColumn("rid", F.col("_number") + F.col("_before"))
    return numbered.select(*[c for c in out.columns if c != "part"])


def sizes(df: DataFrame) -> DataFrame:
    """Per space: number of ranges, whether there is none that isn't empty, and the sum of widths."""
    return df.groupBy("space").agg(F.count(F.lit(1)).alias("length"), F.sum(width()).alias("width_sum"), (F.max(width()) == 0).alias("all_empty"))

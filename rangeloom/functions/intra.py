"""Row-wise transforms of ranges: projections only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LIMIT, col, fail_if, solve_window, width


def _with(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.withColumns({"start": start.cast("long"), "end": end.cast("long")})


def shift(df: DataFrame, by, *, strict: bool = True) -> DataFrame:
    """Move by ``by``; a null, or in strict mode a bound beyond 32 bits, is an error."""
    by = col(by)
    wrong = by.isNull()
    if strict:
        wrong = wrong | (F.abs(F.col("start") + by) > LIMIT) | (F.abs(F.col("end") + by) > LIMIT)
    return _with(df, fail_if(wrong, "shift is null or leaves the allowed range", F.col("start") + by), F.col("end") + by)


def narrow(df: DataFrame, start=None, end=None, width_=None) -> DataFrame:
    """A window inside each range, in coordinates relative to it."""
    s, e = solve_window(width(), start, end, width_)
    return _with(df, F.col("start") + s - 1, F.col("start") + e - 1)


def resize(df: DataFrame, to, fix: str | Column = "start") -> DataFrame:
    """A new width; ``fix`` (start, end or center, or a column of them) stays.  Halves are rounded down."""
    to, by = col(to), width() - col(to)
    fix = F.lit(fix) if isinstance(fix, str) else fix
    s = F.col("start") + F.when(fix == "end", by).when(fix == "center", F.floor(by / 2)).otherwise(F.lit(0))
    return _with(df, fail_if(to < 0, "negative width", s), s + to - 1)


def flank(df: DataFrame, by, *, start: bool | Column = True, both: bool = False) -> DataFrame:
    """The ``by`` positions before the start (or behind the end); a negative number flanks inside; both: around it."""
    by, at_start = col(by), F.lit(start) if isinstance(start, bool) else start
    size = F.abs(by)
    if both:
        s = F.when(at_start, F.col("start") - size).otherwise(F.col("end") - size + 1)
        return _with(df, s, s + 2 * size - 1)
    s = F.when(at_start, F.when(by > 0, F.col("start") - size).otherwise(F.col("start"))).otherwise(F.when(by > 0, F.col("end") + 1).otherwise(F.col("end") - size + 1))
    return _with(df, s, s + size - 1)


def promoters(df: DataFrame, upstream=2000, downstream=200) -> DataFrame:
    """From ``upstream`` positions before the start to ``downstream - 1`` behind it."""
    up, down = col(upstream), col(downstream)
    wrong = (up < 0) | (down < 0)
    return _with(df, fail_if(wrong, "negative extent", F.col("start") - up), F.col("start") + down - 1)


def terminators(df: DataFrame, upstream=2000, downstream=200) -> DataFrame:
    """The same around the end."""
    up, down = col(upstream), col(downstream)
    wrong = (up < 0) | (down < 0)
    return _with(df, fail_if(wrong, "negative extent", F.col("end") - up), F.col("end") + down - 1)


def reflect(df: DataFrame, bound_start, bound_end) -> DataFrame:
    """Mirror each range inside its bounds."""
    total = col(bound_start) + col(bound_end)
    return _with(df, total - F.col("end"), total - F.col("start"))


def restrict(df: DataFrame, low=None, high=None, *, keep_all: bool = False, drop_empty: bool = False) -> DataFrame:
    """Clip to [low, high].

    By default ranges that lie beyond the bounds go, but one that only touches a bound stays as an empty range there.
    ``keep_all``: those that lie beyond become empty ranges at the bound.  ``drop_empty``: no empty range stays.
    """
    s, e, low, high = F.col("start"), F.col("end"), col(low), col(high)
    out = df
    if not keep_all:
        near = F.coalesce(e >= low - 1, F.lit(True)) & F.coalesce(s <= high + 1, F.lit(True))
        out = out.filter(near)
    first = F.when(F.coalesce(e < low - 1, F.lit(False)), low).when(F.coalesce(s > high + 1, F.lit(False)), high + 1).otherwise(F.greatest(s, F.coalesce(low, s)))
    last = F.when(F.coalesce(e < low - 1, F.lit(False)), low - 1).when(F.coalesce(s > high + 1, F.lit(False)), high).otherwise(F.least(e, F.coalesce(high, e)))
    out = _with(out, first, last)
    return out.filter("end >= start") if drop_empty else out


def three_bands(df: DataFrame, start=None, end=None, width_=None) -> DataFrame:
    """Left, middle and right part of each range around a window in it, as three rows with column band."""
    s, e = solve_window(width(), start, end, width_)
    base = F.col("start")
    bands = F.array(
        F.struct(F.lit("left").alias("band"), base.alias("s"), (base + s - 2).alias("e")),
        F.struct(F.lit("middle").alias("band"), (base + s - 1).alias("s"), (base + e - 1).alias("e")),
        F.struct(F.lit("right").alias("band"), (base + e).alias("s"), F.col("end").alias("e")),
    )
    out = df.withColumn("_band", F.explode(bands))
    return _with(out, F.col("_band.s"), F.col("_band.e")).withColumn("band", F.col("_band.band")).drop("_band")


def zoom(df: DataFrame, by) -> DataFrame:
    """Divide the width by ``by`` around the middle (a negative factor multiplies)."""
    f = F.lit(by).cast("double") if isinstance(by, (int, float)) else by.cast("double")
    f = F.when(f < 0, 1 / F.abs(f)).otherwise(f)
    middle = (F.col("start") + F.col("end")) / 2
    size = width() / f
    s = F.ceil(middle - size / 2)
    return _with(df, s, s + F.floor(size) - 1)


def grow(df: DataFrame, by) -> DataFrame:
    """Move both ends outward by ``by`` (inward if negative); a negative width is an error."""
    by = col(by)
    return _with(df, fail_if(width() + 2 * by < 0, "negative width", F.col("start") - by), F.col("end") + by)


def reverse(df: DataFrame, low=None, high=None) -> DataFrame:
    """Mirror inside [low, high]; by default inside each space's hull."""
    if low is None or high is None:
        df = df.join(df.groupBy("space").agg(F.min("start").alias("_a"), F.max("end").alias("_b")), "space")
    given = {name: col(x) for name, x in (("_a", low), ("_b", high)) if x is not None}
    return _with(df.withColumns(given) if given else df, F.col("_a") + F.col("_b") - F.col("end"), F.col("_a") + F.col("_b") - F.col("start")).drop("_a", "_b")


def tile(df: DataFrame, *, n=None, size=None) -> DataFrame:
    """Cut each range into ``n`` tiles of about equal width, or into tiles of at most ``size``: a row per tile, column tile."""
    if (n is None) == (size is None):
        raise ValueError("give n or size")
    count = col(n) if n is not None else F.ceil(width() / col(size)).cast("long")
    count = fail_if((count < 0) | (width() < count), "more tiles than positions", count)
    out = df.withColumns({"_n": count, "_w": width()}).filter("_n > 0").withColumn("tile", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    edge = lambda i: F.floor(i * F.col("_w") / F.col("_n"))
    base = F.col("start")
    return _with(out, base + edge(F.col("tile") - 1), base + edge(F.col("tile")) - 1).drop("_n", "_w")


def sliding_windows(df: DataFrame, size: int, step: int = 1) -> DataFrame:
    """Windows of ``size`` that begin every ``step`` positions in each range, the last one cut at its end."""
    n = F.ceil(F.greatest(width() - size, F.lit(0)) / step).cast("long")
    out = df.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    s = F.col("start") + F.col("window") * step
    return _with(out, s, F.least(s + size - 1, F.col("end"))).withColumn("window", F.col("window") + 1)


def to_first_circle(df: DataFrame, length) -> DataFrame:
    """Move each range by whole circles so that it starts in [1, length]."""
    s = F.pmod(F.col("start") - 1, col(length)) + 1
    return _with(df, s, s + width() - 1)


def trim(df: DataFrame, length) -> DataFrame:
    """Views clipped to their subject [1, length]; all stay, those beyond it as empty ranges."""
    return restrict(df, F.lit(1).cast("long"), length, keep_all=True)


def subviews(df: DataFrame, length, start=None, end=None, width_=None) -> DataFrame:
    return narrow(trim(df, length), start, end, width_)

"""Views: ranges over a run-length vector, and summaries of what they see.

A subject is a run table (space, start, end, value) that begins at position 1 of each space; views are range frames.
Summaries come from what stands at a view's two ends and from sparse tables of extremes; only where every value is
wanted (:func:`seen` and what uses it) do views meet the runs that they see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.binning import Bins
from ..plans.extremes import between
from ..plans.sweep import running
from ..sources.scratch import kept
from .overlaps import merge

#: What an empty view's extremes are in the integer vocabulary (largest and least 32-bit numbers).
INT_TOP = 2147483647


def seen(views: DataFrame, runs: DataFrame, *, bins: Bins | None = None, whole: bool = False) -> DataFrame:
    """For each view and run that meet: space, rid, start and end of the part seen, value (and with ``whole`` the run's
    own ends, run_start and run_end)."""
    views, runs = kept(views.filter("end >= start").select("space", "rid", "start", "end"), "views"), kept(runs, "runs")
    out = merge(views, runs.select("space", F.col("start").alias("rid"), "start", "end", "value"), bins=bins)  # a run's value goes with it
    more = [F.col("s_start").alias("run_start"), F.col("s_end").alias("run_end")] if whole else []
    return out.select("space", F.col("q_rid").alias("rid"), F.greatest("s_start", "q_start").alias("start"), F.least("s_end", "q_end").alias("end"), F.col("s_value").alias("value"), *more)


#: What :func:`summarize` can tell of a view.
SUMMARIES = ("n", "view_min", "view_max", "view_sum", "view_mean", "which_min", "which_max")


def summarize(views: DataFrame, runs: DataFrame, *, na_rm: bool = False, parity: bool = False, columns: Sequence[str] = SUMMARIES, chunk: int | None = None) -> DataFrame:
    """Per view, with all its columns: n (positions seen), view_min, view_max, view_sum, view_mean, which_min, which_max (or
    those of them that ``columns`` names: the extremes are an effort of their own).

    Unless ``na_rm``, a null value in a view makes its summaries null, except the places of the extremes, which are
    then looked for before the first null.  An empty view has sum 0 and no mean; its extremes are null, or with
    ``parity`` the largest and least number.

    Views never meet the runs that they see: sums are differences of running sums at their ends, and extremes come from
    sparse tables.  Sums of floating-point values are as exact as the running sum over the whole space.
    """
    kind = dict(runs.dtypes)["value"]
    wide = "double" if kind in ("double", "float") else "long"
    deep = not {"n", "view_sum", "view_mean"}.issuperset(columns)
    runs = kept(runs, "runs")
    ends = _at_ends(views, runs, wide, chunk)
    if deep:
        ends = kept(ends, "ends")
    out = views.join(ends, ["space", "rid"], "left")
    count, nulls = F.coalesce("_n", F.lit(0)), F.coalesce("_nulls", F.lit(0))
    whole = F.lit(True) if na_rm else nulls == 0
    done = {"n": count, "view_sum": F.when(whole, F.coalesce("_sum", F.lit(0))).cast(wide), "view_mean": F.when(whole, F.col("_sum") / F.nullif(count - nulls, F.lit(0))).cast("double")}
    if deep:
        out = out.join(_extremes(views, ends, runs, na_rm), ["space", "rid"], "left")
        some = count > nulls
        empty_min, empty_max = (F.lit(INT_TOP), F.lit(-INT_TOP)) if parity else (F.lit(None), F.lit(None))
        as_kind = wide if parity else kind
        done["view_min"] = F.when(whole, F.when(some, F.col("_lo.value")).otherwise(empty_min)).cast(as_kind)
        done["view_max"] = F.when(whole, F.when(some, F.col("_hi.value")).otherwise(empty_max)).cast(as_kind)
        done |= {f"which_{name}": F.when(F.col(s).isNotNull(), F.greatest(F.col(f"{s}.start"), F.col("start"))) for name, s in (("min", "_lo"), ("max", "_hi"))}
    return out.select(*[F.col(c) for c in views.columns], *[done[c].alias(c) for c in columns])


def _at_ends(views: DataFrame, runs: DataFrame, wide: str, chunk: int | None) -> DataFrame:
    """Per view with positions (space, rid): _n, _nulls and _sum of what it sees, _stop (where the first null stands in it
    or behind it) and _own (the run in which it begins), by one sweep over the runs and the views' ends."""
    subject = runs.select("space", F.col("start").cast("long").alias("pos"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"), "value", F.lit(None).cast(dict(views.dtypes)["rid"]).alias("rid"))
    ask = lambda kind, at: F.struct(F.lit(kind).alias("_kind"), F.col(at).cast("long").alias("pos"))
    asks = views.filter("end >= start").select("space", "rid", F.explode(F.array(ask(1, "start"), ask(2, "end"))).alias("_a")).select("space", "_a.pos", "_a._kind", F.lit(None).cast("long").alias("_end"), F.lit(None).cast(dict(runs.dtypes)["value"]).alias("value"), "rid")
    rows = subject.unionByName(asks)
    is_run, value, size = F.col("_kind") == 0, F.col("value"), F.col("_end") - F.col("pos") + 1
    part = lambda x, otherwise=0: F.when(is_run & value.isNotNull(), x).otherwise(F.lit(otherwise))
    odd = wide == "double"
    plain = ~(F.isnan(value) | (F.abs(value) == float("inf"))) if odd else F.lit(True)
    sums = {"_s_n": F.when(is_run, size).otherwise(F.lit(0)), "_s_nulls": F.when(is_run & value.isNull(), size).otherwise(F.lit(0)), "_s_sum": part(F.when(plain, value * size).otherwise(F.lit(0).cast(wide)), 0).cast(wide)}
    if odd:  # what would spoil the running sum is counted instead
        sums |= {"_s_nan": part(F.when(F.isnan(value), size).otherwise(F.lit(0))), "_s_up": part(F.when(value == float("inf"), size).otherwise(F.lit(0))), "_s_down": part(F.when(value == float("-inf"), size).otherwise(F.lit(0)))}
    last = F.when(is_run, F.struct(F.col("pos").alias("start"), F.col("_end").alias("end"), "value"))
    null_at = F.when(is_run & value.isNull(), F.col("pos"))
    swept_rows = running(rows, {k: ("sum", v) for k, v in sums.items()} | {"_last": ("max", last), "_null": ("next", null_at)}, "pos", ["pos", "_kind"], chunk=chunk).filter("_kind > 0")
    # a run's part behind the place asked for (for a start: from it on) isn't before it
    over = F.greatest(F.col("_last.end") - F.col("pos") + F.when(F.col("_kind") == 1, 1).otherwise(0), F.lit(0))
    own, holds = F.col("_last.value"), F.col("_last.end") >= F.col("pos")
    good = F.when(own.isNotNull(), over).otherwise(F.lit(0))
    ordinary = ~(F.isnan(own) | (F.abs(own) == float("inf"))) if odd else F.lit(True)
    behind = {"_s_n": over, "_s_nulls": F.when(own.isNull(), over).otherwise(F.lit(0)), "_s_sum": F.when(own.isNotNull() & ordinary, own * over).otherwise(F.lit(0)).cast(wide)}
    if odd:
        behind |= {"_s_nan": F.when(F.isnan(own), good).otherwise(F.lit(0)), "_s_up": F.when(own == float("inf"), good).otherwise(F.lit(0)), "_s_down": F.when(own == float("-inf"), good).otherwise(F.lit(0))}
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    totals = {k: F.sum(sign * (F.col(k) - F.coalesce(behind[k], F.lit(0)))) for k in sums}
    at_start = F.col("_kind") == 1
    stop = F.min(F.when(at_start, F.when(holds & own.isNull(), F.col("pos")).otherwise(F.col("_null"))))
    begin = F.max(F.when(at_start & holds & own.isNotNull(), F.col("_last")))
    out = swept_rows.groupBy("space", "rid").agg(*[v.alias(k) for k, v in totals.items()], stop.alias("_stop"), begin.alias("_own"))
    total = F.col("_s_sum")
    if odd:
        nan = (F.col("_s_nan") > 0) | ((F.col("_s_up") > 0) & (F.col("_s_down") > 0))
        total = F.when(nan, float("nan")).when(F.col("_s_up") > 0, float("inf")).when(F.col("_s_down") > 0, float("-inf")).otherwise(total)
    return out.select("space", "rid", F.col("_s_n").alias("_n"), F.col("_s_nulls").alias("_nulls"), total.alias("_sum"), "_stop", "_own")


def _extremes(views: DataFrame, ends: DataFrame, runs: DataFrame, na_rm: bool) -> DataFrame:
    """Per view (space, rid) the runs of its least and largest value, _lo and _hi (value, start, end), the first of equal
    ones; unless ``na_rm`` those before its first null."""
    asked = views.filter("end >= start").select("space", "rid", "start", "end").join(ends.select("space", "rid", "_stop", "_own"), ["space", "rid"])
    high = F.col("end") if na_rm else F.least(F.col("end"), F.col("_stop") - 1)  # without a null behind the start, _stop is null
    found = between(runs, asked.select("space", "rid", (F.col("start") + 1).alias("low"), high.alias("high")))
    both = asked.select("space", "rid", "_own").join(found, ["space", "rid"], "left")
    # the run in which the view begins stands before all others, so it goes first among equals
    pick = lambda side, better: F.when(side.isNull() | better(F.col("_own.value"), side["value"]), F.col("_own")).otherwise(side)
    own = F.col("_own").isNotNull()
    return both.select(
        "space",
        "rid",
        *[F.when(own, pick(_as_run(s), f)).otherwise(_as_run(s)).alias(f"_{s}") for s, f in (("lo", lambda a, b: a <= b), ("hi", lambda a, b: a >= b))],
    )


def _as_run(side: str) -> Column:
    """An answer with its fields in the order of a run's."""
    return F.when(F.col(side).isNotNull(), F.struct(F.col(f"{side}.start").alias("start"), F.col(f"{side}.end").alias("end"), F.col(f"{side}.value").alias("value")))


def extreme_runs(views: DataFrame, runs: DataFrame, *, largest: bool = False, na_rm: bool = False, chunk: int | None = None) -> DataFrame:
    """Per view the run (start, end, value) in which its least (largest) value first stands, and the place (pos); a null
    in a view is an error unless ``na_rm``."""
    from ..model import fail_if

    kind = dict(runs.dtypes)["value"]
    runs = kept(runs, "runs")
    ends = kept(_at_ends(views, runs, "double" if kind in ("double", "float") else "long", chunk), "ends")
    side = "_hi" if largest else "_lo"
    told = views.select("space", "rid", F.col("start").alias("_from")).join(ends.select("space", "rid", "_nulls"), ["space", "rid"])
    pos = F.greatest(F.col(f"{side}.start"), F.col("_from"))
    if not na_rm:
        told = told.withColumn("_from", fail_if(F.col("_nulls") > 0, "a view holds a null", F.col("_from")))
    out = told.join(_extremes(views, ends, runs, na_rm), ["space", "rid"]).filter(F.col(side).isNotNull())
    return out.select("space", "rid", pos.alias("pos"), f"{side}.start", f"{side}.end", f"{side}.value")


def clipped(views: DataFrame, lengths: DataFrame) -> DataFrame:
    """Views clipped to [1, length] of their space (``lengths``: space, length)."""
    from ..functions.intra import trim

    return trim(views.join(lengths, "space"), F.col("length")).drop("length")


def apply(views: DataFrame, runs: DataFrame, function: Column, name: str = "result") -> DataFrame:
    """An aggregate expression over the values that each view sees (column value, a row per position)."""
    values = seen(views, runs).withColumn("pos", F.explode(F.sequence("start", "end")))
    return views.join(values.groupBy("space", "rid").agg(function.alias(name)), ["space", "rid"], "left")


def apply_python(views: DataFrame, runs: DataFrame, function, schema: str, *, together: bool = False) -> DataFrame:
    """A Python function from a pandas frame (space, rid, pos, value), one view at a time, to a frame of ``schema``.

    With ``together`` the function gets many whole views at once, one behind the other, and tells them apart itself: a
    call costs as much as some hundred rows, which views of a few positions don't bear.
    """
    tasks = int(views.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps small partitions apart: the function is the work
    values = unlisted(views, runs).repartition(tasks, "space", "rid").sortWithinPartitions("space", "rid", "pos")

    def run(frames):
        import pandas as pd

        rest, done = None, []
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["space", "rid"]]
            starts = [*(key != key.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()]
            if together and len(starts) > 1:
                yield function(frame.iloc[: starts[-1]])
                starts = starts[-1:]
            for a, b in zip(starts, starts[1:], strict=False):
                done.append(function(frame.iloc[a:b]))
                if len(done) == 1000:  # one batch for many views: each batch costs as much as some hundred rows
                    yield pd.concat(done, ignore_index=True)
                    done = []
            rest = frame.iloc[starts[-1] :] if starts else frame
        if rest is not None and len(rest):
            done.append(function(rest))
        if done:
            yield pd.concat(done, ignore_index=True)

    return values.mapInPandas(run, schema)


def unlisted(views: DataFrame, runs: DataFrame) -> DataFrame:
    """All values seen, view by view: space, rid, pos, value."""
    return seen(views, runs).withColumn("pos", F.explode(F.sequence("start", "end"))).select("space", "rid", "pos", "value")


def matrix(views: DataFrame, runs: DataFrame, columns: int, *, reverse: bool = False) -> DataFrame:
    """Per view its values as an array of ``columns`` elements, padded with nulls."""
    values = unlisted(views, runs).groupBy("space", "rid").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v"))
    row = F.transform("_v", lambda x: x["value"])
    row = F.reverse(row) if reverse else row
    padded = F.slice(F.concat(row, F.array_repeat(F.lit(None).cast(dict(runs.dtypes)["value"]), columns)), 1, columns)
    return views.join(values, ["space", "rid"], "left").withColumn("values", F.coalesce(padded, F.array_repeat(F.lit(None).cast(dict(runs.dtypes)["value"]), columns))).drop("_v")


def paired(views: DataFrame, subjects: DataFrame) -> DataFrame:
    """Views and subjects by space: both must have the same spaces, else an error."""
    a, b = views.select("space").distinct().withColumn("_v", F.lit(1)), subjects.select("space").distinct().withColumn("_s", F.lit(1))
    both = a.join(b, "space", "full_outer")
    wrong = F.col("_v").isNull() | F.col("_s").isNull()
    ok = both.select(F.when(wrong, F.raise_error(F.lit("views and subjects have different spaces")).cast(dict(views.dtypes)["space"])).otherwise(F.col("space")).alias("space"))
    return views.join(ok, "space")


def combined(*views: DataFrame) -> DataFrame:
    """Views one behind the other; each has a column ``subject`` that must be the same throughout, else an error."""
    from ..model import concat

    out = concat(*views)
    seen_ = out.groupBy("space").agg(F.min("subject").alias("_one"), F.max("subject").alias("_other"))
    wrong = F.col("_one") != F.col("_other")
    return out.join(seen_, "space").withColumn("subject", F.when(wrong, F.raise_error(F.lit("views on different subjects")).cast(dict(out.dtypes)["subject"])).otherwise(F.col("subject"))).drop("_one", "_other")

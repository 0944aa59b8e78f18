"""Ranks, orders, quantiles and rank correlation of vectors of any size, in long form: a row per element.

Equal values are counted first, so a value that very many elements have is one row, and a sweep along the different values
tells how many elements stand before each.  Nulls are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dominance import below
from ..plans.sweep import running

METHODS = ("average", "min", "max", "first", "dense")


def counted(df: DataFrame, value: str, *, by: Sequence[str] = ("space",), chunk: int | None = None) -> DataFrame:
    """The different values of each vector: by, value, n (how often), before (elements of lesser value), place (among the
    different values, from 1) and size (elements in all)."""
    each = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = running(each, {"_upto": ("sum", F.col("n")), "place": ("sum", F.lit(1).cast("long"))}, "value", ["value"], chunk=chunk, by=by, derived=True)
    sizes = each.groupBy(*by).agg(F.sum("n").alias("size"))
    return rows.join(sizes, list(by)).select(*by, "value", "n", (F.col("_upto") - F.col("n")).alias("before"), "place", "size")


def ranks(df: DataFrame, value: str, *, method: str = "average", order: str = "rid", by: Sequence[str] = ("space",), chunk: int | None = None) -> DataFrame:
    """``df`` with ``rank``, a double: each element's rank in its vector, from 1.

    Equal values share the average, least or largest of their ranks, or are ranked by ``order`` (first); dense counts the
    different values.  Nulls have none.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "first":
        among = running(df.filter(F.col(value).isNotNull()), {"_among": ("sum", F.lit(1).cast("long"))}, order, [order], chunk=chunk, by=(*by, value)).select(*by, order, "_among")
        df = df.join(among, [*by, order], "left")
    known = counted(df, value, by=by, chunk=chunk).select(*by, F.col("value").alias(value), "n", "before", "place")
    rank = {
        "average": F.col("before") + (F.col("n") + 1) / 2,
        "min": F.col("before") + 1,
        "max": F.col("before") + F.col("n"),
        "dense": F.col("place"),
        "first": F.col("before") + F.col("_among") if method == "first" else None,
    }[method]
    out = df.join(known, [*by, value], "left").withColumn("rank", rank.cast("double"))
    return out.select(*[c for c in df.columns if c != "_among"], "rank")


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], *, by: Sequence[str] = ("space",), chunk: int | None = None) -> DataFrame:
    """Per vector and probability: by, p, quantile, linear between the two elements next to it."""
    known = counted(df, value, by=by, chunk=chunk)
    at = (F.col("size") - 1) * F.col("p")
    both = known.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    both = both.withColumns({"_low": F.floor(at) + 1, "_high": F.ceil(at) + 1, "_part": at - F.floor(at)})
    holds = lambda place: (F.col("before") < F.col(place)) & (F.col(place) <= F.col("before") + F.col("n"))
    both = both.filter(holds("_low") | holds("_high"))
    ends = both.groupBy(*by, "p").agg(F.max(F.when(holds("_low"), F.col("value"))).cast("double").alias("_a"), F.max(F.when(holds("_high"), F.col("value"))).cast("double").alias("_b"), F.max("_part").alias("_part"))
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a")))
    return ends.select(*by, "p", exact.alias("quantile"))


def kendall(df: DataFrame, x: str, y: str, *, by: Sequence[str] = ("space",), chunk: int | None = None) -> DataFrame:
    """Per vector Kendall's rank correlation of two columns, ties taken into account: by, tau (null if either column is
    constant).  Rows with a null in either are left out.

    Pairs that agree are counted by dominance among the places of different values, never made.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    each = rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    placed = each
    for name, place in (("_x", "x"), ("_y", "y")):
        known = counted(rows, name, by=by, chunk=chunk).select(*by, F.col("value").alias(name), F.col("place").alias(place))
        placed = placed.join(known, [*by, name])
    points = placed.select(*by, "x", "y", F.col("_n").alias("value"))
    # an ask is a point: those below it in both agree with it, those below in x alone and above in y don't
    corner = lambda sign, dx, dy: F.struct(F.lit(sign).alias("sign"), (F.col("x") + dx).alias("ax"), (F.col("y") + dy).alias("ay"))
    asks = points.withColumn("_c", F.explode(F.array(corner(1, -1, -1), corner(2, -1, 0))))
    key = F.struct(*by, F.col("x").alias("px"), F.col("y").alias("py"), F.col("_c.sign").alias("sign"), F.col("value").alias("weight"))
    asks = asks.select(*by, key.alias("ask"), F.col("_c.ax").alias("x"), F.col("_c.ay").alias("y"))
    found = below(points, asks, "sum", by=by, chunk=chunk).select(*[F.col(f"ask.{k}").alias(k) for k in by], "ask.sign", "ask.weight", "value")
    # less in x and less in y; less in x and no more in y
    pairs = found.groupBy(*by).agg(F.sum(F.when(F.col("sign") == 1, F.col("weight") * F.col("value"))).alias("_agree"), F.sum(F.when(F.col("sign") == 2, F.col("weight") * F.col("value"))).alias("_upto"))
    tied = lambda name, out: rows.groupBy(*by, name).agg(F.count(F.lit(1)).alias("_k")).groupBy(*by).agg(F.sum(F.col("_k") * (F.col("_k") - 1) / 2).alias(out))
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    out = n.join(tied("_x", "_tx"), list(by)).join(tied("_y", "_ty"), list(by)).join(pairs, list(by), "left")
    all_ = F.col("_n") * (F.col("_n") - 1) / 2
    # pairs that differ in x: those below in x, at any y
    agree = F.coalesce("_agree", F.lit(0))
    tied_y = F.coalesce("_upto", F.lit(0)) - agree  # less in x, equal in y
    against = (all_ - F.col("_tx")) - agree - tied_y
    scale = F.sqrt((all_ - F.col("_tx")) * (all_ - F.col("_ty")))
    return out.select(*by, F.when(scale > 0, (agree - against) / scale).alias("tau"))

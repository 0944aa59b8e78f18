"""Dominance: for very many asks at once, what the points at or below them in two coordinates add up to.

Points are taken in the order of x, so an ask has to look only at those before it, and of these at the ones whose y isn't
above its own.  Ranks of y are cut into digits: the ranks below an ask's rank are those that agree with it in the leading
digits and have a smaller one next, for each digit in turn.  So each point and each ask is a row per digit, and at each
digit one sweep along x keeps a running value for every digit's bound.  Rows grow with points and asks and with the
logarithm of the spread of y; no pair is made, and a crowded place is a single point and a single ask.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .sweep import running

#: Bits of a digit, and its values.  A sweep keeps a running value less than a digit has values: with many of them its plan
#: and its code outgrow the driver, with few bits there are more rows.
BITS = 3
DIGITS = 1 << BITS


def below(points: DataFrame, asks: DataFrame, how: str, *, by: Sequence[str] = ("space",), chunk: int | None = None) -> DataFrame:
    """Per ask (by, ask, x, y) the sum, min or max of ``value`` over the points (by, x, y, value) with x and y at most its
    own: ask, value.  Asks that have no points are left out or, for a sum, have 0; each ask comes once."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    points = kept(points.groupBy(*by, "x", "y").agg(fold("value").alias("value")), "points")
    asks = kept(asks.select(*by, "ask", "x", "y"), "asks")
    places = kept(asks.select(*by, "x", "y").distinct(), "places")
    low, high = points.agg(F.min("y"), F.max("y")).first()
    if low is None:
        return asks.limit(0).select("ask", F.lit(None).cast(points.schema["value"].dataType).alias("value"))
    levels = max(1, -(-(high - low + 1).bit_length() // BITS))
    digit = lambda rank, k: F.struct(F.lit(k).alias("level"), F.shiftright(rank, BITS * (k + 1)).alias("parent"), F.shiftright(rank, BITS * k).bitwiseAND(DIGITS - 1).cast("int").alias("digit"))

    def dealt(df: DataFrame, rank, *more: str) -> DataFrame:
        out = df.withColumn("_rank", rank).withColumn("_digit", F.explode(F.array(*[digit(F.col("_rank"), k) for k in range(levels)])))
        return out.select(*by, "_digit.*", "x", *more)

    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    marks = dealt(points, F.col("y") - low, "value").filter(F.col("digit") < DIGITS - 1).select("*", none(places, "y"), F.lit(0).alias("kind"))
    # an ask's rank is the number of ranks that count
    bound = dealt(places.filter(F.col("y") >= low), F.least(F.col("y"), F.lit(high)) - low + 1, "y").filter(F.col("digit") > 0)
    rows = marks.unionByName(bound.select("*", none(points, "value"), F.lit(1).alias("kind")))
    own = -F.col("value") if how == "min" else F.col("value")
    values = {f"_below{d}": ("sum" if how == "sum" else "max", F.when((F.col("kind") == 0) & (F.col("digit") < d), own)) for d in range(1, DIGITS)}
    rows = running(rows, values, "x", ["x", "kind"], chunk=chunk, by=(*by, "level", "parent")).filter("kind = 1")
    seen = F.element_at(F.array(*[F.col(f"_below{d}") for d in range(1, DIGITS)]), F.col("digit"))
    found = rows.select(*by, "x", "y", (-seen if how == "min" else seen).alias("value")).filter("value is not null")
    found = found.groupBy(*by, "x", "y").agg(fold("value").alias("value"))
    return asks.join(found, [*by, "x", "y"]).select("ask", "value")

"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash that a re-run repeats.  A source takes all its documents ``repeats`` times and, once more,
those whose hash lies under the source's threshold.  The threshold is found without sorting: sizes are summed by
source and hash bucket, the bucket in which the budget ends is found from those sums, and only the rows of that bucket
are summed again by finer buckets.  Thresholds are nested: a larger budget takes what a smaller one takes, and more.

Defined results: null or empty texts have size 0 and are taken or left with the others; a null source is a source of
its own, after all others; rows that repeat id and text have equal hashes and are taken together; an empty table gives
an empty result; a table without words gives targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import c, cut, fresh, hinted, text_or_empty, word_count

BITS, LEVELS = 14, 3
SPAN = 1 << BITS * LEVELS
#: Up to so many sources the documents meet their sources' thresholds by broadcast, which leaves them where they are.
SOURCES = 100_000


def hash_position(id_col: str, text_col: str) -> Column:
    """A number in [0, 2^42) from id and text."""
    ident = F.coalesce(c(id_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(ident, F.lit(":"), F.md5(text_or_empty(text_col))))
    return F.shiftright(F.conv(F.substring(digest, 1, 11), 16, 10).cast("long"), 44 - BITS * LEVELS)


def source_key(source_col: str) -> Column:
    """A key without nulls: equal for equal sources, null included."""
    return F.coalesce(F.concat(F.lit("s"), c(source_col).cast("string")), F.lit("n"))


def targets(totals: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """Share all sizes among the sources by weight; none gets more than ``max_repeats`` times its own size.

    ``totals`` has a row per source: key, source_size.  What a full source can't use goes to the others by weight
    until none is above its limit.  The level at which that ends is found in one pass over the sources in the order
    in which they fill up.
    """
    by_name = Window.orderBy((F.col("key") == "n"), "key")
    fill = Window.orderBy("ratio", "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    w = F.array(*[F.lit(float(x)) for x in weights])
    shares = (
        totals.withColumn("weight", F.get(w, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("limit", F.col("source_size") * float(max_repeats))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everyone).cast("double"))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.greatest(F.col("left"), F.lit(0.0)) / F.col("open"))
    )
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everyone)
    return shares.withColumn("level", F.coalesce(level, F.lit(float("inf")))).select(
        "key", "source_size", F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target")
    )


def thresholds(slim: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Per source: key, source_size, target, repeats, threshold.  ``slim`` has key, size, position."""
    totals = slim.groupBy("key").agg(F.sum("size").alias("source_size"))
    goal = cut(
        targets(totals, weights, max_repeats)
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    )
    edge = goal.filter("rest > 0").select("key", F.lit(0).cast("long").alias("bucket"), "rest")
    for level in range(LEVELS):
        here, above = BITS * (LEVELS - 1 - level), BITS * (LEVELS - level)
        inside = slim.withColumn("bucket", F.shiftright("position", above)).join(hinted(edge, SOURCES), ["key", "bucket"])
        sums = inside.groupBy("key", F.shiftright("position", here).alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        w = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        edge = cut(
            sums.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))).select(
                "key", "bucket", (F.col("rest") - F.col("before")).alias("rest"), "n"
            )
        )
    last = edge.select("key", (F.col("bucket") + (F.col("rest") * 2 > F.col("n")).cast("long")).alias("edge"))
    threshold = F.coalesce("edge", F.when(F.col("rest") > 0, F.lit(SPAN)).otherwise(F.lit(0)))
    out = goal.join(last, "key", "left").select("key", "source_size", "target", "repeats", threshold.cast("long").alias("threshold"))
    return hinted(cut(out), SOURCES)


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The slim table from which thresholds are found: id, key, size, position."""
    return df.select(
        c(id_col).alias("id"),
        source_key(source_col).alias("key"),
        word_count(c(text_col)).alias("size"),
        hash_position(id_col, text_col).alias("position"),
    )


def copies() -> Column:
    return F.col("repeats") + (F.col("position") < F.col("threshold")).cast("long")


def mix_report(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3
) -> DataFrame:
    """Per document: id, size, source_size, target (its source's) and taken (words the mix takes of it)."""
    slim = cut(measured(df, id_col, text_col, source_col))
    cuts = thresholds(slim, weights, max_repeats)
    return slim.join(cuts, "key").select("id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3
) -> DataFrame:
    """The mixed corpus: the rows of ``df`` with all their columns, each as often as the mix takes it."""
    cuts = thresholds(cut(measured(df, id_col, text_col, source_col)), weights, max_repeats)
    key, position, repeats, threshold, times = fresh(df, "key", "position", "repeats", "threshold", "times")
    cuts = cuts.select(F.col("key").alias(key), F.col("repeats").alias(repeats), F.col("threshold").alias(threshold))  # a broadcast hint stays
    return (
        df.withColumn(key, source_key(source_col))
        .withColumn(position, hash_position(id_col, text_col))
        .join(cuts, key)
        .withColumn(times, (F.col(repeats) + (F.col(position) < F.col(threshold)).cast("long")).cast("int"))
        .withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times))))
        .select(*[c(x) for x in df.columns])
    )

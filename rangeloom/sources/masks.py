"""Readers of five text formats of masked regions, each to ranges (seqname, start, end) and to a mask.

Files are read by Spark's text and CSV readers with given schemas.  Coordinates come out closed and 1-based.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.algebra import gaps as _gaps
from ..operators.algebra import reduce
from ..operators.masks import MASKS, Masks, empty


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold something and aren't comments, split at white space."""
    text = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return text.select(F.split(F.trim("value"), r"\s+").alias("f"))


def _int(i: int):
    return F.get("f", F.lit(i)).try_cast("long") if hasattr(F.col("f"), "try_cast") else F.get("f", F.lit(i)).cast("long")


def _str(i: int):
    return F.get("f", F.lit(i))


def agp(spark: SparkSession, path: str) -> DataFrame:
    """Gaps (part type N) of an AGP file: seqname, start, end, gap_type.  An end that disagrees with the length is an error."""
    rows = _lines(spark, path).filter(_str(4) == "N").select(_str(0).alias("seqname"), _int(1).alias("start"), _int(2).alias("stop"), _int(5).alias("length"), _str(6).alias("gap_type"))
    wrong = F.col("start") + F.col("length") - 1 != F.col("stop")
    return rows.select("seqname", F.when(wrong, F.raise_error(F.lit("start, end and length disagree")).cast("long")).otherwise(F.col("start")).alias("start"), F.col("stop").alias("end"), "gap_type")


def ucsc_gap(spark: SparkSession, path: str) -> DataFrame:
    """A table of gaps with eight columns, or nine whose first is a bin; starts are 0-based."""
    rows = _lines(spark, path)
    k = F.when(F.size("f") >= 9, 1).otherwise(0)
    at = lambda i: F.get("f", k + i)
    rows = rows.select(at(0).alias("seqname"), (at(1).cast("long") + 1).alias("start"), at(2).cast("long").alias("end"), at(5).cast("long").alias("length"), at(6).alias("gap_type"))
    wrong = F.col("end") - F.col("start") + 1 != F.col("length")
    return rows.select("seqname", F.when(wrong, F.raise_error(F.lit("start, end and length disagree")).cast("long")).otherwise(F.col("start")).alias("start"), "end", "gap_type")


def lift_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a lift file: seqname, start, end, contig, seqlen (offsets are 0-based)."""
    return _lines(spark, path).select(_str(3).alias("seqname"), (_int(0) + 1).alias("start"), (_int(0) + _int(2)).alias("end"), _str(1).alias("contig"), _int(4).alias("seqlen"))


def lift(spark: SparkSession, path: str) -> DataFrame:
    """What the contigs of a lift file leave uncovered in their sequences; a sequence with two lengths is an error."""
    contigs = lift_contigs(spark, path)
    lengths = contigs.groupBy("seqname").agg(F.min("seqlen").alias("seqlen"), F.max("seqlen").alias("_m"))
    wrong = F.col("seqlen") != F.col("_m")
    lengths = lengths.select("seqname", F.when(wrong, F.raise_error(F.lit("a sequence has two lengths")).cast("long")).otherwise(F.col("seqlen")).alias("seqlen"))
    own = contigs.select(F.col("seqname").alias("space"), F.monotonically_increasing_id().alias("rid"), "start", "end")
    inner = _gaps(own, 1, None)
    tails = own.groupBy("space").agg(F.max("end").alias("_top")).join(lengths.withColumnRenamed("seqname", "space"), "space")
    tails = tails.select("space", (F.col("_top") + 1).alias("start"), F.col("seqlen").alias("end")).filter("end >= start")
    return inner.select("space", "start", "end").unionByName(tails).withColumnRenamed("space", "seqname")


def repeat_masker(spark: SparkSession, path: str) -> DataFrame:
    """Repeats of a RepeatMasker table: seqname, start, end, id.  Header lines have no number in their first field."""
    rows = _lines(spark, path).filter(_str(0).rlike(r"^\d+$"))
    return rows.select(_str(4).alias("seqname"), _int(5).alias("start"), _int(6).alias("end"), _str(14).alias("id"))


def tandem_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Tandem repeats in a table like BED: starts are 0-based."""
    return _lines(spark, path).select(_str(0).alias("seqname"), (_int(1) + 1).alias("start"), _int(2).alias("end"))


READERS = {"agp": agp, "gap": ucsc_gap, "lift": lift, "rm": repeat_masker, "trf": tandem_repeats}


def seqnames(spark: SparkSession, path: str, format: str) -> DataFrame:
    """The sequences that a file names."""
    rows = lift_contigs(spark, path) if format == "lift" else READERS[format](spark, path)
    return rows.select("seqname").distinct()


def read_mask(spark: SparkSession, path: str, format: str, *, seqname: str, width: int | None = None, gap_types: list[str] | None = None) -> Masks:
    """The mask of one sequence.  ``seqname`` "?" is an error that lists the names; a sequence without rows gives an
    empty mask, with a warning, if its width is known, and an error otherwise."""
    if seqname == "?":
        raise ValueError("the file has these sequences: " + ", ".join(sorted(r[0] for r in seqnames(spark, path, format).limit(10_000).collect())))
    rows = READERS[format](spark, path).filter(F.col("seqname") == seqname)
    if gap_types is not None:
        rows = rows.filter(F.col("gap_type").isin(gap_types))
    if format == "lift" and width is None:
        width = lift_contigs(spark, path).filter(F.col("seqname") == seqname).agg(F.max("seqlen")).first()[0]
    if not rows.limit(1).count():
        warnings.warn(f"no rows for {seqname}", stacklevel=2)
        return empty(spark, width, name=format)
    if width is None:
        width = rows.agg(F.max("end")).first()[0]
    one = reduce(rows.select(F.lit(1).cast("long").alias("space"), F.monotonically_increasing_id().alias("rid"), "start", "end"), drop_empty=True)
    return Masks(spark.createDataFrame([(1, format, None, True, width)], MASKS), one.select(F.col("space").alias("mask_id"), "start", "end"))

"""Range frames made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sweep import running
from .scratch import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ranges of days, some of them empty, in eight spaces."""
    o = table(spark, sf_dir, "orders")
    start = day("o_orderdate")
    return o.select((F.col("o_custkey") % 8).cast("long").alias("space"), F.col("o_orderkey").cast("long").alias("rid"), start.alias("start"), (start + F.col("o_orderkey") % 30 - 1).cast("long").alias("end"))


def line_ranges(spark: SparkSession, sf_dir: str, space: Column | None = None) -> DataFrame:
    """Order lines as ranges of days; rows are numbered in the order of five columns."""
    lines = table(spark, sf_dir, "lineitem")
    start = day("l_shipdate")
    lines = running(lines, {"_rid": ("sum", F.lit(1).cast("long"))}, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], by=())
    numbered = lines.select(
        ((F.col("l_suppkey") % 8).cast("long") if space is None else space).alias("space"), F.col("_rid").alias("rid"), start.alias("start"), (start + F.col("l_quantity").cast("int") - 1).cast("long").alias("end"), F.col("l_quantity").cast("long").alias("weight")
    )
    return kept(numbered, "lines")  # numbering is a sweep of its own, below all sweeps that use it


def customer_ranges(spark: SparkSession, sf_dir: str, fold: int | None = None) -> DataFrame:
    """Orders as ranges of days, a space per customer (or per remainder of its number): short lists with gaps."""
    o = table(spark, sf_dir, "orders")
    start, key = day("o_orderdate"), F.col("o_custkey").cast("long")
    return o.select((key % fold if fold else key).alias("space"), F.col("o_orderkey").cast("long").alias("rid"), start.alias("start"), (start + F.col("o_orderkey") % 30 - 1).cast("long").alias("end"))


def part_ranges(spark: SparkSession, sf_dir: str, fold: int) -> DataFrame:
    """Order lines as ranges of days, a space per remainder of the part's number; numbered like :func:`line_ranges`."""
    return line_ranges(spark, sf_dir, (F.col("l_partkey") % fold).cast("long")).select("space", "rid", "start", "end")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as single seconds, a space per user."""
    e = table(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("long").alias("space"), F.col("event_id").cast("long").alias("rid"), at.alias("start"), at.alias("end"))


def quantity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier its sorted quantities as a list of whole numbers."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").cast("long").alias("key")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("values"))


#: The same frames as SQL.
SQL = {
    "order_ranges": "SELECT CAST(o_custkey % 8 AS BIGINT) AS space, CAST(o_orderkey AS BIGINT) AS rid, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS start, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CAST(o_orderkey % 30 AS BIGINT) - 1 AS \"end\" FROM orders",
    "line_ranges": "SELECT CAST(l_suppkey % 8 AS BIGINT) AS space, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rid, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) - 1 AS \"end\", CAST(l_quantity AS BIGINT) AS weight FROM lineitem",
    "customer_ranges": "SELECT CAST(o_custkey AS BIGINT) AS space, CAST(o_orderkey AS BIGINT) AS rid, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS start, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CAST(o_orderkey % 30 AS BIGINT) - 1 AS \"end\" FROM orders",
    "part_ranges": "SELECT CAST(l_partkey AS BIGINT) AS space, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rid, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) - 1 AS \"end\", CAST(l_quantity AS BIGINT) AS weight FROM lineitem",
    "event_points": "SELECT CAST(user_id AS BIGINT) AS space, CAST(event_id AS BIGINT) AS rid, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) AS \"end\" FROM events",
    "quantity_lists": "SELECT CAST(l_suppkey AS BIGINT) AS key, list(CAST(l_quantity AS BIGINT) ORDER BY CAST(l_quantity AS BIGINT)) AS vals FROM lineitem GROUP BY 1",
}

"""Streaming forms of two operators: sliding windows over time, and merging with a gap as session windows.

Both take a streaming (or batch) frame with a timestamp column; watermarks bound the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding(df: DataFrame, at: str, size: str, step: str, *, late: str, by: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates over windows of ``size`` that begin every ``step``."""
    out = df.withWatermark(at, late).groupBy(*by, F.window(at, size, step)).agg(*[e.alias(k) for k, e in aggregates.items()])
    return out.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *aggregates)


def merged(df: DataFrame, at: str, gap: str, *, late: str, by: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Events merged while less than ``gap`` apart: what ``reduce`` with a minimal gap does to ranges."""
    out = df.withWatermark(at, late).groupBy(*by, F.session_window(at, gap)).agg(*[e.alias(k) for k, e in aggregates.items()])
    return out.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *aggregates)

"""Plumbing shared by the corpus operators: cut lineage, shared folders, free column names, text measures."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..sources.scratch import path as new_path
from ..sources.scratch import shared_root

#: White space of every contract here: the six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and drop its lineage (for slim tables)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into Parquet in the shared folder (for wide tables: compressed, columns prunable)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` (already cut) with a broadcast hint if it is found to have at most ``most_rows`` rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shape(**kinds: DataType | str) -> StructType:
    """A schema by field, for rows that Python returns: types as they are, whatever the names in a struct, or by name."""
    out = StructType()
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        free = f"_{name}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out.append(free)
    return out


def aside(names: list[str], *added: str) -> list[str]:
    """``names`` with underscores before those that a result adds itself, until all are different (without case)."""
    taken = {x.lower() for x in (*names, *added)}
    out = []
    for name in names:
        new = name
        if name.lower() in {x.lower() for x in added}:
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
        out.append(new)
    return out


def c(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(c(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold a few MB where the session has Spark's defaults: rows here carry whole texts, and the JVM
    keeps the largest batch's memory outside its heap for good."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


#: Called when a task ends: what a module keeps between batches only to be fast.
at_task_end: list[Callable[[], None]] = []


def _give_back() -> None:
    """Return memory that the task no longer needs: Python workers live on and share the executor's limit."""
    for clear in at_task_end:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that gives its memory back when its task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a slice holds about ``most_bytes`` of the given text column (one row at least)."""
    col = batch.column(column)
    n = len(col)
    if n == 0:
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype("i8")
    part = np.cumsum(sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)

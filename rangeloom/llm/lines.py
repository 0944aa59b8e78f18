"""Line dedup: drop the lines whose normalised form many documents hold.

Lines are normalised and hashed, each distinct hash of a document counts once, hashes of too many documents are
dropped, and the others are put together again in their places.  Hashing and rewriting are byte work in Arrow batches;
counting is a Spark aggregation with partial sums on the map side, so a line that is in every document costs one row a
task.

Defined results: a null or empty text is one empty line; rows of the table are documents, so repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, c, cut, fresh, shape, slices, text_or_empty, tidied

BLANKS = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                row, found = [], []
                for i, text in enumerate(batch.column(0)):
                    keys = {key_of(x) for x in text.as_buffer().to_pybytes().split(b"\n")}
                    kept = [digest(k) for k in keys if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)]
                    found += kept
                    row += [i] * len(kept)
                rest = [batch.column(j).take(pa.array(row, pa.int32())) for j in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *rest], ["hash", *batch.schema.names[1:]])

    return tidied(run)


def _rewrite(text: bytes, common) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if digest(key_of(x)) not in common]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _emit(batch: pa.RecordBatch, done: list[tuple[bytes, int, int]], extra: list[str]) -> pa.RecordBatch:
    n = len(extra)
    cols = [batch.column(j) for j in range(batch.num_columns - n, batch.num_columns)]
    return pa.RecordBatch.from_arrays(
        [*cols, pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
        [*extra, "kept", "n_lines", "n_dropped"],
    )


def _with_set(held, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for whole in batches:
            for batch in slices(whole, 0):
                yield _emit(batch, [_rewrite(x.as_buffer().to_pybytes(), common) for x in batch.column(0)], extra)

    return tidied(run)


def _with_lists(extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                yield _emit(batch, [_rewrite(x.as_buffer().to_pybytes(), set(y.as_py() or ())) for x, y in zip(batch.column(0), batch.column(1), strict=True)], extra)

    return tidied(run)


def common_lines(df: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The hashes of the lines that at least ``min_docs`` documents hold: hash, n_docs."""
    bounded_batches(df.sparkSession)
    lines = df.select(F.encode(text_or_empty(text_col), "UTF-8").alias("text")).mapInArrow(_hashes(min_chars), "hash binary")
    return lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_limit: int = 250_000
) -> DataFrame:
    """Per document: id, kept (UTF-8 bytes of the text that stays), n_lines (before) and n_dropped.

    Up to ``broadcast_limit`` common lines (16 bytes each) go to every executor and each document is rewritten where
    it is read.  Beyond, the common lines are joined to the documents' hashes and each document gets its own list.
    """
    spark = df.sparkSession
    common = cut(common_lines(df, text_col=text_col, min_docs=min_docs, min_chars=min_chars).select("hash"))
    body = F.encode(text_or_empty(text_col), "UTF-8")
    out = shape(id=df.schema[id_col].dataType, kept="binary", n_lines="long", n_dropped="long")
    if common.limit(broadcast_limit + 1).count() <= broadcast_limit:
        held = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in common.collect()))
        return df.select(body.alias("text"), c(id_col).alias("id")).mapInArrow(_with_set(held, ["id"]), out)
    same = F.md5(F.concat(F.coalesce(c(id_col).cast("string"), F.lit("\0")), F.lit(":"), body))
    docs = df.select(body.alias("text"), same.alias("same"), c(id_col).alias("id"))
    theirs = docs.dropDuplicates(["same"]).select("text", "same").mapInArrow(_hashes(min_chars), "hash binary, same string")
    lists = theirs.join(common, "hash").groupBy("same").agg(F.collect_list("hash").alias("common"))
    return docs.join(lists, "same", "left").select("text", "common", "id").mapInArrow(_with_lists(["id"]), out)


def without_common_lines(df: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``df`` with all its columns, the text without its common lines."""
    (ident,) = fresh(df, "columns")
    packed = df.select(F.struct(*[c(x) for x in df.columns]).alias(ident), c(text_col).alias("text"))
    done = dedup_lines(packed, id_col=ident, text_col="text", min_docs=min_docs, min_chars=min_chars)
    return done.select(*[F.decode("kept", "UTF-8").alias(x) if x == text_col else F.col("id").getField(x).alias(x) for x in df.columns])

"""Sharding by sampled splitters.

Records are ordered by a key made of their text's hash, so equal texts stand together.  A sample of keys, weighted by
size, gives quantile boundaries; the records are dealt to the ranges between them and every range is measured exactly.
Ranges that hold too much are sampled again, more densely, and subdivided.  Texts that are so frequent that one range
can't hold them are ordered by id inside and cut into ranges of their own, which begin and end with the text.

Shards are made of ranges, the largest first, each for the shard that has least.  All records of a text go to one shard;
only a text with more bytes than a shard's even part is spread over several, as no shard can hold it.

Defined results: a null or empty text has no bytes and size 1; records that repeat id and text are separate records but
stand in one range; an empty table gives an empty result.  A single record is never split, however long.  Columns of the
input called shard or slot keep their place under a free name: underscores are put before them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, c, cut, text_or_empty

LAW = "bytes"
#: Low bits of a key, which a frequent text's records differ in.
TEXT_BITS = 23


def _order_key(heavy: Column) -> Column:
    """40 bits of the text's hash, then, for frequent texts, 23 bits of the record's."""
    high = F.shiftleft(F.shiftright("group", 24), TEXT_BITS)
    return high.bitwiseOR(F.when(heavy, F.shiftrightunsigned("record", 41)).otherwise(F.lit(0)))


def _range_of(splitters):
    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters.value, keys.to_numpy(), side="right").astype("i4"))

    return find


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Boundaries that cut the sample into ``parts`` parts of about equal weight; a boundary starts a range."""
    order = np.argsort(keys, kind="stable")
    keys, cum = keys[order], np.cumsum(weights[order])
    if not len(keys) or parts < 2:
        return keys[:0]
    at = np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def _sample(rows: DataFrame, step: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of a sample: a record comes in with probability weight / step; a re-run draws the same."""
    draw = F.pmod(F.xxhash64("record", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    got = rows.filter(draw < F.col("weight") / step).select("key", "weight").toPandas()
    return got["key"].to_numpy("i8"), np.maximum(got["weight"].to_numpy("f8"), step)


def _measured(df: DataFrame, id_col: str, text_col: str, keep: Column) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(
        keep.alias("row"),
        c(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.xxhash64(c(id_col), text).alias("record"),
    )


def _assign(stats: pd.DataFrame, frequent: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each range: the largest first, each to the shard that has least so far.  The ranges of a frequent text
    go together, unless it has more than a shard's even part."""
    size = stats["size"].to_numpy("i8")
    text = stats["low"].to_numpy("i8") >> TEXT_BITS
    whole = np.where(np.isin(text, frequent), text, -1)
    sums = pd.Series(size).groupby(whole).sum()
    fits = sums.index.to_numpy()[(sums.to_numpy() <= max(size.sum() / shards, 1)) & (sums.index.to_numpy() != -1)]
    unit = np.where(np.isin(whole, fits), whole, -2 - np.arange(len(stats)))
    units = pd.DataFrame({"unit": unit, "size": size}).groupby("unit", sort=True)["size"].sum().sort_values(ascending=False, kind="stable")
    heap = [(0, k) for k in range(shards)]
    chosen = {}
    for name, n in units.items():
        load, k = heapq.heappop(heap)
        chosen[name] = k
        heapq.heappush(heap, (load + int(n), k))
    return np.array([chosen[u] for u in unit.tolist()], "i8")


def place(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    ranges_per_shard: int = 128,
    range_bytes: int = 512 << 20,
    sample_per_range: int = 16,
    rounds: int = 4,
    whole: bool = False,
) -> DataFrame:
    """Per record: id, size, text_crc32, shard, slot, and with ``whole`` the record itself (a struct, row).

    There are ``ranges_per_shard`` ranges for each shard, or more if one would have more than about ``range_bytes``.  The
    driver gets a row per range and about ``sample_per_range`` keys for each: at 100 TB some 200,000 and three million.
    A record's weight is its part of all bytes plus its part of all rows, so that no range has too many bytes or too
    many rows.  All of that is done on a slim table; the records themselves move once, to be numbered inside their
    ranges.
    """
    spark = df.sparkSession
    slim = cut(_measured(df, id_col, text_col, F.lit(0)))
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(shards * ranges_per_shard, -(-total // range_bytes))
    most = 2.0 / parts
    weight = F.col("size") / float(max(total, 1)) + F.lit(1.0 / max(n, 1))
    # fewer than ``parts`` texts can weigh over ``most`` of 2 in all
    heavy = cut(slim.groupBy("group").agg(F.sum(weight).alias("w")).filter(F.col("w") > most).select("group", "w", F.lit(True).alias("heavy")))
    key = lambda rows: rows.join(F.broadcast(heavy.drop("w")), "group", "left").withColumn("key", _order_key(F.coalesce("heavy", F.lit(False)))).drop("heavy", "group")
    keyed = cut(key(slim.withColumn("weight", weight)))
    # a frequent text has ranges of its own, cut evenly by its records' hashes
    often = heavy.select(F.shiftright("group", 24).alias("text"), "w").toPandas().groupby("text")["w"].sum()
    frequent = often.index.to_numpy("i8")
    inner = [(t << TEXT_BITS) + (np.arange(k + 1) << TEXT_BITS) // k for t, k in zip(frequent.tolist(), np.ceil(often.to_numpy() / most).astype("i8").tolist(), strict=True)]
    splitters = np.unique(np.concatenate([_quantiles(*_sample(keyed, 2.0 / (parts * sample_per_range), 0), parts), *inner]).astype("i8"))
    for salt in range(1, rounds + 1):
        find = _range_of(spark.sparkContext.broadcast(splitters))
        ranged = keyed.withColumn("range", find("key"))
        stats = ranged.groupBy("range").agg(F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values("range", ignore_index=True)
        over = stats[(stats["weight"] > 2 * most) & (stats["low"] < stats["high"])]
        if over.empty or salt == rounds:
            break
        todo = spark.createDataFrame([(int(r),) for r in over["range"]], "range int")
        keys, weights = _sample(ranged.join(F.broadcast(todo), "range", "left_semi"), most / (sample_per_range * 4), salt)
        spots = np.searchsorted(splitters, keys, side="right")
        more = [_quantiles(keys[spots == r.range], weights[spots == r.range], int(np.ceil(r.weight / most))) for r in over.itertuples()]
        splitters = np.unique(np.concatenate([splitters, *more, over["low"].to_numpy("i8")]))
    stats["shard"] = _assign(stats, frequent, shards)
    stats["offset"] = stats.groupby("shard")["n"].cumsum() - stats["n"]
    rows = [(int(r.range), int(r.shard), int(r.offset)) for r in stats.itertuples()]
    where = spark.createDataFrame(rows, "range int, shard int, offset long")
    if whole:
        records = key(_measured(df, id_col, text_col, F.struct(*[c(x) for x in df.columns])))
        ranged = records.withColumn("range", find("key"))
    inside = Window.partitionBy("range").orderBy("key", F.col("id").asc_nulls_first(), "record")
    placed = ranged.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(where), "range")
    return placed.select(*["row"] * whole, "id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).alias("slot"))


def shard(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, **options) -> DataFrame:
    """``df`` with all its columns and, behind them, shard and slot."""
    placed = place(df, id_col=id_col, text_col=text_col, shards=shards, whole=True, **options)
    return placed.select(*[F.col("row").getField(x).alias(new) for x, new in zip(df.columns, aside(df.columns, "shard", "slot"), strict=True)], "shard", "slot")

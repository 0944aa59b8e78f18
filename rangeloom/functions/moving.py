"""Moving values over vectors of any length, in long form: a row per element, many tasks to a vector.

Elements are counted along their order and cut into pieces; each piece also gets the ``k - 1`` elements behind it, which is
all that its windows need.  Order statistics keep one sorted list of ranks that an element enters and another leaves.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sweep import ROWS, running
from . import lists


def _sums(values: np.ndarray, known: np.ndarray, k: int, how: str, weights: Sequence[float] | None, na_rm: bool) -> np.ndarray:
    """Moving sums, means or weighted sums; NaN stands for null where ``known`` of the result says so (second row)."""
    view = np.lib.stride_tricks.sliding_window_view
    plain = np.where(known, values, 0.0)
    held = view(known, k).sum(axis=1)
    if how == "wtsum":
        out = np.concatenate([view(plain, k)[a : a + 4096] @ np.asarray(weights, "f8") for a in range(0, len(plain) - k + 1, 4096)])
        return np.stack([out, held == k])
    out = view(plain, k).sum(axis=1)
    good = np.full(len(out), True) if na_rm else held == k
    if how == "mean":
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / (held if na_rm else k)
        good = good & (held > 0)
    return np.stack([out, good])


def _orders(values: np.ndarray, known: np.ndarray, k: int, nth: int | None, na_rm: bool) -> np.ndarray:
    """Moving n-th smallest values (nulls last) or, without ``nth``, medians."""
    n = len(values)
    order = np.lexsort((values, np.isnan(values), ~known))
    rank = np.empty(n, "i8")
    rank[order] = np.arange(n)
    ranks, some = rank.tolist(), int(known.sum())
    window: list[int] = sorted(ranks[:k])
    out, good = np.zeros(n - k + 1), np.full(n - k + 1, False)
    for i in range(n - k + 1):
        if i:
            del window[bisect.bisect_left(window, ranks[i - 1])]
            bisect.insort(window, ranks[i + k - 1])
        if nth is not None:
            at = window[nth - 1] if nth <= k else some
            if at < some:
                out[i], good[i] = values[order[at]], True
            continue
        held = bisect.bisect_left(window, some)
        if held and (na_rm or held == k):
            low, high = values[order[window[(held - 1) // 2]]], values[order[window[held // 2]]]
            out[i], good[i] = (low if low == high else (low + high) / 2), True
    return np.stack([out, good])


def moving(
    df: DataFrame, k: int, how: str, *, value: str = "value", order: str = "rid", by: Sequence[str] = ("space",), weights: Sequence[float] | None = None, nth: int | None = None, rule: str = "drop", na_rm: bool = False, size: int = ROWS, chunk: int | None = None
) -> DataFrame:
    """Moving sum, mean, wtsum, q (the ``nth`` smallest) or median over ``k`` elements: by, place (from 1), result.

    The same values as :func:`lists.running` gives for a list.  ``rule`` drop has a result for each whole window, constant
    repeats the first and the last for the elements at the ends.  Vectors of fewer than ``k`` elements have none.
    """
    if how not in ("sum", "mean", "wtsum", "q", "median") or rule not in ("drop", "constant"):
        raise ValueError("unknown kind of moving value or rule")
    if k < 1 or (how == "wtsum" and len(weights or ()) != k) or (how == "q" and not nth):
        raise ValueError("k must be positive, and weights as many as k")
    placed = _placed(df.select(*by, order, F.col(value).cast("double").alias("_v")), order, by, chunk)
    size = max(size, k)
    first, last = F.greatest(F.floor((F.col("_place") - k) / size), F.lit(0)), F.floor((F.col("_place") - 1) / size)
    pieces = placed.filter(F.col("_n") >= k).withColumn("_piece", F.explode(F.sequence(first, last)))

    def windows(frame):
        import pandas as pd

        frame = frame.sort_values("_place")
        if len(frame) < k:
            return pd.DataFrame({c: [] for c in (*by, "_place", "_n", "result")})
        known = frame["_known"].to_numpy(bool)
        values = frame["_v"].to_numpy("f8", na_value=np.nan)
        result, good = _sums(values, known, k, how, weights, na_rm) if how in ("sum", "mean", "wtsum") else _orders(values, known, k, nth, na_rm)
        rows = frame.iloc[: len(result)]
        out = rows[[*by, "_place", "_n"]].assign(result=pd.array(result, "Float64"))
        out.loc[~good.astype(bool), "result"] = pd.NA
        # the last piece's windows only up to its own elements
        return out[(out["_place"] - 1) // size == frame["_piece"].iloc[0]]

    shape = df.select(*by).schema.add("_place", "long").add("_n", "long").add("result", "double")
    pieces = pieces.select(*by, "_place", "_n", "_piece", "_v", F.col("_v").isNotNull().alias("_known"))
    out = pieces.groupBy(*by, "_piece").applyInPandas(windows, shape)
    if rule == "drop":
        return out.select(*by, F.col("_place").alias("place"), "result")
    side = (k - 1) // 2
    low = F.when(F.col("_place") == 1, F.lit(1)).otherwise(F.col("_place") + side)
    high = F.when(F.col("_place") == F.col("_n") - k + 1, F.col("_n")).otherwise(F.col("_place") + side)
    return out.select(*by, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("place"), "result")


def _placed(df: DataFrame, order: str, by: Sequence[str], chunk: int | None) -> DataFrame:
    """With _place, an element's number in its vector, and _n, how many that has."""
    rows = running(df, {"_place": ("sum", F.lit(1).cast("long"))}, order, [order], chunk=chunk, by=by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, list(by)).drop(order)


def moving_median(df: DataFrame, k: int, *, value: str = "value", order: str = "rid", by: Sequence[str] = ("space",), rule: str = "median", size: int = ROWS, chunk: int | None = None) -> DataFrame:
    """Running median of odd ``k`` with a result for every element, as :func:`lists.running_median`: by, place, result.

    What differs at the ends depends on fewer than ``2 k`` elements there, so these alone are taken as lists.
    """
    if rule not in ("keep", "constant", "median") or k % 2 == 0:
        raise ValueError("rule must be keep, constant or median, and k odd")
    side = k // 2
    placed = _placed(df.select(*by, order, F.col(value).alias("_v")), order, by, chunk)
    inner = moving(df, k, "median", value=value, order=order, by=by, size=size, chunk=chunk)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    inner = inner.withColumn("place", F.col("place") + side).join(n, list(by)).filter(F.col("_n") >= 2 * k).select(*by, "place", "result")
    ends = F.array_compact(F.array(F.when(F.col("_place") <= 2 * k, F.lit(0)), F.when((F.col("_n") >= 2 * k) & (F.col("_place") > F.col("_n") - 2 * k), F.lit(1))))
    short = placed.withColumn("_end", F.explode(ends)).groupBy(*by, "_n", "_end").agg(F.array_sort(F.collect_list(F.struct("_place", "_v"))).alias("_l"))
    short = short.select(*by, "_n", "_end", F.col("_l")[0]["_place"].alias("_from"), F.transform("_l", lambda x: x["_v"]).alias("_l"))
    short = short.withColumn("_r", lists.running_median("_l", k, rule=rule))
    short = short.select(*by, "_n", "_end", "_from", F.posexplode("_r").alias("_i", "result")).withColumn("place", (F.col("_from") + F.col("_i")).cast("long"))
    mine = (F.col("_n") < 2 * k) | ((F.col("_end") == 0) & (F.col("place") <= side)) | ((F.col("_end") == 1) & (F.col("place") > F.col("_n") - side))
    return inner.unionByName(short.filter(mine).select(*by, "place", F.col("result").cast("double")))

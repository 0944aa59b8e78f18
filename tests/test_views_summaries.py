"""View summaries by running sums and sparse tables, against plain definitions."""

import math
import random

import pytest

from rangeloom.operators import views
from rangeloom.plans import extremes


def cover(rng, n, pick):
    """Runs that cover 1..end of a space without holes."""
    runs, at = [], 1
    for _ in range(n):
        size = rng.choice([1, 1, 2, 5, 40])
        runs.append((at, at + size - 1, pick()))
        at += size
    return runs


def order(value):
    return (1, 0.0) if math.isnan(value) else (0, value)


def plain(runs, s, e, na_rm):
    parts = [(max(a, s), min(z, e), v, a, z) for a, z, v in runs if a <= e and z >= s] if e >= s else []
    n, nulls = sum(z - a + 1 for a, z, *_ in parts), sum(z - a + 1 for a, z, v, *_ in parts if v is None)
    known = [p for p in parts if p[2] is not None]
    total = sum(v * (z - a + 1) for a, z, v, *_ in known)
    whole = na_rm or not nulls
    stop = min((a for a, _, v, *_ in parts if v is None), default=None)
    placed = known if na_rm or stop is None else [p for p in known if p[0] < stop]
    low = min(placed, key=lambda p: (order(p[2]), p[0]), default=None)
    high = max(placed, key=lambda p: (order(p[2]), -p[0]), default=None)
    return {
        "n": n,
        "view_sum": total if whole else None,
        "view_mean": total / (n - nulls) if whole and n > nulls else None,
        "view_min": min((p[2] for p in known), key=order, default=None) if whole else None,
        "view_max": max((p[2] for p in known), key=order, default=None) if whole else None,
        "which_min": low and low[0],
        "which_max": high and high[0],
    }


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == b or (math.isnan(a) and math.isnan(b)) or (math.isfinite(a) and abs(a - b) <= 1e-9 * max(1, abs(a), abs(b)))


@pytest.mark.parametrize("kind", ["long", "double"])
@pytest.mark.parametrize("na_rm", [False, True])
def test_summaries(spark, kind, na_rm):
    rng = random.Random(31)
    odd = [None] * 2 + ([float("nan"), float("inf"), float("-inf")] if kind == "double" else [])
    pick = lambda: rng.choice(odd) if rng.random() < 0.01 else (rng.randint(-9, 9) if kind == "long" else rng.uniform(-5, 5))
    runs = {0: cover(rng, 900, pick), 1: cover(rng, 3, pick), 2: cover(rng, 40, lambda: None)}
    asked = []
    for space, rows in runs.items():
        top = rows[-1][1]
        asked += [(space, 1, top), (space, -5, top + 9), (space, 0, 0), (space, top + 1, top + 3), (space, 5, 4), (space, top, top)]
        for _ in range(150):
            a = rng.randint(-3, top + 3)
            asked.append((space, a, a + rng.choice([-1, 0, 1, 7, 60, 900, top])))
    asked = [(s, i, a, z, "extra") for i, (s, a, z) in enumerate([*asked, (7, 1, 5)])]
    subject = spark.createDataFrame([(s, *r) for s, rows in runs.items() for r in rows], f"space long, start long, end long, value {kind}")
    frame = spark.createDataFrame(asked, "space long, rid long, start long, end long, name string")
    got = views.summarize(frame, subject, na_rm=na_rm)
    assert got.columns == [*frame.columns, *views.SUMMARIES]
    rows = {r.rid: r for r in got.collect()}
    assert len(rows) == len(asked)
    for space, rid, a, z, _ in asked:
        want = plain(runs.get(space, []), a, z, na_rm)
        for name, value in want.items():
            assert same(rows[rid][name], value), (kind, na_rm, name, space, a, z, rows[rid], want)
    some = views.summarize(frame, subject, na_rm=na_rm, columns=["view_mean", "n"])
    assert some.columns == [*frame.columns, "view_mean", "n"]
    assert all(same(r.view_mean, rows[r.rid].view_mean) for r in some.collect())


def test_extreme_runs(spark):
    runs = [(1, 4, 7), (5, 5, None), (6, 9, 2), (10, 12, 2), (13, 20, 7)]
    subject = spark.createDataFrame([(0, *r) for r in runs], "space long, start long, end long, value long")
    asked = spark.createDataFrame([(0, 1, 7, 30), (0, 2, 11, 11), (0, 3, 3, 2), (0, 4, 40, 50)], "space long, rid long, start long, end long")
    low = {r.rid: tuple(r)[2:] for r in views.extreme_runs(asked, subject).collect()}
    assert low == {1: (7, 6, 9, 2), 2: (11, 10, 12, 2)}
    high = {r.rid: tuple(r)[2:] for r in views.extreme_runs(asked, subject, largest=True).collect()}
    assert high == {1: (13, 13, 20, 7), 2: (11, 10, 12, 2)}
    over_null = asked.withColumn("start", asked["start"] - 3)
    with pytest.raises(Exception, match="a view holds a null"):
        views.extreme_runs(over_null, subject).collect()
    assert {r.rid: r.pos for r in views.extreme_runs(over_null, subject, na_rm=True).collect()} == {1: 6, 2: 8, 3: 1}


def test_one_view_over_all_runs(spark):
    """No rows are made for what a view sees: one view over all runs, and a thousand of them."""
    from pyspark.sql import functions as F

    n = 200_000
    subject = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("space"), (F.col("id") * 2 - 1).alias("start"), (F.col("id") * 2).alias("end"), ((F.col("id") * 7919) % 100_003).alias("value"))
    frame = spark.range(1000).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("rid"), (F.col("id") + 1).alias("start"), (F.lit(2 * n) - F.col("id")).alias("end"))
    values = [(i * 7919) % 100_003 for i in range(1, n + 1)]
    rows = {r.rid: r for r in views.summarize(frame, subject).collect()}
    for rid in (0, 1, 500, 999):
        seen = [values[(p - 1) // 2] for p in range(rid + 1, 2 * n - rid + 1)]
        assert (rows[rid].view_sum, rows[rid].view_min, rows[rid].view_max) == (sum(seen), min(seen), max(seen))
        assert rows[rid].which_min == rid + 1 + seen.index(min(seen)) and rows[rid].which_max == rid + 1 + seen.index(max(seen))


def test_table_against_slices():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(32)
    for n in (1, 2, 7, 64, 100):
        values = [rng.choice([1.0, 2.0, 2.0, float("nan"), -1.0]) for _ in range(n)]
        at = sorted(rng.sample(range(1000), n))
        column = {f"{s}_{p}": (values if p == "value" else at) for s in ("lo", "hi") for p in extremes.PARTS}
        table = extremes.Table(pa.table({"at": at} | column))
        low = np.array([rng.randint(-5, 1005) for _ in range(60)])
        high = low + np.array([rng.randint(-1, 700) for _ in range(60)])
        got = table.answer(low, high)
        for i in range(60):
            seen = [(order(v), p) for v, p in zip(values, at, strict=True) if low[i] <= p <= high[i]]
            assert got["lo_start"][i].as_py() == (min(seen)[1] if seen else None)
            assert got["hi_start"][i].as_py() == (max(seen, key=lambda x: (x[0], -x[1]))[1] if seen else None)

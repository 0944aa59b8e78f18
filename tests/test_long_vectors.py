"""Moving values, ranks, quantiles and rank correlation in long form, against lists and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import lists, moving, ranks


def vectors(spark, rng, nulls=True, sizes=(90, 4, 1, 37)):
    pick = lambda: None if nulls and rng.random() < 0.08 else float(rng.randint(-20, 20)) / 2
    held = {g: [pick() for _ in range(n)] for g, n in enumerate(sizes)}
    rows = [(g, 10 * i + 3, v) for g, vs in held.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    return held, spark.createDataFrame(rows, "space long, rid long, value double").repartition(5)


def listed(spark, held, column):
    df = spark.createDataFrame(list(held.items()), "space long, v array<double>")
    return {(r.space, i + 1): x for r in df.select("space", column.alias("r")).collect() for i, x in enumerate(r.r or [])}


WAYS = [("sum", {}), ("mean", {}), ("wtsum", {"weights": [1, 2, 0.5, 4, 1]}), ("q", {"nth": 2}), ("median", {})]


@pytest.mark.parametrize("how, more", WAYS, ids=str)
def test_moving_as_lists(spark, how, more):
    held, df = vectors(spark, random.Random(61))
    for rule, na_rm in (("drop", False), ("constant", True)):
        if na_rm and how in ("wtsum", "q"):
            na_rm = False
        got = {(r.space, r.place): r.result for r in moving.moving(df, 5, how, rule=rule, na_rm=na_rm, size=7, **more).collect()}
        want = listed(spark, held, lists.running("v", 5, how, rule=rule, na_rm=na_rm, **more))
        assert set(got) == set(want)
        assert all((got[k] is None and want[k] is None) or abs(got[k] - want[k]) < 1e-9 for k in want), (rule, na_rm)


@pytest.mark.parametrize("rule", ["keep", "constant", "median"])
def test_moving_median_as_lists(spark, rule):
    held, df = vectors(spark, random.Random(62), nulls=False, sizes=(90, 4, 1, 9, 10, 11))
    got = {(r.space, r.place): r.result for r in moving.moving_median(df, 5, rule=rule, size=7).collect()}
    assert got == pytest.approx(listed(spark, held, lists.running_median("v", 5, rule=rule)))


def test_a_vector_of_a_million(spark):
    n, k = 1_000_000, 101
    df = spark.range(n).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("rid"), ((F.col("id") * 7919) % 10_007).cast("double").alias("value"))
    v = (np.arange(n) * 7919 % 10_007).astype("f8")
    sums = moving.moving(df, k, "sum").orderBy("place").select("result").toPandas()["result"].to_numpy()
    assert np.allclose(sums, np.convolve(v, np.ones(k), "valid"))
    middle = moving.moving(df, k, "median").filter("place % 50021 = 1").collect()
    assert len(middle) == 20 and all(r.result == np.median(v[r.place - 1 : r.place - 1 + k]) for r in middle)


@pytest.mark.parametrize("method", ["average", "min", "max", "first", "dense"])
def test_ranks(spark, method):
    held, df = vectors(spark, random.Random(63))
    got = {(r.space, r.rid): r["rank"] for r in ranks.ranks(df, "value", method=method, chunk=3).collect()}
    for g, vs in held.items():
        known = sorted(v for v in vs if v is not None)
        for i, v in enumerate(vs):
            if v is None:
                assert got[g, 10 * i + 3] is None
                continue
            low, n = known.index(v) + 1, known.count(v)
            first = low + sum(x == v for x in vs[:i])
            want = {"average": low + (n - 1) / 2, "min": low, "max": low + n - 1, "first": first, "dense": len(set(known[: low - 1])) + 1}[method]
            assert got[g, 10 * i + 3] == want


def test_quantiles(spark):
    held, df = vectors(spark, random.Random(64))
    probabilities = [0, 0.1, 0.25, 0.5, 0.77, 1]
    got = {(r.space, r.p): r.quantile for r in ranks.quantiles(df, "value", probabilities).collect()}
    for g, vs in held.items():
        known = [v for v in vs if v is not None]
        for p in probabilities:
            assert (g, p) not in got if not known else abs(got[g, p] - np.quantile(known, p)) < 1e-9


def test_kendall(spark):
    rng = random.Random(65)
    rows = [(g, rng.choice([None, *range(8)]), float(rng.randint(0, 6)) + (0 if g else 0.5)) for g in (0, 1) for _ in range(120)] + [(2, 1, 1.0), (2, 1, 2.0), (3, 5, 5.0)]
    got = {r.space: r.tau for r in ranks.kendall(spark.createDataFrame(rows, "space long, x long, y double"), "x", "y").collect()}
    for g in (0, 1):
        known = [(x, y) for s, x, y in rows if s == g and x is not None]
        sign = lambda a, b: (a > b) - (a < b)
        pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for i, a in enumerate(known) for b in known[:i]]
        want = sum(a * b for a, b in pairs) / (sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs)) ** 0.5
        assert abs(got[g] - want) < 1e-12
    assert got[2] is None and got[3] is None

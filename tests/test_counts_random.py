"""Counts, yes/no answers and single answers of every overlap type, against all pairs."""

import random

import pytest
from helpers import frame
from pyspark.sql import functions as F

from rangeloom.operators import nearest, overlaps
from rangeloom.plans.dominance import below


def hits(q, s, type="any", maxgap=-1, minoverlap=0):
    (qs, qe), (ss, se) = q, s
    g, shared = max(maxgap, 0), min(qe, se) - max(qs, ss) + 1
    enough = not minoverlap or shared >= minoverlap
    if type == "any":
        return enough if minoverlap else qs <= se + maxgap + 1 and ss <= qe + maxgap + 1
    if type in ("start", "end", "equal"):
        near = (type == "end" or abs(qs - ss) <= g) and (type == "start" or abs(qe - se) <= g)
        return near and enough
    slack = (qs - ss) + (se - qe)
    if type == "within":
        return ss <= qs and qe <= se and qe - qs + 1 >= minoverlap and (g == 0 or slack <= g)
    return qs <= ss and se <= qe and se - ss + 1 >= minoverlap and (g == 0 or -slack <= g)


def some(rng, n):
    return [(a, a + rng.choice([-1, 0, 1, 3, 8, 40])) for a in (rng.randint(-20, 60) for _ in range(n))]


WAYS = [
    {},
    {"maxgap": 0},
    {"maxgap": 4},
    {"minoverlap": 3},
    *({"type": t, **more} for t in ("start", "end", "equal", "within", "extend") for more in ({}, {"maxgap": 3}, {"maxgap": 2, "minoverlap": 2})),
]


@pytest.mark.parametrize("how", WAYS, ids=str)
def test_all_ways(spark, how):
    rng = random.Random(str(how))
    q, s = some(rng, 60), some(rng, 90)
    query, subject = frame(spark, q).unionByName(frame(spark, q[:5], space=1)), frame(spark, s)
    want = {i: [j for j, y in enumerate(s, 1) if hits(x, y, **how)] for i, x in enumerate(q, 1)}
    got = {(r.space, r.rid): r.n for r in overlaps.count(query, subject, **how).collect()}
    assert got == {(0, i): len(js) for i, js in want.items()} | {(1, i): 0 for i in range(1, 6)}
    if how.get("type") in (None, "within"):
        touched = sorted(tuple(r) for r in overlaps.touched(query, subject, **how).collect())
        assert touched == sorted((0, i) for i, js in want.items() if js)
    which, pick = ("first", min) if how.get("maxgap", -1) < 0 else ("last", max)
    got = {(r.space, r.query_id): r.subject_id for r in overlaps.one_hit(query, subject, which, **how).collect()}
    assert got == {(0, i): pick(js, default=None) for i, js in want.items()} | {(1, i): None for i in range(1, 6)}


@pytest.mark.parametrize("how", ["sum", "min", "max"])
def test_below(spark, how):
    rng = random.Random(33)
    points = [(rng.choice("ab"), rng.randint(-300, 300), rng.randint(-5000, 5000), rng.randint(-9, 9)) for _ in range(400)]
    asks = [(rng.choice("abc"), i, rng.randint(-320, 320), rng.randint(-5200, 5200)) for i in range(300)]
    got = below(spark.createDataFrame(points, "space string, x long, y long, value long"), spark.createDataFrame(asks, "space string, ask long, x long, y long"), how)
    fold = {"sum": sum, "min": min, "max": max}[how]
    want = {}
    for space, i, x, y in asks:
        seen = [v for s, px, py, v in points if s == space and px <= x and py <= y]
        if seen:
            want[i] = fold(seen)
    found = {r.ask: r.value for r in got.collect()}
    if how == "sum":
        assert all(found.get(i, 0) == want.get(i, 0) for _, i, _, _ in asks)
    else:
        assert found == want
    nothing = spark.createDataFrame([], "space string, x long, y long, value long")
    assert below(nothing, spark.createDataFrame(asks, "space string, ask long, x long, y long"), how).collect() == []


def test_a_million_subjects_on_one_place(spark):
    many = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("rid"), F.lit(100).cast("long").alias("start"), F.lit(120).cast("long").alias("end"))
    query = spark.range(1, 2001).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("rid"), (F.lit(90) + F.col("id") % 20).cast("long").alias("start"), (F.lit(105) + F.col("id") % 20).cast("long").alias("end"))
    assert overlaps.one_hit(query, many, "last").agg(F.min("subject_id"), F.max("subject_id"), F.count("subject_id")).first()[:] == (1_000_000, 1_000_000, 2000)
    assert overlaps.count(query, many, type="within").groupBy("n").count().orderBy("n").collect()[-1].n == 1_000_000
    assert nearest.nearest(query, many).agg(F.max("subject_id")).first()[0] == 1

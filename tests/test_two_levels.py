"""Numbering and runs over long rows of one space: right across chunks, and not in one task."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rangeloom import model
from rangeloom.operators import algebra
from rangeloom.sources import derived


@pytest.fixture
def apart(spark):
    """Partitions stay as they are dealt and rows aren't broadcast, as if there were many: rows' tasks can be counted."""
    ours = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks(df):
    return len({r._task for r in df.withColumn("_task", F.spark_partition_id()).collect()})


def test_line_numbers(spark, apart, tmp_path):
    rng = random.Random(1)
    rows = [(k, n, rng.randint(1, 9), rng.randint(1, 99), datetime.date(1995, 1, rng.randint(1, 28)), float(rng.randint(1, 50))) for k in rng.sample(range(1, 1 << 20), 400) for n in (1, 2, 2)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = derived.line_ranges(spark, str(tmp_path))
    assert tasks(out) > 1
    day = lambda x: (x - datetime.date(1970, 1, 1)).days
    # rows that agree in the five columns are told apart by nothing
    places = {i: (r[3] % 8, day(r[4])) for i, r in enumerate(sorted(rows, key=lambda r: r[:5]), 1)}
    assert {r.rid: (r.space, r.start) for r in out.collect()} == places


def test_runs(spark, apart):
    rng = random.Random(2)
    places = sorted(rng.sample(range(1, 1 << 20), 300))
    rows = [(0, p, rng.choice([None, 1, 1, 2])) for p in places] + [(1, 7, None), (1, 8, None), (1, 1 << 19, 5)]
    df = spark.createDataFrame(rows, "space long, rid long, value long")
    want = []
    for space, rid, value in rows:
        if want and want[-1][0] == space and want[-1][3] == value:
            want[-1][2] = rid
        else:
            want.append([space, rid, rid, value])
    got = algebra.runs_of(df)
    assert sorted(map(tuple, got.select("space", "start", "end", "value").collect()), key=lambda r: r[:2]) == [tuple(r) for r in want]
    assert tasks(got.filter("space = 0")) > 1


def test_islands(spark, apart):
    rng = random.Random(3)
    at, rows = 0, []
    for p in sorted(rng.sample(range(1, 1 << 20), 300)):
        at += rng.choice([1, 1, 1, 3, -2])
        rows.append((0, p, at))
    want = []
    for _, _, value in rows:
        if want and want[-1][1] + 1 == value:
            want[-1][1] = value
        else:
            want.append([value, value])
    df = spark.createDataFrame(rows, "space long, rid long, pos long")
    assert [(r.start, r.end) for r in model.from_integers(df).orderBy("rid").collect()] == [tuple(r) for r in want]
    assert [(r.start, r.end) for r in model.stitch(df.select("space", "rid", F.col("pos").alias("start"), F.col("pos").alias("end"))).orderBy("rid").collect()] == [tuple(r) for r in want]
    assert tasks(model._islands(df, "pos", "pos")) > 1

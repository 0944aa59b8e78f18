"""What the joins of ranges move and store: no hit to fetch columns, no second copy of a side, no shuffle files of stored rows."""

import random
from collections import Counter
from pathlib import Path

import pytest
from helpers import frame
from pyspark.sql import functions as F

from rangeloom.operators import nearest, overlaps
from rangeloom.plans import binning
from rangeloom.sources.scratch import kept


def nodes(df, name):
    """How often an operator stands in the optimized plan."""
    return sum(line.strip(" :+-").startswith(name) for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def some(rng, n):
    return [(a, a + rng.choice([-1, -1, 0, 2, 9, 40])) for a in (rng.randint(0, 300) for _ in range(n))]


@pytest.mark.parametrize("bins", [None, binning.Bins(3, 3)])
def test_hits_bring_the_columns_of_both_sides(spark, bins):
    rng = random.Random(11)
    q, s = some(rng, 60), some(rng, 80)
    query, subject = frame(spark, q).withColumn("mark", F.col("rid") * 3), frame(spark, s).withColumn("weight", F.col("rid") * 7)
    out = overlaps.merge(query, subject, bins=bins)
    assert out.columns == ["space", "q_rid", "q_start", "q_end", "q_mark", "s_rid", "s_start", "s_end", "s_weight"]
    want = Counter((0, i, *x, 3 * i, j, *y, 7 * j) for i, x in enumerate(q, 1) for j, y in enumerate(s, 1) if x[0] <= y[1] and y[0] <= x[1])
    assert Counter(tuple(r) for r in out.collect()) == want
    pairs = overlaps.pairs(query, subject, bins=bins)
    assert Counter((r.first.rid, r.first.mark, r.second.rid, r.second.weight) for r in pairs.collect()) == Counter((r[1], r[4], r[5], r[8]) for r in want.elements())
    assert nodes(out, "Join") == nodes(pairs, "Join") == 1


def test_sides_read_from_tables_are_not_copied(spark, monkeypatch):
    """A row is moved with one number beside its own columns."""
    monkeypatch.setattr(overlaps, "kept", None)
    left, right = frame(spark, [(1, 9), (4, 3)]), frame(spark, [(2, 700), (5, 5)])
    assert Counter(tuple(r) for r in overlaps.find(left, right).collect()) == Counter([(0, 1, 1), (0, 1, 2), (0, 2, 1)])
    for bins in (binning.Bins(4, 1), binning.Bins(4, 3)):
        for side in "qs":
            assert binning.dealt(left, F.col("start"), F.col("end"), bins, side).columns == [*left.columns, "_cell"]


def test_stored_rows_leave_no_shuffle_files(spark):
    places = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in places for f in d.rglob("shuffle_*.data")}
    before = files()
    rows = kept(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count())
    assert rows.count() == 5000
    wide = {f for f in files() - before if f.stat().st_size > 10_000}
    assert not wide
